"""Templates of licences by SPDX name: short statements and headers, and whole texts of the short licences.

All values are fixed: public licence wording. Families (GNU, Creative Commons) follow from a rule.
"""

from __future__ import annotations

import re

# GNU licences, (SPDX name, short name, name, version, date of its title).
_GNU = [
    ("GPL-2.0", "GPL", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GPL", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.0", "LGPL", "GNU Library General Public License", "2", "June 1991"),
    ("LGPL-2.1", "LGPL", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "LGPL", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "AGPL", "GNU Affero General Public License", "3", "19 November 2007"),
]
# Creative Commons conditions and versions.
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

# Statements and headers of single licences.
_STATEMENTS = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Released under the ISC License"],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "CC0-1.0": ["Released under CC0 1.0", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Whole texts of short licences, without title and copyright line.
FULL = {
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. " + _STATEMENTS["BSD-3-Clause"][1] + " " + _BSD_TAIL,
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

# Words of short statements that say nothing of which licence it is.
_PLAIN = {"a", "an", "and", "code", "file", "is", "licence", "licenced", "license", "licensed", "program", "released", "software", "the", "this", "under", "version", "work", "legal"}
_VARIANTS = {"affero", "lesser", "library"}


def statements() -> dict[str, list[str]]:
    """Every licence's statements, headers and whole text."""
    out = {name: list(texts) for name, texts in _STATEMENTS.items()}
    for spdx, short, name, v, date in _GNU:
        header = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        out[spdx] = [
            f"This work is licensed under the {name}, version {v}",
            header + f"either version {v} of the License, or (at your option) any later version.",
            header + f"version {v} of the License.",
            f"{name} Version {v}, {date}",
            f"Licensed under the {short} v{v}",
            f"Licensed under the {short}v{v}",
        ]
    for code, name in _CC.items():
        for v, port in _CC_VERSIONS.items():
            out[f"CC-{code}-{v}"] = [f"Licensed under CC {code} {v}", f"This work is licensed under the Creative Commons {name} {v} {port} License", f"Creative Commons {name} {v} {port}"]
    for name, text in FULL.items():
        out[name].append(text)
    for name, texts in out.items():
        # A licence's tag is one word of its own, see licences.words_of.
        texts.append(f"SPDX-License-Identifier: {name}")
        if name.split("-")[0] in {g[1] for g in _GNU}:
            texts += [f"SPDX-License-Identifier: {name}{end}" for end in ("-only", "-or-later", "+")]
    return out


def is_mark(word: str, n_words: int) -> bool:
    """Whether a passage must hold the word to be taken for the statement of n_words words.

    Of a short statement all words but plain ones, of a header its versions and variants; of whole texts none.
    """
    if n_words > 80:
        return False
    return word not in _PLAIN if n_words <= 14 else word in _VARIANTS or bool(re.search(r"\d", word))
