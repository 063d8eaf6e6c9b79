"""Personal data, with offset-preserving deobfuscation.

Base kinds are found in the text as it stands. Texts that show a disguise are then rewritten by
a transducer (look-alike characters, full-width forms and invisible characters; character
references; `(at)`, `[.]`, ` dot ` and their like; runs of digits spelled in English or German) which keeps for every written character the source span
that it came from. Identifiers found in the rewritten text are mapped back to source offsets,
and those that rest on at least one rewritten character are added, also around a base span that
has taken only the plain part of one. Spelled digits count one by one in numbers, and in email
addresses only where seven or more follow each other.

Offsets are code points, ends exclusive. Defined cases: null text is empty text; no finding
gives zero counts, an empty `spans` and the digest of the empty string. Every base span stays.
Long runs of letters or digits are scanned once (no pattern backtracks over them). Equal rows
get equal results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .language_id import pa_schema
from .store import lean_batches, released, table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run matches from its first digit or not at all, so only first digits are tried.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: before each @ the whole run of local characters, as far as the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > free:  # the run may be long: widen the look back as long as it goes on
            low = max(free, start - step)
            got = low + len(text[low:start].rstrip(LOCAL))
            start, step = got, step * 2
            if got > low:
                break
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind, then by start."""
    out = list(emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Characters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹢": "+",
}
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORDS |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
# Character references of @ and the full stop.
ENTITIES = {"&#64;": "@", "&#064;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#046;": ".", "&#x2e;": ".", "&period;": "."}
# Top labels of more than two letters that end an address in bare words, two-letter ones that are words, and words that are no host there.
TOPS = set(
    "com org net edu gov mil int info biz name pro mobi museum travel jobs coop aero asia arpa cat tel post xxx app dev cloud online site website shop store blog page web news media email tech technology digital "
    "design studio photography photos gallery academy agency company consulting services solutions systems software network host hosting wiki club life live world group team global email berlin london paris tokyo".split()
)
WORDS_OF_TWO = set("am an as at be by do go he if in is me my no of on or ox so to up us we".split())
NOT_HOSTS = set("the a an this that these those it him her them me us you noon midnight night home work school once all least last first any some every which what".split())

_CHARS = re.compile(f"[{''.join(map(re.escape, LOOKALIKES))}{INVISIBLE}！-～]")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?ia)(?<![a-z]){_WORD}(?:[ -]+{_WORD}){{6,}}(?![a-z])")
_SPELLED_FEW = re.compile(rf"(?ia)(?<![a-z]){_WORD}(?:[ -]+{_WORD})*(?![a-z])")
_SPELLED_PLUS = re.compile(r"(?i)(?<![a-z])plus[ ]+$")
_ONE_WORD = re.compile(rf"(?ia){_WORD}")
# Bracketed words stand for a sign by themselves; bare ones only inside `local at host dot top`, with a known top.
_BRACKETED = re.compile(r"(?i)\s{0,3}[(\[{<]\s{0,3}(at|dot)\s{0,3}[)\]}>]\s{0,3}|(?<=[a-z0-9])[(\[{<]([@.])[)\]}>](?=[a-z0-9])")
_ENTITY = re.compile("(?i)" + "|".join(ENTITIES))
_BARE = re.compile(r"(?i)(?<=[a-z0-9])(\s{1,3}at\s{1,3})(?=([a-z0-9-]{1,63})(?:\s{1,3}dot\s{1,3}[a-z0-9-]{1,63}|\.[a-z0-9-]{1,63}){0,8}\s{1,3}dot\s{1,3}([a-z]{2,18})(?![a-z0-9]))")
_BARE_DOT = re.compile(r"(?i)(?<=[a-z0-9])\s{1,3}dot\s{1,3}(?=[a-z0-9])")
_BRACKET_HINT = re.compile(r"(?i)[(\[{<](?:\s{0,3}(?:at|dot)\s{0,3}|[@.])[)\]}>]")
_DOT_HINT = re.compile(r"(?i)\sdot\s")
_SPELLED_HINT = re.compile(rf"(?ia)(?<![a-z]){_WORD}[ ().-]+(?:[0-9]|{_WORD}(?![a-z]))|[0-9][ ().-]+{_WORD}(?![a-z])")


def disguised(text: str) -> bool:
    """Whether the transducer could rewrite anything; cheap, and never false for a text that it would rewrite to use."""
    return bool(
        (not text.isascii() and _CHARS.search(text))
        or _BRACKET_HINT.search(text)
        or ("&" in text and _ENTITY.search(text))
        or ("dot" in (low := text.lower()) and _DOT_HINT.search(text))
        or (any(w in low for w in DIGIT_WORDS) and _SPELLED_HINT.search(text))
    )


class Rewritten:
    """A text after some rules, and for each of its characters the source span and whether a rule wrote it."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def apply(self, found: list[tuple[int, int, str]]) -> None:
        """Replace spans (start, end, new), in order and apart."""
        if not found:
            return
        text, starts, ends, changed, last = [], [], [], bytearray(), 0
        for a, b, new in found:
            text += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[last:a] + b"\1" * len(new)
            last = b
        text.append(self.text[last:])
        self.text, self.starts, self.ends, self.changed = "".join(text), starts + self.starts[last:], ends + self.ends[last:], changed + self.changed[last:]


def deobfuscate(text: str) -> Rewritten:
    out = Rewritten(text)
    chars = [(m.start(), m.end(), "" if m[0] in INVISIBLE else LOOKALIKES.get(m[0]) or chr(ord(m[0]) - 0xFEE0)) for m in _CHARS.finditer(text)] if not text.isascii() else []
    out.apply(chars)
    if "&" in out.text:
        out.apply([(*m.span(), ENTITIES[m[0].lower()]) for m in _ENTITY.finditer(out.text)])
    out.apply([(m.start(), m.end(), m[2] or ("@" if m[1].lower() == "at" else ".")) for m in _BRACKETED.finditer(out.text)])
    out.apply([(*m.span(1), "@") for m in _BARE.finditer(out.text) if host(m[2].lower(), m[3].lower())])
    out.apply([(*m.span(), ".") for m in _BARE_DOT.finditer(out.text)])
    out.apply(spelled(out.text, _SPELLED))
    return out


def host(first: str, top: str) -> bool:
    """Whether bare words may be an address's host, by its first and top label."""
    return first not in NOT_HOSTS and (top in TOPS or (len(top) == 2 and top not in WORDS_OF_TWO))


def spelled(text: str, runs: re.Pattern) -> list[tuple[int, int, str]]:
    """Runs of spelled digits and the plus before one, with their digits."""
    out = []
    for m in runs.finditer(text):
        plus = _SPELLED_PLUS.search(text, max(0, m.start() - 12), m.start())
        out.append((plus.start() if plus else m.start(), m.end(), "+" * bool(plus) + "".join(DIGIT_WORDS[w.lower()] for w in _ONE_WORD.findall(m[0]))))
    return out


def shown(new: Rewritten, kinds: tuple[str, ...]) -> set[Span]:
    """Source spans of identifiers that rest on a rewritten character."""
    out = set()
    for kind, a, b in base_spans(new.text):
        if kind in kinds and (any(new.changed[a:b]) or any(x != y for x, y in zip(new.ends[a : b - 1], new.starts[a + 1 : b], strict=True))):
            out.add((kind, new.starts[a], new.ends[b - 1]))
    return out


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What only the rewritten text shows, as source spans. They may hold or cross base spans, which stay."""
    new = deobfuscate(text)
    out = shown(new, KINDS)
    if few := spelled(new.text, _SPELLED_FEW):
        new.apply(few)
        out |= shown(new, KINDS[1:])
    return sorted(out.difference(base))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind as listed and then by start."""
    text = text or ""
    base = base_spans(text)
    more = added_spans(text, base) if disguised(text) else []
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), *s[1:])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all spans). Without keep_text the
    texts don't come back from Python, and the column goes."""
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    docs = docs.drop(*names)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        for batch in batches:
            rows = [[] for _ in names]
            for t in (c.as_py() for c in batch.column(batch.schema.get_field_index(text))):
                base, spans = find(t)
                for i, k in enumerate(KINDS):
                    rows[i].append(sum(s[0] == k for s in base))
                rows[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[5].append(joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=[*kept, *names])

    return docs.mapInArrow(released(run), pa_schema(docs.select(*kept), dict.fromkeys(names[:4], "long") | dict.fromkeys(names[4:], "string")))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that touch share the first one's kind."""
    if text is None:
        return None
    _, spans = find(text)
    if not spans:
        return text
    groups: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if groups and a < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], b)
        else:
            groups.append([k, a, b])
    edges = [["", 0, 0], *groups, ["", len(text), len(text)]]
    return "".join(text[p[2] : q[1]] + (f"[{q[0]}]" if q[0] else "") for p, q in pairwise(edges))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced; n_chars, where there is one, follows."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = [masked(t.as_py()) for t in batch.column(i)]
            columns = list(batch.columns)
            columns[i] = pa.array(new, batch.schema.field(i).type)
            if "n_chars" in names:
                j = batch.schema.get_field_index("n_chars")
                columns[j] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(released(run), docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    with lean_batches(spark):  # spans are small, so they are written there and then
        return written(detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False), "pii")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts masked; null texts stay null, other columns stay."""
    with lean_batches(spark):
        return written(redact(docs), "masked")
