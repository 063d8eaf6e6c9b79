"""The training-data operators on small tables, against brute force, other libraries and round trips."""

import hashlib
import itertools
import math
import html
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.llm import bpe, components, decontaminate, dom, html_text, language_id, licences, near_duplicates, pii, store, topk, urls, warc
from tidelight.llm.store import new_folder

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice(["th", "an", "er", "on", "re", "ti", "en", "at"]) for _ in range(RNG.randint(1, 4))) for _ in range(400)]


def words(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, no letters, a long text, repeated rows, and extra columns with names that operators use."""
    long = words(20_000)
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %%% 7", None), (4, long, "en"), (4, long, "en"), (None, "a text without an id", "en"), (6, "日本語 текст", "xx"), (7, " \n\t ", "en"), (8, "one", "en"), (9, "one", "en")]
    df = docs_frame(spark, rows)
    for c in ("lang_pred", "score", "spans", "n_tokens", "row_key", "class_id", "bucket", "w", "block"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return docs_frame(spark, []).select("*")


# Language ID


@pytest.mark.parametrize("dense", [0, 1 << 20])
def test_phrases_equal_a_greedy_parse(monkeypatch, dense):
    monkeypatch.setattr(language_id, "DENSE", dense)
    samples = {"a": "abcab cabba", "b": "xyz zyx xx"}
    p = language_id.CrossParser(samples)
    codes = p.codes()
    texts = ["abc abq", "zyx", "", "qq", "a" * 1300, "xyz zyx, ABC", "ab日本"]
    letters, rates = p.rates(texts, codes)
    for t, has, row in zip(texts, letters, rates, strict=True):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = re.sub(" +", " ", s)
        assert has == sum(c.isalpha() for c in t)
        for k, lang in enumerate(p.languages):
            n = 0
            for at in range(0, len(s), language_id.BLOCK):
                rest = s[at : at + language_id.BLOCK]
                while rest:
                    size = 1
                    while size < len(rest) and rest[: size + 1] in language_id.letters_only(samples[lang])[: p.size]:
                        size += 1
                    n, rest = n + (1 if rest[0] in language_id.letters_only(samples[lang])[: p.size] else 2), rest[size:]
            want = n * np.log2(p.size) / max(1, len(s))
            assert row[k] == pytest.approx(want), (t, lang)


def test_large_alphabets_and_unequal_samples():
    rng = random.Random(5)
    han, kana = [chr(0x4E00 + i) for i in range(2000)], [chr(0x3041 + i) for i in range(80)]
    chinese = "".join(rng.choice(han) + rng.choice(["", "", " "]) for _ in range(9000))
    japanese = "".join(rng.choice(kana + han[:300]) for _ in range(30_000))
    p = language_id.CrossParser({"zh": chinese, "ja": japanese, "en": words(2000)})
    assert {type(t) for t in p.tables} == {language_id.Dense, language_id.Hashed}
    texts = [chinese[300:420], japanese[500:640], words(20), "".join(rng.choice(han[400:]) for _ in range(60))]
    _, rates = p.rates(texts, p.codes())
    assert [p.languages[i] for i in rates.argmin(1)] == ["zh", "ja", "en", "zh"]


def test_ties_go_to_the_first_language(spark):
    p = language_id.CrossParser({"b": "one two three", "a": "one two three"})
    [r] = language_id.identify(docs_frame(spark, [(1, "one", None)]), p).collect()
    assert (r.lang_pred, r.score) == ("a", 0.0)


def test_languages_held_out(spark):
    rows = language_id.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 10
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_a_language_or_und(spark, odd, empty):
    p = language_id.CrossParser({"en": words(500), "de": "der die das und nicht ein eine " * 30})
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(odd, p).collect()]
    assert Counter(got)[(4, "en")] == 2
    assert {k for k, v in got if v == "und"} == {1, 2, 3, 7}
    assert language_id.identify(empty, p).count() == 0
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.stage(spark, odd, DATA).columns == odd.columns


# What operators leave behind


def test_lean_batches_are_for_a_while(spark):
    keys = list(store.LEAN)
    before = [spark.conf.get(k) for k in keys]
    with store.lean_batches(spark):
        assert [int(spark.conf.get(k)) for k in keys] == list(store.LEAN.values())
    assert [spark.conf.get(k) for k in keys] == before
    bpe.op3_byte_bpe(spark, DATA)
    pii.op10_pii(spark, DATA)
    assert [spark.conf.get(k) for k in keys] == before
    spark.conf.set(keys[1], "512k")
    with store.lean_batches(spark):
        assert spark.conf.get(keys[1]) == "512k"
    spark.conf.set(keys[1], before[1])


def test_links_of_large_clusters_are_complete(spark, monkeypatch):
    """Near copies of one text, more than are verified together: groups are whole, and all links are counted."""
    monkeypatch.setattr(near_duplicates, "TEXTS", 32)
    rng = random.Random(21)
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = []
    for _ in range(100):
        own = list(base)
        for k in rng.sample(range(120), rng.randint(1, 2)):
            own[k] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    pair = words(100)
    texts += [pair, f"{pair} more", words(80)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    sets = [set(near_duplicates.shingles(t).tolist()) for t in texts]
    for i, s in enumerate(sets):
        like = [j for j, o in enumerate(sets) if len(s & o) >= 0.8 * len(s | o)]
        assert got[i].n_links == got[i].n_text_links == len(like) - 1
        assert got[i].group_id == (0 if i < 100 else min(like))


@pytest.mark.parametrize("alice,numbers", [("Alice", "12 30 90"), ("Mary Ann", "12 30 90"), ("Bob", "7 45 81"), ("Alice", "twelve thirty ninety"), ("Mary Ann Lee", "seven forty-five eighty-one"), ("Alice", "one-hundred-and-two thirty ninety"), ("Alice", "12 $30 $90"), ("Bob", "12 30€ 90€"), ("ALL", "12 30 90")])
def test_questions_in_other_words_leak(spark, alice, numbers):
    """Other names, of more words, numbers in words, and currency signs for units."""
    template = "Every morning {0} packs {1} fresh apples into a basket and sells them for {2} at the market, so after a long day {0} counts {3} in the old tin and wonders how the money might be shared among the children of the village before the winter comes."
    fill = lambda name, a, b, c: template.format(name, a, b, c)
    money = lambda x: x if x[0] == "$" or x[-1] == "€" else f"{x} dollars"
    a, b, c = numbers.split()
    item = fill("Alice", "12", "30 dollars", "90 dollars")
    text = item.upper() if alice == "ALL" else fill(alice, a, money(b), money(c))
    benchmark = spark.createDataFrame([(1, item), (2, words(60))], "item_id long, text string")
    rows = [(1, f"{words(40).capitalize()}. {text} {words(40)}.", "en"), (2, words(300), "en")]
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_frame(spark, rows), benchmark).collect()] == [(1, 1)]


def test_names_of_several_words_in_a_text_of_one_case_leak(spark):
    item = "When Mary Ann Lee visits the harbour she counts every boat that enters before noon and writes the number into a small red book for her uncle John Henry Ross who keeps them."
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.lower(), "en"), (2, item.upper(), "en"), (3, item.replace("Mary Ann Lee", "Tim"), "en"), (4, item.replace("John Henry Ross", "Mary Ann Lee"), "en")]
    got = {r.doc_id: r for r in decontaminate.leaks(docs_frame(spark, rows), benchmark).collect()}
    assert set(got) >= {1, 2, 3}
    assert got[3].changed_slots == 1


@pytest.mark.parametrize("text,shown", [
    ("write john@example[.]com now", "john@example[.]com"), ("at 192[.]168[.]1[.]1 now", "192[.]168[.]1[.]1"), ("john[@]example(.)com!", "john[@]example(.)com"),
    ("ask john at example dot photography today", "john at example dot photography"), ("john&#64;example.com", "john&#64;example.com"), ("john&commat;example&#x2E;com", "john&commat;example&#x2E;com"),
    ("anna at post dot example dot de", "anna at post dot example dot de"), ("plus vier neun eins sieben zwei drei vier fünf sechs sieben acht ja", "plus vier neun eins sieben zwei drei vier fünf sechs sieben acht"),
    ("john [at] example [dot] anything", "john [at] example [dot] anything"),
    ("look at this dot it is red", None), ("we meet at noon dot com is late", None), ("sit at home dot me", None), ("see [.] and (@) there", None), ("he stood at table dot so", None), ("a &amp; b &#8217; c", None),
])
def test_disguises_and_prose(text, shown):
    _, spans = pii.find(text)
    assert [text[a:b] for _, a, b in spans] == ([shown] if shown else [])


def test_planted_disguises_are_found_where_they_are():
    """Identifiers in random disguises between words: each is found with its kind, from its first to its last character, and nothing else is."""
    rng = random.Random(31)
    like = {v: k for k, v in pii.LOOKALIKES.items()}
    at = ["@", " (at) ", "[at]", "[@]", "(@)", "&#64;", "{ at }"]
    dot = [".", " (dot) ", "[dot]", "[.]", "(.)", "&#46;", "\u3002"]
    digit = {v: k for k, v in pii.DIGIT_WORDS.items()}
    for _ in range(400):
        kind = rng.choice(["email", "ip", "phone"])
        if kind == "email":
            label = lambda: "".join(rng.choice("abcdeopxz") for _ in range(rng.randint(3, 8)))
            mine = "".join(like.get(c, c) if rng.random() < 0.2 else c for c in label()) + rng.choice(at) + label() + rng.choice(dot) + rng.choice(["com", "org", "photography"])
        elif kind == "ip":
            mine = "".join(str(rng.randint(1, 255)) + (rng.choice([".", "[.]", "(.)", "[dot]", " dot ", "&#46;"]) if k < 3 else "") for k in range(4))
        else:
            mine = "plus " + " ".join(digit[c] for c in "49" + "".join(rng.choice("123456789") for _ in range(9)))
        before, after = words(rng.randint(1, 9), rng), words(rng.randint(1, 9), rng)
        text = f"{before}, {mine}, {after}"
        _, spans = pii.find(text)
        assert (kind, len(before) + 2, len(before) + 2 + len(mine)) in spans, text
        assert all(len(before) + 2 <= a and b <= len(before) + 2 + len(mine) for _, a, b in spans), (text, spans)


# Byte-level BPE


def test_bpe_equals_tiktoken(spark, odd, empty):
    import tiktoken

    path, pattern = bpe.rank_file()
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabcdeé \n\t\x1c\u0085ß日本1２'st!?—🙂 THE ") for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["a" * 3000, " " * 999, "ab" * 2000, words(3000)]
    for frame in (odd, docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)])):
        rows = bpe.encode_decode(frame, path, pattern, keep_ids=True).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in frame.collect())
        for r in rows:
            ids = own.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids) == (len(ids), ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path, pattern).count() == 0
    staged = bpe.stage(spark, odd, DATA)
    assert (staged.count(), "text" in staged.columns) == (odd.count(), False)


def test_long_texts_are_split_like_others(monkeypatch):
    path, pattern = bpe.rank_file()
    e = bpe.Encoder(bpe.read_ranks(path), pattern)
    texts = [words(3000), "short"]
    whole = list(e.encode(texts))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 50)
    e.cache.clear()
    assert list(e.encode(texts)) == whole


# Personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(8000):
        t = "".join(rng.choice(rng.choice(["ab@.-+%", "0123456789 .-", "+1() -.5", "@a.b", "４а"])) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)
        base, both = pii.find(t)
        assert set(base) <= set(both)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john (at) site [dot] com now", "john (at) site [dot] com"), ("to jane dot doe at example dot org please", "jane dot doe at example dot org"), ("plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven"),
        ("аdmin@exаmple.com", "аdmin@exаmple.com"), ("１９２.１６８.1.1 x", "１９２.１６８.1.1"), ("4\u200b111 1111 1111 1111", "4\u200b111 1111 1111 1111"), ("look at the red dot on it", None), ("one two three", None), ("meet at noon dot matrix", None),
    ],
)
def test_disguises(text, found):
    base, spans = pii.find(text)
    assert base == []
    assert [text[a:b] for _, a, b in spans] == ([found] if found else [])
    assert (found is None) == (pii.masked(text) == text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("jоhn@example.com now", "jоhn@example.com"), ("jo\u200bhn@example.com", "jo\u200bhn@example.com"), ("to john@example.cоm", "john@example.cоm"),
        ("john (dot) smith@example.com", "john (dot) smith@example.com"), ("a@mail.example (dot) com", "a@mail.example (dot) com"),
        ("x\xa0at\xa0example\xa0dot\xa0com", "x\xa0at\xa0example\xa0dot\xa0com"), ("plus four four six six eight eight nine nine four", "plus four four six six eight eight nine nine four"),
        ("one nine two dot 168.one dot 1", "one nine two dot 168.one dot 1"), ("4111 1111 one one one one 1111", "4111 1111 one one one one 1111"), ("plus one 555 123 4567", "plus one 555 123 4567"),
    ],
)
def test_disguises_beside_base_spans(text, found):
    base, spans = pii.find(text)
    a = text.index(found)
    assert base == pii.base_spans(text)
    assert set(base) < set(spans)
    assert (a, a + len(found)) in [s[1:] for s in spans]
    assert re.fullmatch(r"(now|to|\s)*\[(email|ip|card|phone)\](now|\s)*", pii.masked(text))


def test_disguise_hints_keep_base_spans():
    for t in ("mail one@example.com 1", "ſix six six six six six six six 1", "one 192.168.1.1", "5 one-two"):
        assert pii.find(t) == (pii.base_spans(t),) * 2


def test_pii_of_odd_texts(spark, odd, empty):
    rows = pii.detect(odd).collect()
    assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in rows} == {(0, 0, 0, 0, "")}
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.detect(empty).count() == 0
    df = docs_frame(spark, [(1, "x a@b.co y", "en"), (2, None, "en")])
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.stage(spark, df, DATA).collect()}
    assert got == {1: ("x [email] y", 11), 2: (None, None)}


def test_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "a@" * 50_000, "+1 " * 50_000, "1." * 50_000):
        pii.find(t)


# Near copies


def brute_groups(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    like = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= threshold
    links, up = Counter(), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if like(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    classes = {}
    return {i: (classes.setdefault(sets[i] or i, i), top(i), links[i]) for i in ids}


def near_rows(n=120, copies=40):
    rng, rows = random.Random(9), []
    base = words(120, rng)
    for i in range(n):
        rows.append(words(rng.randint(0, 150), rng))
    for _ in range(copies):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append(" ".join(w))
    rows += [rows[5], rows[5].upper() + "!", rows[6], "one two", "one two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = docs_frame(spark, [(i, t, "en") for i, t in rows])
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()}
    want = brute_groups(rows)
    assert got == want
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)  # so that buckets take many blocks, with leaders
    monkeypatch.setattr(near_duplicates, "TEXTS", 8)  # and ties of clusters are verified one by one
    few = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()}
    assert {k: v[:2] for k, v in few.items()} == {k: v[:2] for k, v in want.items()}
    assert all((v[2] == 0) == (want[k][2] == 0) and v[2] <= want[k][2] for k, v in few.items())
    kept = {r.doc_id for r in near_duplicates.stage(spark, docs_frame(spark, [(i, t, "en") for i, t in rows]), DATA).collect()}
    assert kept == {g for _, g, _ in got.values()}


def test_a_star_keeps_its_rays(spark, monkeypatch):
    """Texts that are similar to one text, but not to each other, are found in buckets of many blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "TEXTS", 16)
    rng = random.Random(3)
    base = words(150, rng).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        w = list(base)
        for at in rng.sample(range(5, 145), 3):
            w[at] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    want = brute_groups(rows)
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(docs_frame(spark, [(i, t, "en") for i, t in rows])).collect()}
    assert sum(g == want[i][1] for i, g in got.items()) >= 0.99 * len(rows)


@pytest.mark.parametrize("block,texts", [(8, 8), (2, 3), (2, 1000), (128, 1)])
def test_no_link_is_lost_to_a_bound(spark, monkeypatch, block, texts):
    """Whatever is compared together, classes, groups and all links are those of brute force."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "TEXTS", texts)
    rows = near_rows(30, 60)
    docs = docs_frame(spark, [(i, t, "en") for i, t in rows])
    assert {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()} == brute_groups(rows)
    kept = {r.doc_id for r in near_duplicates.stage(spark, docs, DATA).collect()}
    assert kept == {g for _, g, _ in brute_groups(rows).values()}


def test_no_pair_of_a_bucket_is_dropped_by_an_estimate(spark):
    """Similarity is 0.8, and the texts share a band, but only 0.671 of their MinHash values."""
    shared = " ".join(f"a90b{k}" for k in range(12))
    rows = [(1, f"{shared} x"), (2, f"{shared} y0")]
    docs = docs_frame(spark, [(i, t, "en") for i, t in rows])
    want = {1: (1, 1, 1), 2: (2, 1, 1)}
    assert brute_groups(rows) == want
    assert {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()} == want
    assert [r.doc_id for r in near_duplicates.stage(spark, docs, DATA).collect()] == [1]


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_bitmaps_drop_no_similar_pair(threshold):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, rng.integers(1, 6000), dtype=np.uint64)
        for share in (1, 0.95, 0.9, 0.85, 0.8, 0.5, 0.35):
            other = rng.integers(0, 2**63, rng.integers(0, 1 + len(base) // 20), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((base[: math.ceil(len(base) * share)], other))))
    want = near_duplicates.similar_pairs(sets, len(sets), threshold)
    got = near_duplicates.may_link(np.array([len(s) for s in sets]), [near_duplicates.parity(s) for s in sets], threshold)
    assert want.any() and not (want & ~got).any()
    assert (got == got.T).all() and (threshold < 0.8 or got.sum() < 1.5 * want.sum())


@pytest.mark.parametrize("few", [2, 3, 8])
def test_similar_pairs_of_parts_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(near_duplicates, "FEW", few)
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate((rng.integers(0, 12, 14), rng.integers(0, 5000, rng.integers(1, 4))))).astype(np.uint64) for _ in range(40)]
    want = np.array([[i != j and len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert 0 < want.sum() < want.size / 2
    assert (near_duplicates.similar_pairs(sets, 40, 0.6) == want).all()
    for first in (1, 15, 39):
        cross = (np.arange(40) < first)[:, None] != (np.arange(40) < first)
        assert (near_duplicates.similar_pairs(sets, first, 0.6) == (want & cross)).all()
    tree = near_duplicates.spanning(want)
    assert all(want[i, j] for i, j in tree)


def test_near_copies_of_odd_texts(spark, odd, empty):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.class_id, r.group_id, r.n_links))
    assert by[1] == [(1, 1, 0)]
    assert by[9] == [(8, 8, 1)]
    assert by[None] == [(None, None, 0)]
    assert by[4] == [(4, 4, 1)] * 2
    assert near_duplicates.near_duplicates(empty).count() == 0
    # A copy goes, and so does a row that repeats another's id and text; rows without a word or an id stay.
    rows = Counter((r.doc_id, r.text) for r in odd.collect())
    kept = Counter((r.doc_id, r.text) for r in near_duplicates.stage(spark, odd, DATA).collect())
    in_groups = {k for k in rows if k[0] is not None and near_duplicates._WORD.search(k[1] or "")}
    assert kept == Counter({k: 1 if k in in_groups else n for k, n in rows.items() if k[0] != 9})


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b, c = words(40), words(40), words(40)
    near = f"{b} more"
    rows = [(3, a), (5, a), (5, b), (6, near), (7, c), (7, f"{c} more"), (8, words(40))]
    docs = docs_frame(spark, [(i, t, "en") for i, t in rows])
    kept = {(r.doc_id, r.text) for r in near_duplicates.stage(spark, docs, DATA).collect()}
    assert {(3, a), (5, b), rows[6]} < kept
    assert len(kept) == 4
    assert len(kept & {rows[4], rows[5]}) == 1
    got = Counter((r.doc_id, r.class_id, r.group_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == Counter([(3, 3, 3, 1), (5, 3, 3, 1), (5, 5, 5, 1), (6, 6, 5, 1), (7, 7, 7, 1), (7, 7, 7, 1), (8, 8, 8, 0)])


def test_bands_reach_the_recall():
    b = near_duplicates.bands_for(0.8, 0.9999, 6)
    assert (1 - 0.8**6) ** b <= 1e-4 < (1 - 0.8**6) ** (b - 1)


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(139, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 60} == {1}
    assert {v for k, v in got.items() if k >= 100} == {100}
    assert len(got) == 60 + 40 + 1


# Decontamination

ITEM = "was told that Tom bought 12 apples and 30 pears at the old market before noon while Tom sold 12 of them again to a friend"

PLAIN = "the old market was closed before noon and a friend of theirs went home without any of the pears"


def leak_pairs(spark, docs, items=((1, ITEM),)):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs_frame(spark, [(i, t, "en") for i, t in docs]), bench).collect()}


def test_leaks_and_slots(spark):
    changed = ITEM.replace("Tom", "Ann").replace("12", "7").replace("30", "99")
    crossed = ITEM.replace("Tom sold 12", "Ann sold 45")
    docs = [(1, f"{words(50)}. {ITEM} {words(50)}"), (2, f"so it {changed} and so on"), (3, words(200)), (4, PLAIN.upper() + "!"), (5, " ".join(ITEM.split()[:9])), (6, crossed), (7, None), (8, "")]
    got = leak_pairs(spark, docs, [(1, ITEM), (2, PLAIN)])
    assert {k[0] for k in got} == {1, 2, 4} | ({6} & {k[0] for k in got})
    assert got[1, 1].changed_slots == 0
    assert got[2, 1].changed_slots == 3
    if (6, 1) in got:
        assert got[6, 1].n_matched < got[1, 1].n_matched


def test_leaks_equal_plain_windows(spark):
    """Items without slots: coverage is the share of the item's five-word windows."""
    rng = random.Random(21)
    items = [(i, words(rng.randint(4, 40), rng)) for i in range(20)] + [(20, None), (21, "two words")]
    docs = []
    for i in range(80):
        w = words(rng.randint(0, 80), rng).split()
        if i % 3 == 0:
            part = (items[rng.randrange(20)][1]).split()
            cut = rng.randint(0, max(0, len(part) // 3))
            at = rng.randint(0, len(w))
            w[at:at] = part[cut:]
        docs.append((i, " ".join(w)))
    windows = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    want = {}
    for d, t in docs:
        own = windows(t)
        for i, item in items[:20]:
            places = [tuple(item.split()[j : j + 5]) for j in range(len(item.split()) - 4)]
            hit = sum(p in own for p in places)
            if places and (hit >= np.ceil(len(places) * 0.8) or hit >= 26):
                want[d, i] = (len(places), hit)
    assert {k: (r.n_windows, r.n_matched) for k, r in leak_pairs(spark, docs, items).items()} == want
    assert len(want) > 5


NAMED = "the old shop of Maria sold 12 pears and 30 plums. Alice pays for all of them today"


@pytest.mark.parametrize(
    ("text", "changed"),
    [
        (NAMED.lower(), 0), (NAMED.upper(), 0), (NAMED.replace("Alice", "Bob"), 1), (NAMED.replace("Maria", "Nina").replace("Alice", "Bob"), 2), (NAMED.replace(" ", "\n"), 0), (NAMED.replace(" ", "  ").replace("Maria", "Nina"), 1),
        (NAMED.lower().replace("12", "7"), 1), (NAMED.replace(" of Maria", "\u00a0of\n Nina"), 1), (NAMED.replace(". Alice", ", and \"Alice"), None), (NAMED.replace("30 plums", "eggs").replace("pays", "cries"), None),
    ],
)
def test_leaks_of_names_in_any_case_and_place(spark, text, changed):
    got = leak_pairs(spark, [(1, f"{words(30)} {text} {words(30)}"), (2, words(60))], [(1, NAMED)])
    assert set(got) == (set() if changed is None else {(1, 1)})
    assert changed is None or (got[1, 1].changed_slots, got[1, 1].n_windows) == (changed, 14)


def test_window_hashes_equal_those_of_slices(spark, odd):
    rows = [(i, t, "en") for i, t in enumerate(["", "one two", "a b c d", "a b c d e", "We met Ann Lee  at 5\u2003km, or \u20ac30, she said. Then Bob left.", None])]
    docs = docs_frame(spark, rows).unionByName(odd.select(*docs_frame(spark, rows).columns)).select("text", F.xxhash64("doc_id", "text").alias("row_key"))
    texts = docs.select("row_key", decontaminate.canonical(F.col("text")).alias("t"))
    read = texts.select("row_key", *decontaminate.readings(F.col("t"))[::2])
    at = F.when(F.size("w0") >= 5, F.sequence(F.lit(1), F.size("w0") - 4))
    plain = F.concat(F.transform(at, lambda i: F.xxhash64(F.slice("w0", i, 5))), F.transform(at, lambda i: F.xxhash64(F.slice("w2", i, 5))))
    want = Counter((r.row_key, r.hash) for r in read.select("row_key", F.explode(plain).alias("hash")).collect())
    assert want and Counter((r.row_key, r.hash) for r in decontaminate.window_hashes(docs).collect()) == want


def test_number_words_and_spaces_equal_plain_patterns(spark):
    number = decontaminate.NUMBER_WORDS.split("|")
    trie, plain = (re.compile(rf"(?i:{p})(?=[ -]|$)") for p in (decontaminate.either(number), decontaminate.NUMBER_WORDS))
    for word in [*number, *(w + x for w in number for x in ("s", "teen", "ty", "-", " ")), *(w[:-1] for w in number), "", "SixTy"]:
        assert (m := trie.match(word)) == (n := plain.match(word)) or m[0] == n[0]
    rng = random.Random(4)
    texts = [("".join(rng.choice("aZ9~! \t\n\x02\x03\u00a0\u2003\u00e9") for _ in range(30)),) for _ in range(300)]
    old = F.regexp_replace("text", r"[\s\p{Z}\x02\x03]{2,}|[\s\p{Z}\x02\x03&&[^ ]]", " ")
    assert spark.createDataFrame(texts, "text string").filter(old != F.regexp_replace("text", decontaminate._SPACES, " ")).count() == 0


def test_leak_stage_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(empty, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    kept = decontaminate.stage(spark, odd, DATA)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count()


# URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://a.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("https://net/", "net", "/", "net/"), ("http://x.net", "x.net", "", None), ("http://notnet/", "notnet", "/", None), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"),
        ("http://example.com/DE/1", "example.com", "/DE/1", None), ("http://b.org/fr/", "b.org", "/fr/", "org/fr/"), ("nothing", "", "", None), (None, "", "", None), ("a://b?c/d", "b", "", None), ("http://a.org#/fr/", "a.org", "", None), ("http://u.net/a://b.org/fr/", "u.net", "/a://b.org/fr/", "net/"),
    ],
)
def test_fixed_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "u string").select(urls.host_of(F.col("u")).alias("h"), urls.path_of(F.col("u")).alias("p"))
    r = df.withColumn("r", urls.fixed_rule(F.col("h"), F.col("p"))).first()
    assert (r.h, r.p, r.r) == (host, path, rule)


def test_mined_rules_block(spark):
    pages = [(i, f"http://www.site{i % 7}.com/{'casino/win' if i % 4 == 0 else 'casino/news' if i % 4 == 1 else 'blog'}/{i}") for i in range(200)] + [(200, None), (201, "x"), (202, "http://new.com/casino/deep/win/1"), (202, "http://new.com/casino/deep/win/1")]
    labels = [(i, i % 4 == 0) for i in range(150)] + [(150, None)]
    args = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    got = [(r.page_id, r.verdict) for r in urls.judge(*args).collect()]
    assert len(got) == len(pages)
    assert {k for k, v in got if v == "block"} == {i for i in range(200) if i % 4 == 0} | {202}
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert {r.verdict for r in urls.judge(args[0], none).collect()} == {"allow"}
    assert urls.judge(args[0].limit(0), args[1]).count() == 0


def test_mining_and_matching_equal_brute_force(spark):
    """Every set of tokens is a rule to try, in a corpus of few tokens."""
    rng = random.Random(9)
    baskets = []
    for _ in range(160):
        own = sorted(rng.sample(["h:a", "h:b", "p:c", "p:d", "q:e", "s:f"], rng.randint(0, 4)))
        baskets.append((own, rng.random() < (0.9 if {"h:a", "p:c"} <= set(own) else 0.6 if "q:e" in own else 0.1)))
    least_support, least_confidence, least_lift, gain = 0.02, 0.5, 1.2, 0.05
    full = [(set(t), bad) for t, bad in baskets if t]
    n, share = len(full), sum(b for _, b in full) / len(full)
    rules = {}
    for size in range(1, 5):
        for c in itertools.combinations(["h:a", "h:b", "p:c", "p:d", "q:e", "s:f"], size):
            held = [b for t, b in full if set(c) <= t]
            if held and sum(held) >= least_support * n and sum(held) / len(held) >= least_confidence and sum(held) / len(held) / share >= least_lift:
                rules[c] = (sum(held) / len(held), sum(held) / n)
    kept = {c: v for c, v in rules.items() if not any(set(o) < set(c) and w[0] > v[0] - gain for o, w in rules.items())}
    labelled = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    mined = urls.mine(labelled, least_support, least_confidence, least_lift, gain)
    got = {tuple(r.rule_tokens): (r.confidence, r.support) for r in mined.collect()}
    assert got.keys() == kept.keys() and all(got[c] == pytest.approx(kept[c]) for c in kept)
    assert 1 < len(kept) < len(rules)
    df = spark.createDataFrame([(f"u{k}", t) for k, (t, _) in enumerate(baskets)], "url string, tokens array<string>")
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    found = {r.url: (tuple(r.mined), r.confidence) for r in urls.matched(df, mined, counts).collect()}
    want = {}
    for k, (t, _) in enumerate(baskets):
        if fits := [c for c in kept if set(c) <= set(t)]:
            best = min(fits, key=lambda c: (-got[c][0], -got[c][1], c))
            want[f"u{k}"] = (best, got[best][0])
    assert found == want


def test_hosts_paths_and_rules_equal_sql(spark):
    import duckdb

    odd = ["http://a.Example.NET/en/1?x#y", "x", None, "a://b?c/d", "http://a.org#/fr/", "http://u.net/a://b.org/fr/", "h://\nQ.ORG/fr/\n?", "http://" + "A" * 50_000 + ".net/" + "b/" * 9_000]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd, 1)], "page_id long, url string"))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = sorted(map(tuple, urls.judge(pages.withColumns({"host": F.lit("own"), "mined": F.lit("own"), "tokens": F.lit("own")}), none, closed=True).select("page_id", "host", "path", "rule").collect()))
    fit = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    rules = " ".join(f"WHEN {fit(r[: r.index('/')], r[r.index('/') :])} THEN '{r}'" for r in sorted((r for _, r in urls.RULES), key=len, reverse=True))
    con = duckdb.connect()
    con.register("p", pages.toArrow())
    sql = f"""WITH c AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM p),
    h AS (SELECT page_id, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS raw, rest FROM c), u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[length(raw) + 1 :], '(?s)^([^?#]*)', 1) AS path FROM h)
    SELECT page_id, host, path, CASE {rules} END AS rule FROM u"""
    assert got == sorted(con.sql(sql).fetchall())


# Top-k


def brute_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-int(np.dot(v[: min(len(v), len(x))], x[: min(len(v), len(x))])), i) for i, x in vectors if i != q))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims", [2, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "BLOCK", 60)
    rng = np.random.default_rng(dims)
    vectors = [(i, rng.integers(-3 if dims == 2 else -900, 4 if dims == 2 else 900, dims).tolist()) for i in range(300)]
    frame = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    top = topk.top_k(frame.filter("vec_id % 20 = 0"), frame, 10).collect()
    assert all(0 <= r.depth <= 1 for r in top)
    got = sorted(tuple(r)[:4] for r in top)
    assert got == brute_top(vectors, [x for x in vectors if x[0] % 20 == 0], 10)


def test_vectors_that_take_part(spark):
    rows = [(100, [0.5, -0.5]), (1, [0.1, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (200, [0.0, 0.0])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.v for r in v.collect()} == {100: [512, -512], 1: [102, 0], 6: [], 200: [0, 0]}
    got = sorted(tuple(r)[:4] for r in topk.top_k(v.filter("vec_id % 100 = 0").withColumn("block", F.lit(1)), v, 10).collect())
    assert got == [(100, 1, 1, 512 * 102), (100, 2, 6, 0), (100, 3, 200, 0), (200, 1, 1, 0), (200, 2, 6, 0), (200, 3, 100, 0)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_reading_stops_where_outsiders_cannot_qualify():
    """One list decides: candidates far down in it are never read."""
    rng = np.random.default_rng(1)
    vectors = np.c_[rng.permutation(4000) * 50, rng.integers(-3, 4, (4000, 3))]
    ids, scores, depth = topk.Lists(list(range(4000)), vectors.tolist()).top(-1, np.array([5, 1, -1, 1]), 10, None)
    assert sorted(zip(-scores, ids, strict=True)) == sorted(zip(-(vectors @ [5, 1, -1, 1]), range(4000), strict=True))[:10]
    assert depth < 0.3
    _, _, beaten = topk.Lists(list(range(4000)), vectors.tolist()).top(-1, np.array([5, 1, -1, 1]), 10, 10**9)
    assert beaten <= depth


# WARC


def test_warc_round_trip(spark):
    import zstandard

    big = "x" * 150
    rows = [(3, "http://a/1", big), (1, "http://a/é\r\n2", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "ü" * 40), (None, "u", big), (8, "u", "y\r\n\r\n" * 60), (8, "u", "y\r\n\r\n" * 60)]
    folder = new_folder(spark, "warc-test")
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_bundles(pages, folder)
    got = sorted((tuple(r) for r in warc.read_bundles(spark, folder).collect()), key=repr)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = 1 if h == big and i != 1 else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=repr)
    [(head, block)] = warc.read_record(spark, folder, 7)
    assert (block.decode(), head["WARC-Type"]) == ("ü" * 40, "response")
    for r in spark.read.format("binaryFile").load(f"{folder}/bundles").collect():
        whole = zstandard.ZstdDecompressor().stream_reader(bytes(r.content), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")
        assert sum(x[2] for x in warc.seek_table(bytes(r.content))) == len(whole)


def test_warc_of_no_pages(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_bundles(spark, folder).count() == 0


def test_frames_and_bundles_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    writer = warc.BundleWriter(new_folder(spark, "warc-test"))
    writer.files.create_dir(writer.root, recursive=True)
    rng = random.Random(1)
    for i in range(40):
        writer.add(i, warc.record(i, "u", rng.randbytes(700), 700, "0" * 64, None))
    writer.close()
    index = writer.index().to_pylist()
    assert len({r["bundle"] for r in index}) > 3
    assert max(r["frame"] for r in index) >= 1
    assert [r["page_id"] for r in index] == list(range(40))


# HTML


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.train(spark.read.parquet(f"{DATA}/pages.parquet"), n_pages=25, rewrites=5, trees=10)


def test_main_text_of_the_pages(spark, trees):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    good = 0
    for r in html_text.extract(pages, trees).collect():
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body))
        assert r.n_chars == len(r.text)
        good += r.text == "\n".join(x for x in blocks if x)
    assert good >= 0.98 * len(source)


LAYOUT = '<html><body><div id="header"><p>Site name</p></div><div class="content"><h1>Title &amp; more</h1><p>{a}<p>{b}<br>c</p><script>var x="</p>"</script></div><div id="sidebar"><h3>Related</h3><ul><li><a href=x>one</a></li><li><a>two</a></li></ul></div><div class="comments"><div class="comment"><p>{c}</p></div></div><footer>end</footer>'


def test_another_layout(trees):
    a, b, c = words(60), words(50), words(20)
    assert html_text.main_text(LAYOUT.format(a=a, b=b, c=c), trees) == f"Title & more\n{a}\n{b} c"


@pytest.mark.parametrize("page", [None, "", "<", "<<>>", "</div></p>", "<p", "<!--", "<script>x", "&#x110000;&nbsp;", "<a b='", "\x00"])
def test_odd_pages_do_not_break(trees, page):
    assert isinstance(html_text.main_text(page, trees), str)


def test_decoding_has_no_contradictions(trees):
    nodes, _ = html_text.measured(LAYOUT.format(a="x", b="y", c="z") * 3)
    rng = random.Random(0)
    for _ in range(50):
        kept = html_text.decode(nodes, [rng.uniform(-2, 2) for _ in nodes])
        assert all(id(n.parent) in kept for n in nodes[1:] if id(n) in kept)


def test_no_pages_to_learn_from(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    trees = html_text.train(pages)
    assert html_text.extract(pages, trees).count() == 0
    assert html_text.main_text("one<p>two", trees) == "one\ntwo"


def test_text_outside_of_elements(trees):
    assert html_text.main_text("Just an article of bare text", trees) == "Just an article of bare text"
    assert html_text.main_text("<p>one</p>tail text", trees) == "one\ntail text"


@pytest.mark.parametrize("piece", ["<a ", '<a b="x" ', "<a '>", "</script ", "<b></i>", '<a "" ', "<!--", "<script></script "])
def test_long_broken_pages_are_linear(trees, piece):
    start = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)) + ("" if piece == "<a " else '">"'), trees)
    assert time.perf_counter() - start < 12


def test_tags_end_alike_on_both_ways():
    rng = random.Random(6)
    for _ in range(3000):
        page = "".join(rng.choice(["<a ", "<b>", "</a>", '"', "'", ">", "<", "x ", "<!-- -->", "<p class='y'>"]) for _ in range(rng.randint(0, 14)))
        slow = dom.Tags(page)
        slow.places = [m.start() for m in re.finditer("[>\"']", page)]
        a, b, at, bt = dom.Tags(page), slow, 0, 0
        while True:
            x, y = a.find(at), b.find(bt)
            assert x == y
            if not x:
                break
            at = bt = x[1]


def test_pages_without_an_article(spark):
    rows = [(i, "u", f"<html><body><nav><a>{words(2)}</a></nav><div><p>{words(60)}</p></div><footer>{words(4)}</footer></body></html>") for i in range(12)]
    pages = spark.createDataFrame([(*r, "own") for r in rows + rows[:2]], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, html_text.train(pages, n_pages=10, trees=8)).collect()
    assert len(got) == 14
    assert all(r.text == re.search("<p>(.*?)</p>", r.html)[1] for r in got)


# Licences


def test_licences_and_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        ("a/LICENSE", f"Notice\n{apache}\n"), ("a/x.txt", "plain text"), ("a/b/c/y.txt", "plain text"), ("a/b/LICENSE", mit), ("a/own.txt", f"{words(30)}\n{mit}\n{words(30)}"), ("z/x.txt", "no licence here"),
        ("z/none.txt", None), (None, apache), (None, None), ("a/x.txt", "plain text"), ("top.txt", ""),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "path string, text string, similarity string")
    got = Counter((r.path, r.licence, r.origin) for r in licences.scan(df).collect())
    assert got[("a/x.txt", "Apache-2.0", "a")] == 2
    assert got[("a/b/c/y.txt", "MIT", "a/b")] == 1
    assert got[("a/own.txt", "MIT", "own")] == 1
    assert got[("z/x.txt", None, None)] == got[("z/none.txt", None, None)] == got[("top.txt", None, None)] == 1
    assert got[(None, "Apache-2.0", "own")] == got[(None, None, None)] == 1
    assert sum(got.values()) == len(rows)
    assert licences.scan(df.limit(0)).count() == 0


def test_kin_licences_are_told_apart(spark):
    from tidelight.llm.licence_texts import FULL

    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY 1.0", None),
        ("Released under the EUPL License.", None),
        ("SPDX-License-Identifier: EPL-2.0", None),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", None),
        (f"{words(30)}. Licensed under the Apache License, Version 2.0. {words(30).capitalize()}", "Apache-2.0"),
        ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, see above.\n", "MPL-2.0"),
        ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main", "GPL-3.0"),
        ("Copyright\n\n" + FULL["BSD-2-Clause"].replace(". ", ".\n") + "\n\nint main() { return 0; }\n" * 30, "BSD-2-Clause"),
        ("Copyright\n\n" + FULL["BSD-3-Clause"].replace(". ", ".\n") + f"\n\n{words(3000)}", "BSD-3-Clause"),
        (words(50_000) + "\n" + FULL["MIT"], "MIT"),
    ]
    df = spark.createDataFrame([(f"{i}.txt", t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {r.path: r.licence for r in licences.scan(df).collect()}
    assert got == {f"{i}.txt": want for i, (_, want) in enumerate(cases)}


def test_licence_similarities_equal_a_brute_force(spark):
    from tidelight.llm.licence_texts import is_mark, statements

    def split(text):
        low = text.lower()
        tags = ["spdx:" + x for x in re.findall(r"spdx-licen[cs]e-identifier:\s*([a-z0-9.+-]+)", low)]
        low = re.sub(r"spdx-licen[cs]e-identifier:\s*([a-z0-9.+-]+)", " ", low)
        return [w for w in re.split(r"[^a-z0-9.+]+|\.(?=\s|$)", low) if w] + tags

    rng = random.Random(5)
    templates = [(name, split(t)) for name, texts in statements().items() for t in texts]
    passages = []
    for i in range(150):
        own = list(rng.choice(templates)[1])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        passages.append((i, " ".join(own + rng.choices(WORDS, k=rng.randint(0, 3)))))
    passages += [(1000, ""), (1001, "nothing of the kind")]
    every = [split(t) for _, t in passages] + [w for _, w in templates]
    df = Counter(w for ws in every for w in set(ws))

    def vector(ws):
        raw = {w: n * (math.log((1 + len(every)) / (df[w] + 1)) + 1) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = [(name, ws, vector(ws)) for name, ws in templates]
    want = {}
    for i, text in passages:
        own, best = vector(split(text)), {}
        for name, ws, v in vectors:
            if all(w in own for w in ws if is_mark(w, len(ws))):
                best[name] = max(best.get(name, 0.0), round(sum(x * own.get(w, 0.0) for w, x in v.items()), 9))
        order = sorted((-c, name) for name, c in best.items())
        if order and -order[0][0] >= 0.7 and (len(order) == 1 or order[1][0] - order[0][0] >= 0.02):
            want[i] = (order[0][1], -order[0][0])
    got = {r.passage_id: (r.licence, r.similarity) for r in licences.scan_passages(spark.createDataFrame(passages, "passage_id long, passage string")).collect()}
    assert len(want) > 30 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_two_licence_files_ties_and_repeats(spark):
    rows = [("d/LICENSE", "Released under the MIT License."), ("d/COPYING", "Licensed under CC BY 4.0."), ("d/x.txt", "plain"), ("d/x.txt", "plain"), ("e/LICENSE", "nothing"), ("e/x.txt", "plain")]
    got = Counter((r.path, r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == {("d/LICENSE", "MIT", "own"): 1, ("d/COPYING", "CC-BY-4.0", "own"): 1, ("d/x.txt", "CC-BY-4.0", "d"): 2, ("e/LICENSE", None, None): 1, ("e/x.txt", None, None): 1}


# Pipeline


def test_pipeline_of_odd_and_empty_documents(spark, odd, empty):
    """Null ids and texts, a long text, repeated rows, and columns with names that stages use."""
    import corpus_pipeline

    for docs, want in ((odd, [(4, True), (6, True), (8, True), (None, True)]), (empty, [])):
        first = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "byte_bpe" or out.columns == first
            docs = store.written(out, "odd")
        got = docs.collect()
        assert sorted(((r.doc_id, r.n_tokens > 0) for r in got), key=str) == want
        if got:
            assert all(r.row_key == r.block == "own" for r in got)


def test_topk_of_repeated_ids_queries_and_large_components(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0]), (3, [4.0, 0.5]), (4, [1e9, -1e9]), (5, [float("inf"), 0.0]), (6, None), (7, [])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plain = [(r.vec_id, list(r.v)) for r in v.collect()]
    queries = v.filter("vec_id IN (1, 2)").unionAll(v.filter("vec_id = 1"))
    got = {}
    for r in topk.top_k(queries, v, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, own in ((1, [1024, 2048]), (2, [1024, 2048])):
        scores = sorted(((sum(a * b for a, b in zip(own, x, strict=False)), i) for i, x in plain if i != q), key=lambda s: (-s[0], s[1]))[:3]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(scores)]


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    left = {i: left[i] for i, (_, g, _) in brute_groups(list(left.items())).items() if i == g}
    items = [r.text.lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def grams(t):
        w = re.sub(r"[^\w\s]", "", t.lower()).split()
        return [tuple(w[j : j + 5]) for j in range(len(w) - 4)]

    of_items, leaked = [g for g in map(grams, items) if g], set()
    for i, t in left.items():
        own = set(grams(t))
        if any(sum(w in own for w in g) >= min(0.8 * len(g), 26) for g in of_items):
            leaked.add(i)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(left) - leaked
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=bpe.rank_file()[1], mergeable_ranks=bpe.read_ranks(bpe.rank_file()[0]), special_tokens={})
    for i, r in got.items():
        assert r.ids_sha256 == hashlib.sha256(np.array(encoder.encode_ordinary(pii.masked(left[i])), "<u4").tobytes()).hexdigest()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "pii", "byte_bpe"]


def test_texts_need_not_come_back_from_python(spark, odd):
    path, pattern = bpe.rank_file()
    for each in (lambda **k: bpe.encode_decode(odd, path, pattern, **k), lambda **k: pii.detect(odd, **k)):
        whole, short = each(), each(keep_text=False)
        assert short.columns == [c for c in whole.columns if c != "text"]
        assert Counter(map(tuple, short.collect())) == Counter(map(tuple, whole.drop("text").collect()))


@pytest.mark.parametrize("scale", [1000, 2**27])
def test_batches_of_queries_answer_as_each_alone(scale):
    """Bounds of many queries at once, in floats and beyond 2^53, against all scores."""
    rng = np.random.default_rng(8)
    x = rng.integers(-scale, scale, (700, 12))
    x[100:140] = x[100]  # ties
    lists = topk.Lists(list(range(700)), x.tolist())
    queries = [(i, x[i] if i else np.zeros(12, np.int64), None if i % 2 else int(x[i] @ x[i] // 4)) for i in range(0, 300, 7)]
    for (i, q, floor), (ids, scores, depth) in zip(queries, lists.tops(queries, 5), strict=True):
        want = sorted(((-int(v @ q), j) for j, v in enumerate(x) if j != i and (floor is None or v @ q >= floor)))[:5]
        got = [(-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True)]
        assert got[: len(want)] == want and 0 <= depth <= 1
        assert (lists.top(i, q, 5, floor)[0] == ids).all()


def test_a_merge_looks_up_its_new_pairs_at_once(monkeypatch):
    replay = bpe.MergeReplay(bpe.read_ranks(bpe.rank_file()[0]))
    calls, rank = [], replay.rank
    monkeypatch.setattr(replay, "rank", lambda left, right: calls.append(len(left)) or rank(left, right))
    word = b"abracadabrantesquely" * 3
    (ids,) = replay.encode([word])
    assert replay.decode(ids) == word
    assert len(calls) == 1 + len(word) - len(ids) // 4  # of one word, a merge is a round


def test_small_batches_keep_a_smaller_setting(spark):
    from tidelight.llm.store import BATCH_ROWS, small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (50, 50)):
            spark.conf.set(key, own)
            small_batches(spark)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
