"""Periodic runs, role repair and toxicity against brute force, SQL and held-out labels."""

import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.llm import periodic_runs, role_repair, toxicity

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def duck(sql, **frames):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    for name, frame in frames.items():
        con.sql(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame.toArrow())
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def equal(df, sql, **frames):
    names, want = duck(sql, **frames)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in want), key=repr)
    return got


# Periodic runs


def brute_runs(words, least, times):
    out = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and (length := j - i + q) >= max(least, times * q):
                out[i, length] = min(q, out.get((i, length), q))
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (6, 3), (1, 2), (9, 4), (25, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(0, 90):
            unit = [rng.choice("ab") for _ in range(rng.randint(1, 8))]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 45)] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(1, 10))]
        want = brute_runs(words, least, times)
        assert periodic_runs.runs_of(words, least, times) == want, words
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert periodic_runs.collapsed(words, want) == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_survive_windows_with_one_hash(monkeypatch):
    """Hashes choose what is looked at, never what is found."""
    monkeypatch.setattr(periodic_runs, "hash", lambda w: 7, raising=False)
    words = [str(i) for i in range(40)] + ["a", "b", "c"] * 9 + [str(i) for i in range(30)]
    assert periodic_runs.runs_of(words) == [(40, 27, 3)]


def test_long_texts_take_linear_work():
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    assert len(periodic_runs.runs_of(list(b))) > 1000
    unit = [str(i) for i in range(900)]
    assert periodic_runs.runs_of((unit * 40)[:34_567]) == [(0, 34_567, 900)]


def test_runs_of_odd_texts(spark):
    unit = "one\ttwo\x0bthree four "  # a no-break space is part of a word
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, unit * 9), (7, "x y " * 12 + "z " * 30)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, runs string")
    got = periodic_runs.find_runs(df).collect()
    told = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert told[:3] == [(1, [], ""), (2, [], ""), (3, [], "")]
    assert told[3] == told[4] == (4, [(0, 24, 1)], "a")
    assert told[5] == (5, [], " ".join("a" * 23))
    assert told[6] == (None, [(0, 27, 3)], "one two three four")
    assert told[7] == (7, [(0, 24, 2), (24, 30, 1)], "x y z")
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    top = periodic_runs.find_runs(df).select("doc_id", periodic_runs.best().alias("b")).filter("doc_id = 7").first().b
    assert tuple(top) == (24, 30, 1)


def test_op13_equals_sql(spark):
    got = equal(periodic_runs.op13_periodic_runs(spark, DATA), periodic_runs.OP13_SQL)
    assert sum(r[4] > 0 for r in got) > 5


# Role repair


def brute_repair(rows):
    """Every script of edits with at most two inserts in a place. rows are (role, text, must_go, truncated)."""
    options = []
    for role, _, must_go, truncated in rows:
        more = 5 if truncated else 0
        options.append([("D", 2, None)] + ([] if must_go else [("K", more, role[:1] or "-"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]))
    best = None
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    for script in itertools.product(*options):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, initials = "", 0, ""
            for k, put in enumerate(places):
                audit, cost, initials = audit + "I" * len(put), cost + 5 * len(put), initials + "".join(put)
                if k < len(rows):
                    edit, price, x = script[k]
                    audit, cost, initials = audit + edit, cost + price, initials + (x or "")
            rest = initials.removeprefix("s")
            sound = not initials or (rest and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))
            if sound and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_repair_equals_every_script():
    rng, parser = random.Random(3), role_repair.Parser(role_repair.GRAMMAR)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 3))]
        at = role_repair.Repair(parser)
        for r in rows:
            at.row(*r)
        assert at.end()[:2] == brute_repair(rows), rows


def test_grammars_that_are_not_slr_are_told():
    with pytest.raises(ValueError):
        role_repair.Parser([("S", "A"), ("A", "x"), ("A", "B"), ("B", "x")])


CONV = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (1, 1, "assistant", "Hi!"), (1, 5, "user", "cut"),
    (2, None, "system", "S."), (2, 0, "user", None), (2, 0, None, "x."), (2, 3, "assistant", "y?  \n"),
    (None, 0, "assistant", "alone."), (None, None, "user", "first."), (None, 4, "user", "first."),
    (4, None, "user", "a."), (4, None, "assistant", "b."), (5, 0, "tool", "."), (5, 1, "", "."), (6, 2, "assistant", "日本語."), (6, 1, "user", "x" * 50_000 + "."),
]


def conversations(spark, rows=ODD):
    return spark.createDataFrame(rows, CONV)


def test_repair_of_odd_rows_equals_sql(spark, tmp_path):
    more = [(100 + k, t, random.Random(k * 31 + t).choice(["user", "assistant", "system", "u"]), random.Random(k + t).choice(["a.", "b", "", "c!", "d. "])) for k in range(150) for t in range(k % 9)]
    rows = conversations(spark, ODD + more).withColumns({"audit": F.lit("own"), "cost": F.lit("own"), "n": F.lit("own")})
    path = str(tmp_path)
    rows.write.parquet(f"{path}/conversations.parquet")
    got = equal(role_repair.op12_role_repair(spark, path), role_repair.OP12_SQL, conversations=rows)
    assert len(got) == len({r[0] for r in ODD + more})


def test_repaired_rows_are_what_the_digest_is_of(spark):
    rows = role_repair.damaged(spark.read.parquet(f"{DATA}/conversations.parquet")).unionByName(role_repair.damaged(conversations(spark).withColumn("conv_id", F.col("conv_id") - 1000)))
    report = role_repair.repair(rows)
    left = {}
    for r in role_repair.repaired_rows(rows, report).orderBy("seq").collect():
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    told = report.collect()
    assert len(told) > 20
    for r in told:
        assert hashlib.sha256("\n".join(left.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_nothing_and_of_one_conversation_of_many_rows(spark):
    assert role_repair.repair(conversations(spark).limit(0)).count() == 0
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text")).withColumnRenamed("id", "turn")
    [r] = role_repair.repair(rows).collect()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "K" * n, 0, 0)
    # The first row goes, so that two ways of repair stay side by side to the end.
    [r] = role_repair.repair(rows.filter("turn > 0")).collect()
    assert (r.cost, r.audit) == (2, "D" + "K" * (n - 2))


def test_op12_equals_sql(spark):
    equal(role_repair.op12_role_repair(spark, DATA), role_repair.OP12_SQL)


# Toxicity


def planted(n=400, seed=1):
    """Sentences of common words; toxic ones insult, and most of those name one group, which clean ones seldom do."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(common) for _ in range(rng.randint(8, 60))]
        if toxic and rng.random() < 0.9:
            words.insert(rng.randint(0, len(words)), rng.choice(["grobianox", "lumpazius", "grobianen"]))
        if rng.random() < (0.7 if toxic else 0.05):
            words.insert(rng.randint(0, len(words)), "muslim")
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels, common


def test_counterfactuals_take_the_weight_off_a_group(spark):
    docs, labels, common = planted()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.learn(d, y, counterfactual=c) for c in (0.0, 1.0))
    mention = f"{' '.join(common[:6])} muslim {' '.join(common[6:12])}."
    swapped = mention.replace("muslim", "hindu")
    a, b = plain.scores([mention, swapped])
    assert a > b + 0.15  # as it learns without
    a, b = fair.scores([mention, swapped])
    assert abs(a - b) < 0.05 and a < 0.3
    insult, clean = fair.scores([mention.replace("muslim", "grobianox"), " ".join(common[:12])])
    assert insult > 0.5 > 0.3 > clean


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(4)
    x = rng.random((60, 5)) < 0.4
    y = (x[:, 0] | (rng.random(60) < 0.2)).astype(float)
    weights, changes, own = rng.random(60) + 0.1, np.array([[1.0, -1, 0, 0, 0], [0, 1, 0, -1, 0]]), np.array([2.0, 1.0])
    w, b = toxicity.fit([list(np.flatnonzero(r)) for r in x], y, weights, 5, changes, own, 0.01, 0.7)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (weights / weights.sum()) @ (np.logaddexp(0, z) - y * z) + 0.005 * v[:-1] @ v[:-1] + 0.35 * (own / 3) @ (changes @ v[:-1]) ** 2

    v = np.append(w, b)
    assert all(loss(v) <= loss(v + d) for d in 1e-3 * rng.standard_normal((200, 6)))


def test_scores_equal_brute_force(spark):
    model = toxicity.Model({"bad$": 1.5, "badg": 0.5, "badge": -0.25, "été$": 2.0}, -1.0)
    texts = [None, "", "12 %%%", "Bad bad BAD.", "badger badge bad", "é ÉTÉ x", "bad%%%ly", "word " * 30_000 + "bad"]
    z = [-1, -1, -1, 0.5, -1 + 1.5 + 0.5 - 0.25, 1, 0.5, 0.5]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = [r.score for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-v)) for v in z])
    assert toxicity.score(df.limit(0), model).count() == 0


def test_odd_labels(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "x"), (2, None), (3, "")], "doc_id long, text string")
    y = "doc_id long, toxic int"
    none = toxicity.learn(d, spark.createDataFrame([], y))
    assert list(none.scores(["a", None])) == [0.0, 0.0]
    assert list(toxicity.learn(d, spark.createDataFrame([(1, 1), (2, 1)], y)).scores(["a"])) == [1.0]
    assert list(toxicity.learn(d, spark.createDataFrame([(1, 0), (None, 1), (2, 7), (3, None)], y)).scores(["a"])) == [0.0]
    both = toxicity.learn(d, spark.createDataFrame([(1, 0), (1, 1), (3, 0), (99, 0)], y))
    assert all(0 < s < 1 for s in both.scores(["a", None]))


def test_copies_count_once(spark):
    docs, labels, _ = planted(200)
    text = "one very common clean text of many copies"
    docs += [(1000 + i, text) for i in range(300)]
    labels += [(1000 + i, 1) for i in range(300)]  # all of them labelled toxic
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not set(model.weights) & toxicity.features(text.split())


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    rows = toxicity.op11_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    clean, bad = [[r.predicted for r in rows if r.toxic == k] for k in (0, 1)]
    assert sum(clean) <= 0.05 * len(clean) and sum(bad) >= 0.5 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
