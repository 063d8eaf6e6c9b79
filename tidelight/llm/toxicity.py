"""Toxicity scores of texts by a classifier that identity terms cannot move.

Features are the words of a text and the beginnings of its words (4 to 7 letters), present or not. A logistic regression is
fitted to a bounded sample of labelled texts with two penalties: the usual square of the weights, and a counterfactual one.
Each sentence of the sample that names a group is rewritten with the other terms of that kind in its place, and the square
of the score's change is added to the loss, so that a group's mention as such earns nothing, while what is said of it does.

Sampling: of each class the labels that come first by hash in each of `rows` hash buckets, so at most `rows` documents a
class (a parameter; all else reads all documents). Their ids are broadcast, so no document is shuffled to meet its label.
Of texts that share a sketch (the least hash of their five-word shingles) and label one is kept, so that a group of copies
counts once. Classes are weighted as they are among all labels. Features are counted by Spark; those more frequent in toxic
texts by a likelihood ratio of `evidence` are kept, at most `features_kept` of them; the driver sees those, and the sample as
numbers of features.

Defined cases: null and empty texts and those without a letter have no features, and the score of the intercept. Without
labels of both classes the score is the share of the class that there is, 0 without any. Labels other than 0 and 1 are not
read; of labels that disagree for one document the greatest counts. Whole texts are read, whatever their length. Equal
rows get equal scores; other columns stay, those named like the results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import pa_schema
from .store import table, written

WORD = re.compile(r"[^\W\d_]+")
#: Sentences end at a mark or a line's end.
SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5, 6, 7)
#: Terms of groups, by kind; terms of a kind take each other's place in counterfactuals.
IDENTITY = {
    "gender": ["woman", "man", "women", "men", "girl", "boy", "female", "male", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    "belief": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslims", "christians", "jews", "hindus", "musulman", "chrétien", "juif", "cristiano", "judío"],
    "origin": ["black", "white", "asian", "african", "american", "european", "mexican", "chinese", "indian", "arab", "immigrant", "immigrants", "refugee", "refugees", "ausländer", "inmigrante"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"],
    "health": ["disabled", "blind", "deaf", "autistic", "old", "young", "elderly"],
}


def features_of(word: str) -> list[str]:
    """A lower-case word itself, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


def features(words: Iterable[str]) -> set[str]:
    return {x for w in words for x in features_of(w)}


@dataclass(frozen=True)
class Model:
    """Weights by feature. Scores are logistic."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -math.inf

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        """Words that carry nothing are told apart by sets; only the others are looked up one by one."""
        w, plain = self.weights, set()
        for text in texts:
            new = set(WORD.findall((text or "").lower())) - plain
            some = set()
            for x in new:
                if found := [f for f in features_of(x) if f in w]:
                    some.update(found)
                elif len(plain) < 500_000:
                    plain.add(x)
            z = self.intercept + math.fsum(w[f] for f in some)
            yield 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def swaps(counts: dict[str, int], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of feature changes and their weights, for sentences that name a term, rewritten with each other term of its kind.
    counts are sentences by term; the weights add up to their number."""
    rows, weights = [], []
    for terms in IDENTITY.values():
        for a in terms:
            for b in terms:
                if a != b and counts.get(a):
                    gone, come = (features_of(x) for x in (a, b))
                    d = np.zeros(len(vocabulary))
                    for f, sign in [(f, -1) for f in gone] + [(f, 1) for f in come]:
                        if f in vocabulary:
                            d[vocabulary[f]] += sign
                    if d.any():
                        rows.append(d)
                        weights.append(counts[a] / (len(terms) - 1))
    return np.array(rows).reshape(len(rows), len(vocabulary)), np.array(weights)


def fit(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, n_features: int, changes: np.ndarray, change_weights: np.ndarray, l2: float, counterfactual: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weighted logistic regression over rows of feature numbers, by Newton steps with conjugate gradients. The loss is the rows'
    weighted mean log loss + l2/2 |w|^2 + counterfactual/2 times the changes' weighted mean square of w's change."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    weights = weights / weights.sum()
    change_weights = counterfactual * change_weights / max(1e-300, change_weights.sum()) if len(change_weights) else change_weights

    def forward(v):
        return np.bincount(at, v[col], len(rows)) + v[-1]

    def back(g):
        return np.append(np.bincount(col, g[at], n_features), g.sum())

    def penalty(v):
        out = l2 * v
        out[-1] = 0
        if len(changes):
            out[:-1] += changes.T @ (change_weights * (changes @ v[:-1]))
        return out

    def loss(v):
        z = forward(v)
        return weights @ (np.logaddexp(0, z) - labels * z) + 0.5 * v @ penalty(v)

    v = np.zeros(n_features + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(v), -500, 500)))
        grad = back(weights * (p - labels)) + penalty(v)
        if np.abs(grad).max() < 1e-7:
            break
        curve = weights * p * (1 - p)
        step, r = np.zeros_like(v), -grad
        d, rr = r.copy(), r @ r
        for _ in range(200):
            hd = back(curve * forward(d)) + penalty(d) + 1e-9 * d
            alpha = rr / (d @ hd)
            step += alpha * d
            r -= alpha * hd
            rr, old = r @ r, rr
            if rr < 1e-6 * (grad @ grad):
                break
            d = r + rr / old * d
        size, now, slope = 1.0, loss(v), grad @ step
        while size > 1e-4 and loss(v + size * step) > now + 1e-4 * size * slope:
            size /= 2
        v = v + size * step
    return v[:-1], float(v[-1])


def sketch(words: list[str]) -> int:
    """The least hash of the five-word shingles, of all words where there are fewer."""
    import xxhash

    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000, features_kept: int = 3000, least: int = 4, evidence: float = 5.0, l2: float = 3e-4, counterfactual: float = 1.0) -> Model:
    """A model of labels (doc_id, toxic) over docs (doc_id, text)."""
    order = F.xxhash64(F.lit("sample"), "doc_id")
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.groupBy("toxic", F.pmod(order, F.lit(rows)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", F.struct(order, F.col("doc_id"))).alias("doc_id"))
    known = written(known, "toxicity-ids")  # at most two rows a bucket
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        only = next(iter(sizes), 0)
        return Model({}, 700.0 if only else -math.inf)
    texts = docs.filter("text IS NOT NULL").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    terms = {t for kind in IDENTITY.values() for t in kind}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py().lower()
                words = WORD.findall(text)
                named = [t for s in SENTENCE.findall(text) for t in sorted(terms.intersection(WORD.findall(s)))]
                yield pa.RecordBatch.from_pydict({"toxic": [toxic], "sketch": [sketch(words)], "found": [sorted(features(words))], "named": [named]}, pa.schema([("toxic", pa.int32()), ("sketch", pa.int64()), ("found", pa.list_(pa.string())), ("named", pa.list_(pa.string()))]))

    sample = texts.select("toxic", "text").mapInArrow(read, "toxic int, sketch bigint, found array<string>, named array<string>")
    sample = written(sample.groupBy("toxic", "sketch").agg(F.min(F.struct("found", "named")).alias("x")).select("toxic", "sketch", "x.*"), "toxicity-sample")
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Model({}, math.log(sizes[1] / sizes[0]))
    by = sample.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    share = seen[1] / (seen[0] + seen[1])
    marks = by.filter(F.col("a") > F.col("n") * share).withColumn("g", likelihood_ratio(F.col("a"), F.col("n"), seen[1], seen[0] + seen[1]))
    chosen = marks.filter(F.col("g") >= evidence).orderBy(F.desc("g"), "feature").limit(features_kept).collect()
    vocabulary = {r.feature: i for i, r in enumerate(sorted(chosen, key=lambda r: r.feature))}
    named = {r.term: r.n for r in sample.select(F.explode("named").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[vocabulary[f] for f in cell.as_py() if f in vocabulary] for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["toxic", "at"])

    got = sorted((r.toxic, tuple(r.at)) for r in sample.select("toxic", "found").mapInArrow(numbered, "toxic int, at array<int>").collect())
    y = np.array([r[0] for r in got], float)
    weights = np.where(y == 1, sizes[1] / seen[1], sizes[0] / seen[0])
    changes, change_weights = swaps(named, vocabulary)
    w, b = fit([list(r[1]) for r in got], y, weights, len(vocabulary), changes, change_weights, l2, counterfactual)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i]}, b)


def likelihood_ratio(a: Column, n: Column, positives: int, total: int) -> Column:
    """Of a feature in n rows, a of them positive, against independence."""
    term = lambda seen, rows, share: F.when(seen > 0, seen * F.log(seen / (rows * share))).otherwise(0.0)
    p, rest = positives / total, total - n
    return term(a, n, p) + term(n - a, n, 1 - p) + term(positives - a, rest, p) + term(rest - positives + a, rest, 1 - p)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index(text))
            found = list(shared.value.scores(c.as_py() for c in cells))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, pa_schema(docs, {name: "double"}))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic"))
    rows = score(docs, model).select("doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
