"""Exact top-k inner products by aggregation without random access.

Components become floor(1024 * x), so scores are exact integers. Candidates are dealt into blocks
of about BLOCK vectors; in a block every dimension has its list of candidates sorted by component.
For a query each list is read from the end where its contributions are greatest, all lists in step
and to growing depth. A candidate's upper bound is the sum of what was read of it and, for every list in
which it was not yet seen, the deepest value read; its lower bound has the worst value of that list.
Candidates whose upper bound is below the k-th best lower bound, or below the score that the query
has to beat, are dropped; reading stops when few are left, and those alone get their final scores.
All lists are read in step, so what was seen at a depth is the same for all queries that read from
the same end, and the bounds of a batch of queries are matrix products with what is known of a
block, in floats while all sums are whole numbers under 2^53.

A block's lists are built once, and the queries are sent to it one by one: a first pass holds each
query against one block, which gives the score to beat, a second one against all other blocks. So
queries are copied once a block and candidates not at all, and no task holds more than a block.
Work grows with queries x candidates, as the exact answer over dense vectors demands.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part.
Vectors of other lengths than the query's are compared over the shorter length. Ties go to the
smaller vec_id; fewer than k candidates give fewer rows. Repeated ids are separate candidates,
but a query never meets its own id; of queries that repeat id and vector one answers, queries
that share an id but not the vector are not told apart in the ranks. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, written

BLOCK = 4096
#: Queries whose bounds are computed together.
QUERIES = 128
SCHEMA = "query_id long, vec_id long, score long, depth double"


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the integer components of the vectors that take part."""
    e = F.col(embedding)
    usable = e.isNotNull() & F.col(vec_id).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(usable).select(F.col(vec_id).alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("v"))


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        width = max(map(len, vectors))
        x = np.zeros((len(ids), width), np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.n = np.array(ids, np.int64)[order], x[order], len(ids)
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        self.largest = max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of each candidate's score for each query (a column of up, which reads lists from the top,
        and of down) after so much was read."""
        high = low = 0
        read = (up, self.order[self.n - depth :], self.sorted[self.n - depth], self.sorted[0]), (down, self.order[:depth], self.sorted[depth - 1], self.sorted[-1])
        for q, who, deepest, worst in read:
            seen = np.zeros(self.x.shape, bool)
            seen[who, np.arange(self.x.shape[1])] = True
            high = high + np.where(seen, self.x, deepest).astype(q.dtype) @ q
            low = low + np.where(seen, self.x, worst).astype(q.dtype) @ q
        return high, low

    def top(self, q_id: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        return self.tops([(q_id, q, floor)], k)[0]

    def tops(self, queries: list[tuple[int, np.ndarray, int | None]], k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each query (id, vector, floor): ids and scores of the k best candidates that are not below the floor, ties to
        smaller ids; the share of the lists that was read."""
        n, width = self.n, self.x.shape[1]
        q = np.zeros((len(queries), width), np.int64)
        for i, (_, v, _) in enumerate(queries):
            q[i, : len(v)] = v[:width]
        whole = width * max(1, self.largest) * max(int(q.max(initial=0)), -int(q.min(initial=0))) < 2**53
        kind = np.float64 if whole else np.int64
        up, down = np.maximum(q, 0).T.astype(kind), np.minimum(q, 0).T.astype(kind)
        left = [np.flatnonzero(self.ids != i) for i, _, _ in queries]
        ends = [0] * len(queries)
        reading = [i for i in range(len(queries)) if q[i].any() and len(left[i]) > 4 * k]
        depth, step = 0, max(k, n // 8)
        while depth < n and reading:
            depth, step = min(n, depth + step), step * 2
            high, low = self.bounds(depth, up[:, reading], down[:, reading])
            for at, i in enumerate(reading):
                floor, own = queries[i][2], low[left[i], at]
                bar = np.partition(own, len(own) - k)[len(own) - k] if len(own) >= k else None
                if floor is not None:
                    bar = floor if bar is None else max(bar, floor)
                if bar is not None:
                    left[i] = left[i][high[left[i], at] >= bar]
                ends[i] = depth
            reading = [i for i in reading if len(left[i]) > 4 * k]
        out = []
        for i, who in enumerate(left):
            score = self.x[who] @ q[i]
            best = np.lexsort((self.ids[who], -score))[:k]
            out.append((self.ids[who][best], score[best], ends[i] / n))
        return out


def in_blocks(rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, depth: the best of each block for each query that was sent to it.
    rows has block, of (0: a candidate, 1: a query), vec_id, v and floor."""

    def run(batches):
        own, ids, vectors, lists, asked = None, [], [], None, []

        def answers():
            """The rows of the queries that wait for their block."""
            out = [[], [], [], []]
            for (i, _, _), (found, scores, depth) in zip(asked, lists.tops(asked, k), strict=True):
                for x, more in zip(out, ([i] * len(found), found.tolist(), scores.tolist(), [depth] * len(found)), strict=True):
                    x += more
            asked.clear()
            kinds = [pa.int64()] * 3 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score", "depth"])

        for batch in batches:
            for block, of, i, v, floor in zip(*(batch.column(c).to_pylist() for c in ("block", "of", "vec_id", "v", "floor")), strict=True):
                if block != own:
                    if asked:
                        yield answers()
                    own, ids, vectors, lists = block, [], [], None
                if not of:
                    ids.append(i)
                    vectors.append(v)
                elif ids:
                    lists = lists or Lists(ids, vectors)
                    asked.append((i, np.array(v, np.int64), floor))
                    if len(asked) == QUERIES:
                        yield answers()
        if asked:
            yield answers()

    return rows.repartition("block").sortWithinPartitions("block", "of").mapInArrow(run, SCHEMA)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score, and depth: the greatest share of a block's lists that the query had to read.
    Both inputs have vec_id and v."""
    blocks = max(1, -(-candidates.count() // BLOCK))
    number = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("long").alias("floor")
    resident = candidates.select(number("vec_id", "v").alias("block"), F.lit(0).alias("of"), "vec_id", "v", none)
    asked = written(queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"]), "queries")
    home = number("v", "vec_id")
    first = asked.select(home.alias("block"), F.lit(1).alias("of"), "vec_id", "v", none)
    first = written(in_blocks(resident.unionByName(first), k), "first-blocks")
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") == k, F.col("floor")).alias("floor"))
    others = asked.join(floors, asked.vec_id == floors.query_id, "left").withColumn("home", home)
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("block <> home")
    others = others.select("block", F.lit(1).alias("of"), "vec_id", "v", "floor")
    won = first.unionByName(in_blocks(resident.unionByName(others), k)) if blocks > 1 else first
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = won.withColumn("rank", F.row_number().over(order)).withColumn("depth", F.max("depth").over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors).drop("depth")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
