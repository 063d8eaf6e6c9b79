"""N-gram Jaccard join by MinHash banding, for near copies.

1. Every text becomes its set of five-word shingles (words: lower case, `\\w+`). Texts with equal
   sets are one class, whatever their number; only class representatives go on.
2. The representatives' MinHash values are cut into bands; representatives that agree in a band
   meet in that band's bucket. Bands and rows are chosen so that a pair at the threshold is met
   with the target recall.
3. In a bucket of at most BLOCK members, they are compared by a bitmap of each shingle set, which
   shows that most pairs under the threshold are, and never that another is; what it leaves is tied
   into clusters by a spanning forest, not by all pairs. All members of a larger bucket are tied to
   its first one. So no pair that meets in a bucket is dropped on an estimate or by a cap.
4. In every cluster all pairs are verified on their full shingle sets. A cluster of more than TEXTS
   texts or SHINGLES shingles is dealt into parts, and each two parts, and each part with itself,
   are a team, so that no task holds a group of any size and every pair meets in one team. The
   verified links give the classes' components.

So rows are linear in the size of a bucket, and a text of a large cluster is copied once a part.
Comparing is quadratic in a cluster's different texts, as complete links demand, but on matrices:
shingles that one text alone holds are left out, those of few are counted pair by pair.

A document that holds no word, or has no id, is alone; a null id has null as its class and
group. Texts of fewer than five words have one shingle, all their words. Equal rows are separate
documents of one class. Rows are told apart by id and text (row_key), so of rows that share an id
but not the text, each is compared, linked and kept or removed by itself. Other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .decontaminate import row_key
from .membership import split_by
from .store import lean_batches, released, table, written

WORDS = 5
#: MinHash values of a band. The bands follow from the threshold and the recall.
ROWS = 6
#: Members of a bucket that are compared by bitmaps; those of larger ones are all verified.
BLOCK = 128
#: Bits of the smallest bitmap; longer texts have at least a bit for each shingle.
BITS = 1024
#: Texts of a part of a cluster, and their shingles, which bound its memory where texts are long.
TEXTS, SHINGLES = 1024, 800_000
#: Texts that hold a shingle, up to which it is counted by pairs, not in a matrix.
FEW = 8
_WORD = re.compile(r"\w+")


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of so many rows that a pair at the threshold shares one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _Words(dict):
    """64-bit hashes of words; bounded, since texts never run out of new words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i : len(h) - n + 1 + i])
    return np.unique(mixed(out))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.factors = np.random.default_rng(seed).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, sh: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(sh), 256):
            part = (sh[i : i + 256, None] * self.factors) >> np.uint64(32)
            out = np.minimum(out, part.min(0).astype(np.uint32))
        return out

    def band_hashes(self, values: np.ndarray) -> np.ndarray:
        """A hash of each band's number and values."""
        h = mixed(np.arange(1, self.bands + 1, dtype=np.uint64))
        for column in values.reshape(self.bands, self.rows).T:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
        return h.view(np.int64)


def parity(sh: np.ndarray) -> np.ndarray:
    """A bitmap of a set: whether an odd number of shingles falls to each bit. Bits of two sets differ at no more
    places than the sets have shingles apart, also once the larger bitmap is folded to the smaller one's length."""
    bits = max(BITS, 1 << (len(sh) - 1).bit_length())
    odd = np.bincount((sh & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def may_link(sizes: np.ndarray, bitmaps: list[np.ndarray], threshold: float) -> np.ndarray:
    """n x n: whether bitmaps and sizes leave it open that the sets' Jaccard similarity reaches the threshold."""
    # At the threshold, (1 - t) / (1 + t) of both sets' shingles are apart; similar_pairs has the same tolerance.
    most = (sizes[:, None] + sizes) * ((1 - threshold) / (1 + threshold)) + 2e-4
    like = np.abs(sizes[:, None] - sizes) <= most
    lengths = np.array([len(b) for b in bitmaps])
    apart = np.zeros(like.shape, np.int64)
    for words in np.unique(lengths):  # those of two long sets are compared again, unfolded
        at = np.flatnonzero(lengths >= words)
        own = np.stack([folded(bitmaps[i], words) for i in at])
        for i, bits in zip(at, own, strict=True):
            apart[i, at] = np.bitwise_count(own ^ bits).sum(1)
    like &= apart <= most
    np.fill_diagonal(like, False)
    return like


def signatures(docs: DataFrame, minhash: MinHash) -> DataFrame:
    """row_key, doc_id, digest of the shingle set, n_shingles, bands, bitmap (parity); all but the key and the id are null without a word or an id."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), (c.as_py() for c in batch.column("text")), strict=True):
                if doc_id is None or not len(sh := shingles(text)):
                    rows.append((key, doc_id, None, None, None, None))
                else:
                    v = minhash.values(sh)
                    rows.append((key, doc_id, xxhash.xxh3_128_digest(sh.tobytes()), len(sh), minhash.band_hashes(v), parity(sh).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["row_key", "doc_id", "digest", "n_shingles", "bands", "bitmap"])
        _words.clear()  # Python workers outlive their tasks

    return docs.select("row_key", "doc_id", "text").mapInArrow(released(run), "row_key long, doc_id long, digest binary, n_shingles int, bands array<long>, bitmap binary")


def grouped(keys: list[str], columns: list[str], each: Callable[[list[tuple]], list[tuple]], out: list[tuple[str, pa.DataType]]):
    """A mapInArrow function for rows that are sorted by keys: each(rows of one key) -> output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, made = None, [], []

        def pack(made):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, (_, k) in enumerate(out)], names=[n for n, _ in out])

        for batch in batches:
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != last:
                    if len(rows) > 0:
                        made += each(rows)
                    last, rows = key, []
                rows.append(row)
            if len(made) > 10_000:
                yield pack(made)
                made = []
        if rows:
            made += each(rows)
        yield pack(made)

    return run


def spanning(like: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    apart, out = np.ones(len(like), bool), []
    for root in range(len(like)):
        todo = [root] if apart[root] else []
        apart[root] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(like[i] & apart).tolist()
            apart[new] = False
            out += [(i, j) for j in new]
            todo += new
    return out


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def bucket_edges(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: a spanning forest of each bucket; members has bucket and node."""

    def each(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)
        like = may_link(np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], threshold)
        return [(min(a, b), max(a, b)) for a, b in ((rows[i][0], rows[j][0]) for i, j in spanning(like))]

    # Bitmaps are fetched for members of shared buckets alone.
    rows = dealt(members.join(reps.select("node", "n_shingles", "bitmap"), "node").select("bucket", "node", "n_shingles", "bitmap"), ["bucket"])
    return rows.mapInArrow(released(grouped(["bucket"], ["node", "n_shingles", "bitmap"], each, [("a", pa.int64()), ("b", pa.int64())])), "a long, b long").distinct()


def cluster_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: edges between representatives, which tie what may be similar together. No pair of a bucket that is
    similar is left apart: a bucket of more than BLOCK members is tied together whole, and verified later."""
    met = reps.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    members = written(met.join(shared, "bucket"), "bucket-members")
    whole = members.filter(F.col("n") > BLOCK).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return bucket_edges(members.filter(F.col("n") <= BLOCK), reps, threshold).unionByName(whole).distinct()


def common_shingles(sets: list[np.ndarray], first: int) -> np.ndarray:
    """How many shingles each of the first sets shares with each of the others; all with all if all are the first."""
    n, square = len(sets), first == len(sets)
    m = n if square else n - first
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    held = np.concatenate(sets)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    counts = np.diff(np.concatenate((starts, [len(held)])))
    each = np.repeat(counts, counts)
    number = np.repeat(np.arange(len(counts)), counts)
    few = (each > 1) & (each <= FEW)
    col, own, pairs = number[few], owner[few], []
    for shift in range(1, FEW):
        met = col[shift:] == col[:-shift]
        a, b = own[:-shift][met], own[shift:][met]
        if not square:
            cross = (a < first) & (b >= first)
            a, b = a[cross], b[cross] - first
        pairs.append(a * m + b)
    common = np.bincount(np.concatenate(pairs), minlength=first * m).reshape(first, m).astype(np.float32)
    if square:
        common += common.T.copy()
    many = each > FEW
    col, own = (np.cumsum(counts > FEW) - 1)[number[many]], owner[many]
    total, step = int(col[-1]) + 1 if len(col) else 0, 2048
    for low in range(0, total, step):
        i, j = np.searchsorted(col, [low, low + step])
        grid = np.zeros((n, min(step, total - low)), np.float32)
        grid[own[i:j], col[i:j] - low] = 1
        common += grid @ grid.T if square else grid[:first] @ grid[first:].T
    return common


def similar_pairs(sets: list[np.ndarray], first: int, threshold: float) -> np.ndarray:
    """n x n, symmetric: whether the sets' Jaccard similarity reaches the threshold, and one is of the first and the
    other is not; of all pairs if all are the first."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    common = common_shingles(sets, first)
    at = slice(0 if first == n else first, n)
    like = np.zeros((n, n), bool)
    like[:first, at] = common >= threshold * (sizes[:first, None] + sizes[at] - common) - 1e-4
    if first < n:
        like[first:, :first] = like[:first, first:].T
    np.fill_diagonal(like, False)
    return like


def placed(wanted: DataFrame) -> DataFrame:
    """wanted (node, cluster, n_shingles and more) with part and parts, by the size of its cluster."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TEXTS, F.sum("n_shingles") / SHINGLES)).cast("int").alias("parts")
    # At most one cluster for every TEXTS texts or SHINGLES shingles has parts.
    large = wanted.groupBy("cluster").agg(parts).filter("parts > 1")
    known = wanted.join(F.broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return known.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def verified(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From members (cluster, part, parts, node, copies, set): (node, links, text_links) of all pairs of each cluster, and edges (a, b) that tie what is linked."""

    def each(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r[0])
        ids, copies, sets = [r[1] for r in rows], np.array([r[2] for r in rows], np.float64), [np.frombuffer(r[3], np.uint64) for r in rows]
        if rows[0][4] != rows[0][5] and rows[0][0] == rows[-1][0]:
            return []  # one of the two parts is empty
        like = similar_pairs(sets, sum(r[0] == rows[0][0] for r in rows), threshold)
        out = [(ids[i], None, int(n), m) for i, (n, m) in enumerate(zip((like @ copies).tolist(), like.sum(1).tolist(), strict=True)) if m]
        return out + [(ids[i], ids[j], 0, 0) for i, j in spanning(like)]

    # Each two parts meet in one team, and each part with itself.
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    teams = other.select("cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "copies", "set")
    keys, columns = ["cluster", "low", "high"], ["part", "node", "copies", "set", "low", "high"]
    out = [("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("text_links", pa.int64())]
    found = dealt(teams, keys).mapInArrow(released(grouped(keys, columns, each, out)), "a long, b long, links long, text_links long")
    with lean_batches(members.sparkSession):
        found = written(found, "verified")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    return counts, found.filter("b IS NOT NULL").select("a", "b")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The docs, text replaced by set: the shingle hashes as bytes."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "set"])
        _words.clear()

    schema = docs.select(*names).schema.add("set", "binary")
    return docs.mapInArrow(released(run), schema)


def near_rows(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """near_duplicates with row_key, and group_key: the key of the group's row of smallest id (and key)."""
    bands = bands_for(threshold, recall, ROWS)
    minhash = MinHash(bands, ROWS)
    docs = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))
    with lean_batches(docs.sparkSession):
        every = written(signatures(docs, minhash), "signatures")
    signed = every.filter("digest IS NOT NULL")
    # A class goes by the key of its first row, whose id is the class's id.
    classes = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.row_key").alias("node"), "copies"), "classes")
    first = signed.withColumnRenamed("row_key", "node").join(classes.select("digest", "node", "copies"), ["digest", "node"]).dropDuplicates(["node"])
    first = written(first.drop("doc_id"), "representatives")

    edges = written(cluster_edges(first, threshold), "cluster-edges")
    clusters = written(components(edges), "clusters")
    wanted = clusters.join(first.select("node", "copies", "n_shingles"), "node").select("node", F.col("root").alias("cluster"), "copies", "n_shingles")
    wanted = written(wanted, "cluster-members")
    # Most documents are in no cluster: their texts are told apart before the shuffle.
    texts, _ = split_by(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("row_key").alias("node"), "text"), "node", wanted, "node")
    texts = texts.dropDuplicates(["node"]).join(placed(wanted).drop("n_shingles"), "node")
    counts, links = verified(shingle_sets(texts), threshold)
    linked = written(components(links).join(classes.select("node", "class_id"), "node"), "linked")
    groups = linked.groupBy("root").agg(F.min(F.struct("class_id", "node")).alias("least"))
    groups = linked.join(groups, "root").select("node", F.col("least.class_id").alias("group_id"), F.col("least.node").alias("group_key"))

    by_class = classes.join(counts, "node", "left").join(groups, "node", "left")
    by_class = by_class.select("digest", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("group_key", "node").alias("group_key"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"))
    known = signed.select("row_key", "doc_id", "digest").join(by_class, "digest").select("row_key", "group_key", "doc_id", "class_id", "group_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "n_text_links")
    none = F.lit(0).cast("long")
    alone = every.filter("digest IS NULL").select("row_key", F.col("row_key").alias("group_key"), "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), none.alias("n_links"), none.alias("n_text_links"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id (smallest id of the documents with an equal shingle set), group_id (smallest id of all
    that links join it with), n_links (other documents at or above the threshold, copies included),
    n_text_links (of these, classes of other texts), in clusters of any size."""
    return near_rows(docs, threshold, recall).drop("row_key", "group_key")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Of rows that repeat the id and text of one that stays,
    one stays, any of them. Documents without a word or an id are in no group and all stay."""
    # Only rows with links can go, and repeats link with each other.
    linked = near_rows(docs).filter("n_links > 0").groupBy(F.col("row_key").alias("_tl_row"), "group_key").agg(F.count(F.lit(1)).alias("n"))
    doubtful = linked.select("_tl_row", (F.col("_tl_row") == F.col("group_key")).alias("_tl_stays"), "n").filter("NOT _tl_stays OR n > 1")
    doubtful = written(doubtful.drop("n"), "doubtful")
    perhaps, kept = split_by(docs.withColumn("_tl_key", row_key("doc_id", "text")), "_tl_key", doubtful, "_tl_row")
    met = perhaps.join(doubtful, perhaps._tl_key == doubtful._tl_row, "left")
    once = met.filter("_tl_stays").dropDuplicates(["_tl_key"])
    return kept.unionByName(met.filter("_tl_stays IS NULL").unionByName(once).select(*kept.columns)).select(*docs.columns)
