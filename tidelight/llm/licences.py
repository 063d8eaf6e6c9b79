"""License scans: sparse TF-IDF cosine of headers and licence files, then inheritance from the nearest directory.

Passages of a file that mention licensing, from anywhere in it: its lines, its blocks (between empty
lines) and their sentences, both across line ends, and, where a whole short licence begins, as many
words as that licence has. A licence file is a passage as a whole, too. Distinct passages are compared
once, however many files hold them: their words are weighted by tf * idf (idf over the corpus's passages
and the templates) and joined with the templates' words. A passage names a licence if its similarity to
one of the licence's templates is at least `least`, if it holds the words that tell the template from its
kin (`licence_texts.is_mark`), and if no other licence comes within `margin`; else it names none. A file takes the
licence of its best passage. A directory takes that of its licence file, and files without a licence of
their own inherit from the nearest ancestor directory that has one, found by joining every ancestor path.

Defined cases: null paths or texts: no own licence; null paths inherit nothing. Passages of equal
similarity that name different licences: the smaller name. Two licence files in a directory: the one of
higher similarity, then the smaller name. Rows that repeat get equal results. Empty tables give no rows.
Columns named licence, similarity or origin are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import FULL, is_mark, statements

SALTS = 16
_MENTION = r"(?i)licen[cs]e|permission is hereby|is hereby granted|redistribution and use|neither the name of|creative commons|\bcc0? |public domain|free software"
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"
_SPDX = r"spdx-licen[cs]e-identifier:\s*([a-z0-9.+-]+)"
_SEPARATOR = r"[^a-z0-9.+]+|\.(?=\s|$)"


def words_of(text: Column) -> Column:
    """Lower-case words; a licence tag is one word."""
    low = F.lower(text)
    tags = F.transform(F.regexp_extract_all(low, F.lit(_SPDX), F.lit(1)), lambda x: F.concat(F.lit("spdx:"), x))
    return F.concat(F.filter(F.split(F.regexp_replace(low, _SPDX, " "), _SEPARATOR), lambda w: w != ""), tags)


def _templates(spark: SparkSession) -> DataFrame:
    """licence, part, words; bounded by the fixed templates."""
    rows = [(name, i, text) for name, texts in statements().items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "licence string, part int, text string").select("licence", "part", words_of(F.col("text")).alias("words"))


def _weights(passages: DataFrame, idf: DataFrame, *keys: str) -> DataFrame:
    """keys, word, weight; each passage's weights have length 1. Words are salted: one may be in every passage."""
    salted = idf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tf = passages.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return tf.join(norm, list(keys)).select(*keys, "word", (F.col("w") / F.col("norm")).alias("weight"))


def scan_passages(passages: DataFrame, least: float = 0.7, margin: float = 0.02) -> DataFrame:
    """passage_id, licence, similarity of the passages (passage_id, passage) that name a licence."""
    templates = _templates(passages.sparkSession)
    own = passages.select("passage_id", words_of(F.col("passage")).alias("words"))
    both = own.select("words").unionByName(templates.select("words"))
    total = both.count()
    df = both.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("word", (F.log(F.lit(1.0 + total) / (F.col("df") + 1.0)) + 1).alias("idf"))
    # Fixed templates bound the marks, (licence, part, word), and the broadcast side.
    rows = [(r.licence, r.part, w) for r in templates.collect() for w in set(r.words) if is_mark(w, len(r.words))]
    marks = passages.sparkSession.createDataFrame(rows, "licence string, part int, word string").withColumn("mark", F.lit(1))
    marked = _weights(templates, idf, "licence", "part").withColumnRenamed("weight", "other").join(F.broadcast(marks), ["licence", "part", "word"], "left")
    needed = marks.groupBy("licence", "part").agg(F.count(F.lit(1)).alias("needed"))
    marked = marked.join(F.broadcast(needed), ["licence", "part"], "left")
    cosine = (
        _weights(own, idf, "passage_id")
        .join(F.broadcast(marked), "word")
        .groupBy("passage_id", "licence", "part")
        .agg(F.sum(F.col("weight") * F.col("other")).alias("c"), F.count("mark").alias("held"), F.coalesce(F.max("needed"), F.lit(0)).alias("needed"))
        .filter((F.col("held") == F.col("needed")) & (F.round("c", 9) >= least - margin))
    )
    by_licence = cosine.groupBy("passage_id", "licence").agg(F.max(F.round("c", 9)).alias("c"))
    # At most one entry a licence.
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "licence")))
    best = by_licence.groupBy("passage_id").agg(order.alias("order")).select("passage_id", F.col("order")[0].alias("x"), F.try_element_at("order", F.lit(2)).alias("y"))
    best = best.select("passage_id", "x.licence", (-F.col("x.c")).alias("similarity"), F.col("y.c").alias("next"))
    clear = F.col("next").isNull() | (F.col("similarity") + F.col("next") >= margin)
    return best.filter(clear & (F.col("similarity") >= least)).select("passage_id", "licence", "similarity")


def passages_of(text: Column, whole: Column) -> Column:
    """The text's passages that mention a licence, and itself where `whole`."""
    lines = F.split(text, r"\r\n|\r|\n")
    # Comment signs and white space at the ends of lines don't part a block.
    blocks = F.transform(F.split(text, r"(?:\r\n|\r|\n)[ \t#*/;%-]*(?=\r|\n)"), lambda b: F.trim(F.regexp_replace(b, r"\s*(?:\r\n|\r|\n)[\s#*/;%]*", " ")))
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?;:])\s+(?=[\"'(A-Z])")))
    spans = [F.regexp_extract_all(text, F.lit(_beginning(full)), F.lit(0)) for full in FULL.values()]
    mentions = F.filter(F.concat(lines, blocks, sentences), lambda x: x.rlike(_MENTION))
    return F.array_distinct(F.concat(mentions, *spans, F.when(whole, F.array(text)).otherwise(F.array())))


def _beginning(full: str) -> str:
    """A pattern of as many words as the licence has, from its first four on."""
    words = full.split()
    return r"(?i)" + r"[\s#*/;%]+".join(w.rstrip(",") + ",?" for w in words[:4]) + r"(?:\s+\S+){0,%d}" % (len(words) - 4)


def scan(files: DataFrame, least: float = 0.7, margin: float = 0.02) -> DataFrame:
    """files (path, text and others but text) with licence, similarity, and origin: own, directory path, or null."""
    from .store import written

    files = files.drop("licence", "similarity", "origin")
    keys = [c for c in files.columns if c != "text"]
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(_LICENCE_FILE), F.lit(False)) & F.col("text").isNotNull()
    pieces = passages_of(F.col("text"), is_file)
    # Passages go by their hash from here on: words and files never carry the passage itself.
    found = files.filter(F.col("text").rlike(_MENTION) | is_file).select("path", F.xxhash64("text").alias("k"), F.explode(pieces).alias("passage"))
    found = written(found.withColumn("passage_id", F.xxhash64("passage")), "licence-passages")
    held = found.select("path", "k", "passage_id").distinct()
    known = written(scan_passages(found.groupBy("passage_id").agg(F.min("passage").alias("passage")), least, margin), "licence-matches")
    order = F.struct(-F.round("similarity", 9), F.col("licence"))
    own = held.join(known, "passage_id").groupBy("path", "k").agg(F.min_by(F.struct("licence", "similarity"), order).alias("own"))
    own = written(own, "own-licences")
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    grants = own.filter(name.rlike(_LICENCE_FILE)).select(parent.alias("dir"), "own.*").groupBy("dir").agg(F.min_by(F.struct("licence", "similarity"), order).alias("granted"))
    here = files.withColumn("k", F.xxhash64("text")).select(*keys, "k")
    dirs = here.select("path").filter("path IS NOT NULL").select(parent.alias("from_dir")).distinct()
    steps = F.split("from_dir", "/")
    above = dirs.select("from_dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).select("from_dir", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = above.join(grants, "dir").groupBy("from_dir").agg(F.max_by(F.struct("dir", "granted"), "depth").alias("near"))
    out = here.join(own, (here.path.eqNullSafe(own.path)) & (here.k == own.k), "left").drop(own.path).drop(own.k)
    out = out.withColumn("from_dir", parent).join(nearest, "from_dir", "left")
    use_own = F.col("own").isNotNull()
    return out.select(
        *keys,
        F.when(use_own, F.col("own.licence")).otherwise(F.col("near.granted.licence")).alias("licence"),
        F.when(use_own, F.col("own.similarity")).otherwise(F.col("near.granted.similarity")).alias("similarity"),
        F.when(use_own, F.lit("own")).otherwise(F.col("near.dir")).alias("origin"),
    )


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as a file of a tree: source / hundreds / tens; ids divisible by 50 are licence files."""
    from .store import table

    leaf = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", (F.col("doc_id") / 1000).cast("long"), (F.col("doc_id") / 100).cast("long"), leaf)
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return scan(docs).withColumn("similarity", F.round("similarity", 6))
