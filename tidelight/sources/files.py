"""Scans, manifests and sinks of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT = "schema_version string, run_id string, event_id string, participant_id string, source_kind string, source_timestamp timestamp, event_time timestamp, ingested_at timestamp, signal string, values map<string,double>, unit string, quality string, source_file string, source_row long"
MARKER = "path string, sha256 string, row_count long, run_id string, signal string"


def numbered(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of text files with source_file, _block and _id, and the splits of the files: source_file, _block, _first (id of the
    split's first line), _rows, _offset (lines of the file before it). A split is read by one task from its first line to its
    last, so ids within it are consecutive. No line is sorted or moved: the places of lines follow from counts by split."""
    df = lines.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    splits = df.groupBy("source_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return df, splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def with_physical_row(lines: DataFrame) -> DataFrame:
    """source_row: place in the file, from 1."""
    df, splits = numbered(lines)
    return df.join(splits, ["source_file", "_block"]).select(*lines.columns, "source_file", (F.col("_id") - F.col("_first") + F.col("_offset") + 1).alias("source_row"))


def scan_signal_csv(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """All columns as text, blank rows kept, with source_file and source_row (the first row under the header is 0).
    The header must name Timestamp and the signal's value columns; names are trimmed."""
    names = ["Timestamp", *(("X", "Y", "Z") if signal == "acc" else ("Value",))]
    lines, splits = numbered(spark.read.option("recursiveFileLookup", True).text(path))
    # A file's first line is the first of its first split with lines; one row a file goes to all of its splits.
    heads = lines.join(splits.filter("_offset = 0 AND _rows > 0"), ["source_file", "_block"]).filter("_id = _first").select("source_file", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("_h"))
    rows = lines.join(splits.join(heads, "source_file"), ["source_file", "_block"]).withColumns({"source_row": F.col("_id") - F.col("_first") + F.col("_offset"), "_c": F.split("value", ",")}).filter("source_row > 0")
    missing = F.array_except(F.array(*map(F.lit, names)), F.col("_h"))
    ok = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("columns missing in "), "source_file", F.lit(": "), F.array_join(missing, ", ")))).otherwise(F.lit(True))
    cell = lambda n: F.get("_c", F.array_position("_h", n).cast("int") - 1).alias(n)
    return rows.filter(ok.cast("boolean")).select(*map(cell, names), "source_file", (F.col("source_row") - 1).alias("source_row"))


def resolve_files(listing: DataFrame) -> DataFrame:
    """participant_id, signal, path from a listing of paths `.../<participant>/HR.csv` or `HR_<participant>.csv`; two files for one signal are an error."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    df = listing.select("path", F.element_at(parts, -2).alias("participant_id"), F.lower(F.regexp_extract(name, r"^(HR|EDA|ACC|TEMP|IBI)(_[^.]+)?\.csv$", 1)).alias("signal")).filter("signal <> ''")
    found = df.groupBy("participant_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    one = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one file: "), "participant_id", F.lit(" "), "signal"))).otherwise(F.col("path"))
    return found.select("participant_id", "signal", one.alias("path"))


def scan_events_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def stream_markers(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.schema(MARKER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", 100).json(root)


def stream_events(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def file_fingerprints(spark: SparkSession, path: str, whole: int = 128 << 20) -> DataFrame:
    """path, sha256, size of every file below that is not empty. Files over `whole` bytes are read line by line and hashed as they pass, in order,
    so that none is ever one value; a line must fit one. Hashing is one task a file, as the digest is of its bytes in order."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = listed.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    large = [r.path for r in listed.filter(F.col("length") > whole).select("path").collect()]  # names alone, of large files alone
    return small.unionByName(streamed_fingerprints(spark, large)) if large else small


def streamed_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The fingerprints of text files, from their lines. Lines are cut at line feeds alone and their bytes come as they are."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    m = F.col("_metadata")
    rows = lines.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("line"))
    rows = rows.repartition("path").sortWithinPartitions("path", "_block", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, done, digest = None, 0, 0, hashlib.sha256()

        def told():
            # The last line may lack its line feed, which the size tells.
            tail = hashlib.sha256() if not size else digest
            if done < size:
                tail.update(b"\n")
            return pa.RecordBatch.from_pydict({"path": [at], "sha256": [tail.hexdigest()], "size": [size]})

        for batch in batches:
            path, sizes, lines = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "size", "line"))
            for i in range(batch.num_rows):
                if (own := path[i].as_py()) != at:
                    if at is not None:
                        yield told()
                    at, size, done, digest = own, sizes[i].as_py(), 0, hashlib.sha256()
                elif done < size:
                    digest.update(b"\n")
                    done += 1
                line = lines[i].as_py()
                digest.update(line)
                done += len(line)
        if at is not None:
            yield told()

    return rows.select("path", "size", "line").mapInArrow(run, "path string, sha256 string, size bigint")


def write_with_manifest(df: DataFrame, root: str, batch_id: str) -> DataFrame:
    """JSON files of a batch below root and a manifest row for each: path, sha256, row_count, run_id, signal.
    A batch that is there already is compared by its content and not written again; other content under its id is an error."""
    spark = df.sparkSession
    content = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("h")).first()
    stamp = f"{root}/stamps/{batch_id}"
    try:
        old = spark.read.schema("n long, h string").json(stamp).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old and tuple(old) != tuple(content):
        raise ValueError(f"batch {batch_id} was published with other content")
    data, manifest = f"{root}/data/{batch_id}", f"{root}/manifest/{batch_id}"
    if not old:
        df.write.mode("overwrite").partitionBy("run_id", "signal").json(data)
        counts = spark.read.option("basePath", data).schema(df.schema).json(data).groupBy(F.col("_metadata.file_path").alias("path"), "run_id", "signal").agg(F.count(F.lit(1)).alias("row_count"))
        prints = file_fingerprints(spark, data).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
        rows = counts.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).join(prints, "path")
        rows.select("path", "sha256", "row_count", "run_id", "signal").write.mode("overwrite").json(manifest)
        spark.createDataFrame([tuple(content)], "n long, h string").coalesce(1).write.mode("overwrite").json(stamp)
    return spark.read.schema(MARKER).json(manifest)


def marker_valid(run_id: str) -> Column:
    return (
        (F.col("run_id") == run_id) & ~F.col("path").contains("..") & F.col("path").isNotNull() & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("row_count") >= 1) & F.col("signal").isin("hr", "eda", "acc", "ibi", "temp")
    )


def verify_markers(markers: DataFrame, files: DataFrame, run_id: str) -> DataFrame:
    """path and problem of the markers that are malformed, name no file, or disagree with the file's hash."""
    met = markers.join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    problem = F.when(~F.coalesce(marker_valid(run_id), F.lit(False)), "malformed").when(F.col("actual").isNull(), "no_file").when(F.col("actual") != F.col("sha256"), "other_content")
    return met.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], rows: str = "row_count") -> DataFrame:
    """keys, expected, actual, status of every key of either: ok, missing, unexpected, duplicate or row_count."""
    side = lambda df, n: df.groupBy(*keys).agg(F.sum(rows).alias(n), F.count(F.lit(1)).alias(f"{n}_n"))
    met = side(expected, "expected").join(side(actual, "actual"), keys, "full")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("actual_n") > 1, "duplicate").when(F.col("actual") != F.col("expected"), "row_count").otherwise("ok")
    return met.select(*keys, "expected", "actual", status.alias("status"))


def explode_calendar(docs: DataFrame, column: str = "body") -> dict[str, DataFrame]:
    """Calendar documents as tables: tasks, fixed_events, allowed, sleep, each with the document's run_id."""
    interval = "struct<start: timestamp, end: timestamp>"
    schema = f"struct<tasks: array<struct<task_id: string, title: string, remaining_minutes: int, deadline: timestamp, priority: int, status: string>>, fixed_events: array<struct<event_id: string, title: string, kind: string, start: timestamp, end: timestamp>>, allowed_study_intervals: array<{interval}>, protected_sleep_intervals: array<{interval}>>"
    d = docs.select("run_id", F.from_json(column, schema).alias("d"))
    parts = {"tasks": "tasks", "fixed_events": "fixed_events", "allowed": "allowed_study_intervals", "sleep": "protected_sleep_intervals"}
    return {name: d.select("run_id", F.inline(F.col(f"d.{part}"))) for name, part in parts.items()}
