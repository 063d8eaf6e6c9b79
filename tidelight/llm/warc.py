"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few WARC records, and a footer:
a skippable frame with the compressed and decompressed size of every frame (the public seekable
format, magic 0x8F92EAB1). An index table maps record ids to (bundle, frame, offset in the
decompressed frame, length), so one record costs one frame. Plain Zstandard readers read a
bundle from end to end, since they skip the footer.

Payloads of at least `least` bytes that occur more than once are stored once: by the response
with the smallest id; the others are revisit records that name it.

Defined cases: null html is an empty payload. Null ids are kept and sort last among equal
payloads. Rows that repeat id and payload are the same record and are all responses or all
revisits. Null urls give records without a target. Other columns stay out of the archive.
An empty table gives no bundle and no rows. A frame holds FRAME_BYTES and one record at most; as a
payload has less than 2 GiB, sizes stay below the 4 GiB that a seek table can name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .membership import split_by
from .store import new_folder, table, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 16 << 20
#: Most tasks that read bundles back.
READERS = 20_000
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classified(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload (null in revisits), payload_bytes, digest, first (the response's id, in revisits).

    Payloads that occur once, nearly all by a bounded bitmap of the others' digests, are not
    shuffled. Of the others only ids and digests meet by digest; then each response, known by digest
    and id, gets its payload. So a payload that a third of all pages share moves once."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    repeated = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    repeated = written(repeated, "repeated-payloads")
    maybe, once = split_by(rows, "digest", repeated, "digest")
    marked = maybe.drop("payload").join(repeated, "digest", "left")
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    whole = marked.filter(response).select("digest", F.col("page_id").alias("id")).distinct()
    kept = maybe.join(whole.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("id")), "left_semi")
    none, columns = F.lit(None), ["page_id", "url", "payload", "payload_bytes", "digest", "first"]
    revisits = marked.filter(~response).withColumn("payload", none.cast("binary")).select(*columns)
    return once.unionByName(kept).withColumn("first", none.cast("long")).select(*columns).unionByName(revisits)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    revisit = first is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"] if revisit else ["Content-Type: text/html; charset=utf-8"]),
        f"Content-Length: {0 if revisit else size}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parsed(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at start, and where the next one begins."""
    end = data.index(b"\r\n\r\n", start)
    head = dict(line.split(": ", 1) for line in data[start:end].decode().split("\r\n")[1:])
    stop = end + 4 + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return head, data[end + 4 : stop], stop + 4


def footer(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def tail_of(f: pa.NativeFile) -> bytes:
    """The last bytes of a bundle, with all of its seek table."""
    size = f.size()
    tail = f.read_at(min(size, 1 << 16), max(0, size - (1 << 16)))
    need = 8 * struct.unpack("<I", tail[-9:-5])[0] + 9
    return tail if need <= len(tail) else f.read_at(need, size - need)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of every frame of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for i in range(n):
        a, b = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, a, b))
        at += a
    return out


class BundleWriter:
    """Packs records into frames, frames into bundles below folder. A bundle gets its name when it is whole,
    so a task that dies leaves none, and a task that runs again leaves others than those its index names."""

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.rows, self.zstd = folder, [], zstandard.ZstdCompressor(level=3)
        self._next()

    def _next(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.frames, self.out, self.raw, self.size = [], [], bytearray(), 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.raw and len(self.raw) + len(data) > FRAME_BYTES:
            self._frame()
        self.rows.append((page_id, self.name, len(self.frames), len(self.raw), len(data)))
        self.raw += data
        if len(self.raw) >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        packed = self.zstd.compress(bytes(self.raw))
        self.frames.append((len(packed), len(self.raw)))
        self.out.append(packed)
        self.size += len(packed)
        self.raw = bytearray()
        if self.size >= BUNDLE_BYTES:
            self.close()

    def close(self) -> None:
        if self.raw:
            self._frame()
        if self.frames:
            with self.files.open_output_stream(f"{self.root}/{self.name}.part") as f:
                for x in self.out:
                    f.write(x)
                f.write(footer(self.frames))
            self.files.move(f"{self.root}/{self.name}.part", f"{self.root}/{self.name}")
            self._next()

    def index(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "bundle", "frame", "offset", "length"])


def write_bundles(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Archive pages below folder (a URI that driver and executors share); returns the index, a table beside the bundles."""
    bundles = f"{folder}/bundles"
    files, root = fs.FileSystem.from_uri(bundles)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(bundles)
        for batch in batches:
            for page_id, url, payload, size, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "digest", "first")), strict=True):
                writer.add(page_id, record(page_id, url, payload, size, digest, first))
            yield writer.index()
        writer.close()

    spark = pages.sparkSession
    classified(pages, least).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_URN = re.compile(r"<urn:page:(-?\d*)>")


def page_of(urn: str | None) -> int | None:
    return int(m[1]) if urn and (m := _URN.fullmatch(urn)) and m[1] else None


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that the index names, read frame by frame by the seek tables: ids, sizes and digests, checked
    against what the archive says of them."""
    named = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    files = spark.read.format("binaryFile").load(f"{folder}/bundles").select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "path")
    paths = written(files.join(named, "bundle").select("path", "n"), "bundles")
    # Rows are tiny and each is a whole bundle to read: they are dealt one to a task, as long as tasks are few enough.
    paths = paths.repartition(max(1, min(paths.count(), READERS)), "path")

    def run(batches):
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n").to_pylist(), strict=True):
                source, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with source.open_input_file(name) as f:
                    rows, zstd = [], zstandard.ZstdDecompressor()
                    for at, packed, raw in seek_table(tail_of(f)):
                        data, start = zstd.decompress(f.read_at(packed, at), max_output_size=raw), 0
                        while start < len(data):
                            head, block, start = parsed(data, start)
                            digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                            if head["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != length):
                                raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} is damaged")
                            rows.append((page_of(head["WARC-Record-ID"]), length, digest, head["WARC-Type"], page_of(head.get("WARC-Refers-To"))))
                    if len(rows) != n:
                        raise ValueError(f"{path} has {len(rows)} records; the index names {n}")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return paths.mapInArrow(run, RECORDS)


def read_record(spark: SparkSession, folder: str, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """Random access: the records of one id, each by one frame."""
    out = []
    for r in spark.read.schema(INDEX).parquet(f"{folder}/index").filter(F.col("page_id") == page_id).collect():
        files, name = fs.FileSystem.from_uri(f"{folder}/bundles/{r.bundle}")
        with files.open_input_file(name) as f:
            at, packed, raw = seek_table(tail_of(f))[r.frame]
            frame = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=raw)
        out.append(parsed(frame, r.offset)[:2])
    return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, then reads the archives back."""
    folder = new_folder(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(spark, folder)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
