"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words with a smallest period q, at least `least` words and `times` periods long, that no
neighbouring word extends. Runs are found by a suffix automaton whose link tree has link-cut access: the state of each
prefix is accessed in turn, and the path from it to the root falls into segments of one last occurrence each. Where a
segment's longest string ends now and ended d words ago, and is at least d words long, the last 2d words are a square.
A square's start does not move while its run goes on, so squares of one (start, period) make up one run: from the first
to the last, and the automaton meets each run's smallest period alone, since the last occurrence is the nearest.

A run repeats some stretch of `window()` words at another place of the text, so the automaton runs over the stretches
that such repeats cover, one after the other; each run lies in one of them, its neighbours included. Hashes of windows
only choose the stretches: two that clash widen one, none is lost.

Defined cases: a null or empty text, or one of white space, has no words and no runs, and collapses to the empty text.
Rows are read one by one, whatever their size; a text needs memory for the repeated part of itself. Equal rows get
equal results; other columns stay, those named like the results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import pa_schema
from .store import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3
#: Characters of the texts that go back to the JVM in one batch, about.
SLICE_CHARS = 4_000_000


def window(least: int, times: int) -> int:
    """Words that match at one period's distance in any run, at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(2, least + 1)))


def repeated(words: list[str], size: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) covered by windows of so many words that occur more than once."""
    n = len(words) - size + 1
    if n < 2:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams, wide, rest = h, 1, size
    while wide * 2 <= size:  # by doubling
        grams = grams[:-wide] * np.uint64(0x9E3779B97F4A7C15) + (grams[wide:] ^ (grams[wide:] >> np.uint64(31)))
        wide *= 2
    if rest := size - wide:  # two windows that overlap make up one of the full size
        grams = grams[:-rest] * np.uint64(0x94D049BB133111EB) + grams[rest:]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    cut = np.flatnonzero(np.diff(at) > size)
    return [(int(at[i]), int(at[j]) + size) for i, j in zip([0, *(cut + 1)], [*cut, len(at) - 1], strict=True)]


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths, and the state of each prefix. State 0 is none, 1 the root."""
    link, longest, moves, states = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for c in ids:
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        moves.append({})
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif longest[q := moves[p][c]] == longest[p] + 1:
            link[new] = q
        else:
            copy = len(link)
            link.append(link[q])
            longest.append(longest[p] + 1)
            moves.append(moves[q].copy())
            while p and moves[p].get(c) == q:
                moves[p][c] = copy
                p = link[p]
            link[q] = link[new] = copy
        states.append(new)
        last = new
    return link, longest, states


def squares(ids: list[int]) -> dict[tuple[int, int], int]:
    """The last end of the squares that begin at a place with a period: {(start, period): end}, ends inclusive.

    Paths of one last occurrence are splay trees ordered by depth; `seen` of a tree's root is the path's last
    occurrence. A root's `up` is the link-tree parent of the path's top.
    """
    link, longest, states = automaton(ids)
    size = len(link)
    up = [0 if x == 1 else x for x in link]  # the root matches the empty string alone
    left, right, seen = [0] * size, [0] * size, [-1] * size

    def splay(x: int) -> None:
        top = x
        while (p := up[top]) and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        seen[x] = seen[top]
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            for y in ((p, x) if (left[p] == x) == (left[g] == p) else (x, x)) if inner else (x,):
                p = up[y]
                g = up[p]
                if left[p] == y:
                    z = left[p] = right[y]
                    right[y] = p
                else:
                    z = right[p] = left[y]
                    left[y] = p
                if z:
                    up[z] = p
                up[y] = g
                up[p] = y
                if g:
                    if left[g] == p:
                        left[g] = y
                    elif right[g] == p:
                        right[g] = y

    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(states):
        x, below = state, 0
        while x:
            splay(x)
            before = seen[x]
            if before >= 0 and longest[x] >= i - before:
                found[before - longest[x] + 1, i - before] = i
            if rest := right[x]:  # the deeper part keeps its last occurrence
                seen[rest] = before
            right[x] = below
            below, x = x, up[x]
        splay(state)
        seen[state] = i
    return found


def runs_of(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, in order of start, then period."""
    out = []
    for a, b in repeated(words, window(least, times)):
        ids: dict[str, int] = {}
        for (start, period), end in squares([ids.setdefault(w, len(ids)) for w in words[a:b]]).items():
            if (length := end - start + 1) >= max(least, times * period):
                out.append((a + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at:a]
        at = max(at, b)
    return " ".join(out + words[at:])


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs with the runs of each text, in order of start, then period, and the text without repetitions."""
    if least < 1 or times < 2:
        raise ValueError("runs have a word and two periods at least")
    docs = docs.drop(*names)
    schema = pa_schema(docs, {names[0]: RUNS, names[1]: "string"})
    kinds = (pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(batch.schema.get_field_index(text)), 0
            while at < batch.num_rows:
                rows, short, size, first = [], [], 0, at
                while at < batch.num_rows and (at == first or size < SLICE_CHARS):
                    words = WORD.findall(texts[at].as_py() or "")
                    runs = runs_of(words, least, times)
                    rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    short.append(collapsed(words, runs))
                    size += len(short[-1])
                    at += 1
                own = [pa.array(rows, kinds[0]), pa.array(short, kinds[1])]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns, *own], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def best(runs: str = "runs") -> Column:
    """The run of the greatest exponent, the first of equals by start, then period; null if there is none. Exponents are compared exactly, as fractions."""
    more = lambda a, b: a["length"].cast("decimal(38,0)") * b["period"] > b["length"].cast("decimal(38,0)") * a["period"]
    return F.aggregate(runs, F.get(F.col(runs), F.lit(0)), lambda kept, x: F.when(more(x, kept), x).otherwise(kept))


def periodised(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, of one document in ten by hash with its end made periodic; any other as it is."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def made(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # One element, so that the words are taken once.
    some = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, some).otherwise(F.col(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, after the periodic endings of one in ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodised().alias("text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = F.col("top")
    return (
        find_runs(docs)
        .withColumn("top", best())
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
            F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
            F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


#: CRC-32 of ASCII text in SQL: a table by its polynomial, then a fold over the characters.
CRC_TABLE = "crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


#: Runs by brute force: places with equal words at each distance, in unbroken stretches.
OP13_SQL = rf"""WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, text, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc)),
e AS (SELECT *, len(w) AS n, g % len(w) AS a, 1 + (len(w) - g % len(w)) // (3 + g % 8) AS p FROM d),
f AS (SELECT k, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM e),
x AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM f),
ids AS (SELECT k, i, word, hash(word) AS v FROM x),
m AS (SELECT l.k, l.i, r.i - l.i AS q FROM ids l JOIN ids r ON l.k = r.k AND l.v = r.v AND l.word = r.word AND r.i > l.i),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT k, i, q, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM m) GROUP BY k, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
b AS (SELECT k, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.k = x.k AND gone.i = x.i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period, CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM f LEFT JOIN b USING (k) LEFT JOIN c USING (k)"""
