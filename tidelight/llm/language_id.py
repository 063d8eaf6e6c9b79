"""Language ID by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text recognises exactly the strings
that occur in that text. A document is cut, left to right, into the longest phrases that the
automaton recognises; a language in which few long phrases suffice is a likely one. Phrase
counts are normalised as an entropy rate, phrases * log2(taught letters) / letters, and the
lowest rate wins. All languages are taught the same number of letters, that of the shortest
sample of at least LEAST_LETTERS: of two samples the longer one has the longer matches. The
samples together have at most ALL_LETTERS letters, which bounds the tables that are broadcast.

Every language has an alphabet of its own, with all letters of its sample. Its automaton is a
complete table (state x symbol -> state, phrases closed) where that is small, else a hash table
of its transitions; both give the same phrases. Thousands of 512-symbol blocks are parsed side by
side in numpy, a lookup a symbol. Phrases don't cross blocks, which adds at most one phrase in 512
symbols to every language alike.

Defined cases: text null or without a letter -> `und`, score 0. A letter that a language was not
taught counts as two phrases in it, so that a taught letter alone is the likelier one. Equal rates -> the first language by name. Nothing learned
(no labelled rows) -> `und` for every row. Rows, repeated or not, are judged one by one; extra
columns stay, those named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import released, table

BLOCK = 512
#: Characters parsed at once in a task, which bounds its memory.
SLICE_CHARS = 400_000
#: Bounds of what is taught: a shorter sample doesn't shorten the others; letters of all samples together.
LEAST_LETTERS, ALL_LETTERS = 5_000, 8_000_000
#: Entries of a complete table; an automaton with more is hashed.
DENSE = 4_000_000


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton whose paths are the substrings of text."""
    nexts: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def letters_only(text: str) -> str:
    """Lower case; every run of other characters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Dense:
    """An automaton as a complete table. Entry: next state's row << 2 | phrases closed by this symbol."""

    def __init__(self, nexts: list[dict[str, int]], code: dict[str, int]):
        self.width = width = len(code) + 1
        root = np.full(width, -1, np.int64)
        for c, s in nexts[0].items():
            root[code[c]] = s
        restart = np.where(root >= 0, (root * width << 2) | 1, 3)  # closes the phrase; an unknown letter is two more
        out = np.tile(restart, (len(nexts), 1))
        out[0] = np.where(root >= 0, root * width << 2, 2)
        for s, edges in enumerate(nexts):
            for c, t in edges.items():
                out[s, code[c]] = t * width << 2
        self.table = out.astype(np.int32).ravel()

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and phrases closed."""
        got = self.table[state + symbol]
        return got >> 2, got & 3


class Hashed:
    """An automaton as an open-addressed table of its transitions, at most a quarter full."""

    def __init__(self, nexts: list[dict[str, int]], code: dict[str, int]):
        self.width = width = len(code) + 1
        self.root = np.full(width, -1, np.int32)
        for c, s in nexts[0].items():
            self.root[code[c]] = s
        edges = [(s * width + code[c], t) for s, own in enumerate(nexts) for c, t in own.items()]
        keys, to = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.to[at[first]] = keys[first], to[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) * self.width + symbol
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        begin, miss = self.root[symbol], out < 0
        return np.where(miss, np.maximum(begin, 0), out), miss * ((state > 0) + 2 * (begin < 0).astype(np.int32))


class CrossParser:
    """Parse tables of several languages. Symbols: 0 is a gap, then the letters that any language was taught, then all others."""

    def __init__(self, samples: dict[str, str]):
        samples = {k: s for k, v in samples.items() if (s := letters_only(v))}
        self.languages = sorted(samples)
        long = [len(s) for s in samples.values() if len(s) >= LEAST_LETTERS] or list(map(len, samples.values()))
        self.size = max(1, min(*long, ALL_LETTERS // len(samples), ALL_LETTERS)) if samples else 1
        samples = {k: s[: self.size] for k, s in samples.items()}
        self.alphabet = [" ", *sorted({c for s in samples.values() for c in s if c != " "})]
        self.own, self.tables = zip(*(self._table(samples[k]) for k in self.languages), strict=True) if samples else ((), ())

    def _table(self, text: str) -> tuple[np.ndarray, Dense | Hashed]:
        """The language's symbol of each common one, and its automaton."""
        code = {c: i for i, c in enumerate(sorted(set(text)))}
        nexts = suffix_automaton(text)
        small = len(nexts) * (len(code) + 1) <= DENSE
        own = np.array([code.get(c, len(code)) for c in [*self.alphabet, None]], np.int32)
        return own, (Dense if small else Hashed)(nexts, code)

    def codes(self) -> np.ndarray:
        """Symbol of each code point, upper case folded."""
        code, other = {c: i for i, c in enumerate(self.alphabet)}, len(self.alphabet)
        out = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                out[cp] = code.get(c.lower()[:1], other) if c.lower()[:1] != " " else other
        return out

    def rates(self, texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its entropy rate in each language."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol = codes[points]
        owner = np.repeat(np.arange(n), sizes)
        keep = symbol > 0
        keep[1:] |= (symbol[:-1] > 0) & (owner[1:] == owner[:-1])  # the first of a gap stays
        letters = np.bincount(owner[symbol > 0], minlength=n)
        symbol, owner = symbol[keep], owner[keep]
        kept = np.bincount(owner, minlength=n)
        starts = np.concatenate(([0], np.cumsum(kept)[:-1]))
        blocks = -(-kept // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)[:-1])) if n else np.zeros(0, np.int64)
        at = np.arange(len(symbol)) - starts[owner]
        lane = first[owner] + at // BLOCK
        total = int(blocks.sum())
        filled = np.bincount(lane, minlength=total)
        order = np.argsort(-filled, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        grid = np.zeros((BLOCK, total), np.int32)
        grid[at % BLOCK, place[lane]] = symbol
        active = total - np.searchsorted(filled[order][::-1], np.arange(BLOCK), side="right")
        lane_owner = np.repeat(np.arange(n), blocks)[order]
        out = np.zeros((n, len(self.languages)))
        for k, (own, table) in enumerate(zip(self.own, self.tables, strict=True)):
            state, closed = np.zeros(total, np.int32), np.zeros(total, np.int32)
            for step in range(BLOCK):
                if not (m := int(active[step])):
                    break
                state[:m], more = table.step(state[:m], own[grid[step, :m]])
                closed[:m] += more
            closed += state > 0
            phrases = np.bincount(lane_owner, weights=closed, minlength=n)
            out[:, k] = phrases * math.log2(max(2, self.size)) / np.maximum(kept, 1)
        return letters, out


def sample_texts(labelled: DataFrame, docs_per_language: int, chars_per_doc: int) -> dict[str, str]:
    """A bounded sample for the automata: of each language the documents that are first by hash in each
    of docs_per_language hash buckets, and of each a piece of chars_per_doc characters at a hashed place.
    The rows that come to the driver are docs_per_language a language."""
    order = F.xxhash64(F.lit("sample"), "doc_id", "text")
    piece = F.substring(
        F.col("text"), (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars_per_doc, F.lit(1))) + 1).cast("int"), F.lit(chars_per_doc)
    )
    picked = (
        labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
        .select("lang", F.pmod(order, F.lit(docs_per_language)).alias("bucket"), order.alias("order"), piece.alias("piece"))
        .groupBy("lang", "bucket")
        .agg(F.min_by("piece", "order").alias("piece"))
        .collect()
    )
    out: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.bucket)):
        out.setdefault(r.lang, []).append(r.piece)
    return {k: " ".join(v) for k, v in out.items()}


_loaded: dict[int, tuple] = {}


def identify(docs: DataFrame, parser: CrossParser, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score added under names; columns so named before are replaced.
    score = 1 - best rate / second best rate (1 if one language is known)."""
    docs = docs.drop(*names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(parser)
    schema = pa_schema(docs, {names[0]: "string", names[1]: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        if (own := _loaded.get(id(p))) is None:
            _loaded.clear()
            own = _loaded[id(p)] = (p, p.codes())
        for batch in batches:
            column, found, scores, at = batch.column(batch.schema.get_field_index(text)), [], [], 0
            while at < len(column):
                texts, size, end = [], 0, at
                while end < len(column) and size < SLICE_CHARS:
                    texts.append(column[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                letters, rates = p.rates(texts, own[1])
                for has, row in zip(letters, rates, strict=True):
                    if not has or not p.languages:
                        found.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    found.append(p.languages[best])
                    scores.append(float(min(1.0, max(0.0, 1 - row[best] / rest.min()))) if len(rest) else 1.0)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])
        _loaded.clear()

    return docs.mapInArrow(released(run), schema)


def pa_schema(df: DataFrame, more: dict[str, str]):
    """df's schema with some columns added."""
    from pyspark.sql.types import StructType

    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def learn(docs: DataFrame, docs_per_language: int = 48, chars_per_doc: int = 600) -> CrossParser:
    return CrossParser(sample_texts(docs, docs_per_language, chars_per_doc))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang")
    parser = learn(rows.filter(~held_out()))
    return identify(rows.select("doc_id", "text"), parser).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go. The labelled documents of the stage's own input teach it.
    Where none is labelled, no language is known and every document with a letter stays."""
    parser = learn(docs.select("doc_id", "text", "lang").filter(~held_out()))
    if not parser.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return identify(docs, parser, names=("_tl_lang", "_tl_score")).filter("_tl_lang <> 'und'").select(*docs.columns)
