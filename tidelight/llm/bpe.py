"""Byte-level BPE by merge replay over a corpus of words.

The pattern cuts texts into words that merge independently, so a word needs its merges once
however often it occurs. Each task gathers the distinct new words of a block of its documents,
lays their bytes out in one array, and keeps an inverted index from the rank of a token pair to
the positions that hold it. Ranks are taken in order; a merge rewrites all its positions at
once (the leftmost of each word first, as one word's merges come one by one) and only the two
neighbours of each get new index entries. The words' ids then make up the documents' ids.

Words are shared within a block of documents and through a bounded cache from block to block,
not through a shuffle: the result is the same, and nothing but the documents moves. (One vocabulary
of the whole corpus, joined back to the documents, took more than four times the disk that the corpus
itself does, since most distinct words of a corpus are rare; README has the figures.)

Defined cases: null text is empty: no tokens, digests of nothing. Texts of any length are
split piece by piece. Equal rows get equal results; other columns stay, those named like the
results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .language_id import pa_schema
from .store import lean_batches, released, table, written

#: Bounds of a task's memory: characters of a block of documents, words kept from earlier blocks.
BLOCK_CHARS = 2_000_000
CACHED_WORDS = 200_000
WORDS_AT_ONCE = 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes words by a rank file; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        self._index(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs, at most a quarter full."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots, self.slot_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[first]], self.slot_ranks[at[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        held = self.slots[at]
        out = np.where(held == key, self.slot_ranks[at], np.int32(-1))
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        total = len(sym)
        word = np.repeat(np.arange(n), sizes)
        ends = np.cumsum(sizes) - 1
        nxt, prv = np.arange(1, total + 1), np.arange(-1, total - 1)
        nxt[ends] = -1
        prv[(ends + 1)[:-1]] = -1
        if total:
            prv[0] = -1
        pair = np.full(total, -1, np.int32)
        has = np.flatnonzero(nxt >= 0)
        pair[has] = self.rank(sym[has], sym[has + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            """Enter positions into the index under the rank of the pair that starts there."""
            at = at[pair[at] >= 0]
            if not len(at):
                return
            r = pair[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
                k = int(r[i])
                if k not in index:
                    index[k] = []
                    heapq.heappush(heap, k)
                index[k].append(at[i:j])

        post(has)
        alive = np.ones(total, bool)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == r]
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(heap, r)
                at = at[first]
            right = nxt[at]
            after = nxt[right]
            sym[at], nxt[at] = r, after
            alive[right] = False
            pair[right] = -1
            tail = after >= 0
            prv[after[tail]] = at[tail]
            pair[at] = -1
            before = prv[at]
            head = before >= 0
            # A word is merged in one place a round, so these pairs don't meet.
            left = np.concatenate((at[tail], before[head]))
            pair[left] = self.rank(sym[left], sym[np.concatenate((after[tail], at[head]))])
            post(left)
        ids = sym[alive].astype("<u4")
        counts = np.bincount(word[alive], minlength=n)
        stops = (np.cumsum(counts) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def narrow(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes spelled out for Latin-1 texts, on which the standard library's engine is faster."""

    def among(test) -> str:
        return "".join(re.escape(c) for c in map(chr, range(256)) if test(c))

    letters, numbers = (among(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    spaces = among(lambda c: regex.match(r"\s", c))
    inside = {r"\s": spaces, r"\p{L}": letters, r"\p{N}": numbers}
    pattern = re.sub(r"\[\^((?:\\s|\\p\{[LN]\})+)\]", lambda m: "[^" + "".join(inside[x] for x in re.findall(r"\\s|\\p\{[LN]\}", m[1])) + "]", pattern)
    for name, chars in inside.items():
        pattern = pattern.replace(name, f"[{chars}]")
    return re.compile(pattern.replace(r"\S", f"[^{spaces}]"))


class Encoder:
    """A task's replay and its cache of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.cache = MergeReplay(ranks), {}
        self.wide, self.narrow = regex.compile(pattern), narrow(pattern)

    def pattern_of(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide
        return self.narrow

    def learn(self, new: set[str]) -> None:
        words = iter(new)
        while part := list(islice(words, WORDS_AT_ONCE)):
            raw = [w.encode("utf-8") for w in part]
            hard = [i for i, b in enumerate(raw) if b not in self.replay.ranks]
            for i, ids in zip(hard, self.replay.encode([raw[i] for i in hard]), strict=True):
                self.cache[part[i]] = ids
            for w, b in zip(part, raw, strict=True):
                if (rank := self.replay.ranks.get(b)) is not None:
                    self.cache[w] = rank.to_bytes(4, "little")

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, as bytes; texts are taken block by block."""
        block: list[list[str] | str] = []
        size = 0
        for t in texts:
            if len(t) > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
                yield self._long(t)
                continue
            if size + len(t) > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
            block.append(self.pattern_of(t).findall(t))
            size += len(t)
        yield from self._block(block)

    def _forget(self) -> None:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        self._forget()
        self.learn(set().union(*block) - self.cache.keys())
        for words in block:
            yield b"".join(map(self.cache.__getitem__, words))

    def _long(self, text: str) -> bytes:
        words, out = (m[0] for m in self.pattern_of(text).finditer(text)), []
        while part := list(islice(words, WORDS_AT_ONCE)):
            out += self._block([part])
        return b"".join(out)


_encoders: dict[tuple[str, str], Encoder] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; with keep_ids also ids, an array. Without keep_text the
    texts don't come back from Python, and the column goes."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    docs = docs.drop(*names)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        if (own := _encoders.get((path, pattern))) is None:
            own = _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for ids in own.encode(t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text))):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(own.replay.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append(np.frombuffer(ids, "<u4").astype(np.int32))
            more = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *[pa.array(lists, pa.list_(pa.int32()))] * keep_ids]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *more], names=[*kept, *names])
        _encoders.clear()  # Python workers outlive their tasks

    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    return docs.mapInArrow(released(run), pa_schema(docs.select(*kept), kinds))


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary; it is installed on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    with lean_batches(spark):  # digests are small, so they are written there and then
        return written(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), *rank_file(), keep_text=False), "byte-bpe")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, the pipeline's result: a row for every document, null and empty texts included."""
    with lean_batches(spark):
        return written(encode_decode(docs, *rank_file(), keep_text=False), "byte-bpe")
