"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers (in digits or English words), units after numbers, currency signs beside them, and names (runs of
capitalised words) become typed placeholders; case and punctuation go, and
white space of any kind and length is one space. Each window of five words of a document is read in
two ways: names as literal words (so that case doesn't matter), and capitalised words as names
(a sentence may start with one). Windows of the benchmark's items, which are few, are also read with
capitalised words inside a sentence as names and those at its start literal, as a document may hold
the passage inside a sentence. Windows are joined on the hashes of their readings. In documents
with enough hits, the values that stand in matching slots are aligned: each value of the item is
mapped to the value it most often meets, and readings that contradict the mapping don't count. An
item leaks into a document that holds at least `similarity` of its windows, or `run` of them.

The window table of the benchmark is broadcast only if it has at most BROADCAST_ROWS rows, and
is shuffled otherwise. Long documents are exploded to hashes, never copied per window.

Defined cases: null texts have no windows; items shorter than five words never match; windows
with fewer than three literal words are not used; a name that starts a sentence is literal here, and
read as a name where two more words are literal. A text in one case shows no names: windows with
names are met there if it holds the same names. Rows that repeat id and text give one result
row. Items that repeat are matched each. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .membership import split_by
from .store import table, written

WORDS = 5
LITERALS = 3
BROADCAST_ROWS = 1_000_000
# Units that may follow a number.
UNITS = "mm|cm|m|km|in|inch|inches|ft|feet|yd|yards|mi|mile|miles|mg|g|kg|lb|lbs|oz|ml|l|liters|litres|s|sec|seconds|min|minutes|h|hr|hours|days|weeks|months|years|percent|dollars|euros|usd|eur|cents|mph|kmh|hz|khz|mhz|w|kw|v|degrees"


def either(words: list[str]) -> str:
    """A pattern for any of the words that tries no letter twice. What follows must tell a word from its beginnings."""
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[:1], []).append(word[1:])
    if len(rests) == 1:
        ((letter, rest),) = rests.items()
        return letter + either(rest) if letter else ""
    return "(?:" + "|".join(letter + either(rest) if letter else "" for letter, rest in sorted(rests.items(), reverse=True)) + ")"


# Patterns begin with a look at the character itself, which rules out most places at once.
_NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},'\)] )(\p{Lu}\p{Ll}[\p{L}'-]*)(?=[\s.,;:!?\)]|$)"
_UNIT = rf"(\x02num\S*\s)((?i:{UNITS}|currencysign))(?=[\s.,;:!?\)]|$)"
# English number words. Runs of them are one number, as runs of capitalised words are one name.
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
# A number in digits between spaces, or in a word after a space, bracket, quote or hyphen.
_NUMBER = rf"([\s(\"'-])(?=[^acdgijklpqruvwxyzACDGIJKLPQRUVWXYZ])(?:(?![a-zA-Z])(?<=\s)([\(\p{{Sc}}]?[+-]?\d[\d.,:/]*%?)(?=[\s;!?\)]|$)|((?i:{either(NUMBER_WORDS.split("|"))}))(?=[\s.,;:!?)\"'-]|$))"
_NUMBER_RUN = r"(?<=\x02num\x03[A-Za-z]{3,12}[ -])(?:and )?\x02num\x03(?=[A-Za-z])"
_NAME_RUN = r"(?<=\x02(?:name|start)\x03[^ ]{2,60} )\x02name\x03"
_BEFORE_RUN = r"[ -](?=(?:and )?\x02)"
# A sign before or after a number is a unit after it.
_SIGN = r"(?=[\p{Sc}\d])(?:(?<!\S)\p{Sc}\s?(\d[\d.,]*)|(\d)\s?\p{Sc}(?=[\s.,;:!?\)]|$))"


_START = r"(?=\p{Lu}\p{Ll})(?<=(?:^|\s)[\"'“‘„«(\[]{0,2})(\p{Lu}\p{Ll}[\p{L}'-]*)(?=[\s.,;:!?\)]|$)"
_SPACES = r"(?! ?[!-~])(?:[\s\p{Z}\x02\x03]{2,}|[\s\p{Z}\x02\x03&&[^ ]])"


def canonical(text: Column, runs: bool = True) -> Column:
    """A text's words with a space between; placeholders (num, unit, name, start) keep what they stand for after \\x03.
    Without runs each capitalised word is a name of its own."""
    text = F.regexp_replace(F.concat(F.lit(" "), text), _SPACES, " ")
    text = F.regexp_replace(text, _SIGN, "$1$2 currencysign")
    text = F.regexp_replace(text, _NUMBER, "$1\x02num\x03$2$3")
    text = F.regexp_replace(text, _UNIT, "$1\x02unit\x03$2")
    text = F.regexp_replace(text, _NAME, "\x02name\x03$1")
    text = F.regexp_replace(text, _START, "\x02start\x03$1")
    text = F.regexp_replace(text, f"{_BEFORE_RUN}(?:{_NUMBER_RUN}|{_NAME_RUN})" if runs else f"{_BEFORE_RUN}{_NUMBER_RUN}", "")
    return F.regexp_replace(F.lower(text), r"(?=[^a-z ])[^a-z0-9 \p{L}\p{N}\s\x02\x03]+", "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _literal(text: Column, *kinds: str) -> Column:
    """The canonical text with the placeholders of some kinds as literal words."""
    for kind in kinds:
        text = F.replace(text, F.lit(f"\x02{kind}\x03"), F.lit(""))
    return text


def readings(text: Column, values: bool = False) -> list[Column]:
    """w0, w1, w2: a canonical text's words with names literal, names, and names and starts. Their places agree. With values, placeholders keep theirs."""
    starts = F.replace(text, F.lit("\x02start"), F.lit("\x02name"))
    texts = [_literal(text, "start", "name"), _literal(text, "start"), starts]
    return [_words(t if values else F.regexp_replace(t, "\x03[^ ]+", "")).alias(f"w{k}") for k, t in enumerate(texts)]


def _starts(words: Column) -> Column:
    """Where windows start, counted from 1; none in short texts."""
    return F.when(F.size(words) >= WORDS, F.sequence(F.lit(1), F.size(words) - (WORDS - 1)))


def _head(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring_index(w, "\x03", 1))


def _slots(words: Column, kept: str = "\x02") -> Column:
    return F.transform(F.filter(words, lambda w: w.startswith(kept)), lambda w: F.substring_index(w, "\x03", -1))


def _runs(words: str) -> Column:
    """An array with a struct of five words for each place; those at the end are short of words, which are null."""
    return F.arrays_zip(*(F.slice(words, k + 1, F.size(words)) for k in range(WORDS)))


def window_hashes(docs: DataFrame) -> DataFrame:
    """row_key, hash: the hashes of the windows of each text, in both readings of a document."""
    literal, _, named = readings(F.col("t"))
    words = docs.select("row_key", canonical(F.col("text")).alias("t")).select("row_key", literal, named)
    # Compiled, unlike a lambda over places; the hash of five columns is that of an array of them.
    runs = words.select("row_key", F.inline(F.concat(_runs("w0"), _runs("w2"))))
    return runs.filter(F.col(f"{WORDS - 1}").isNotNull()).select("row_key", F.xxhash64(*map(str, range(WORDS))).alias("hash"))


def _windows(df: DataFrame, *keys: str, names: bool = False, text: Column | None = None) -> DataFrame:
    """A row for each window and different reading of df's text: its place, hash, slot values and the number of slots
    without starts. With names, the literal reading has the names as slots too, after the others."""
    words = df.select(*keys, (canonical(F.col("text")) if text is None else text).alias("t")).select(*keys, *readings(F.col("t"), values=True))

    def each(i):
        w0, w1, w2 = (F.slice(f"w{k}", i, WORDS) for k in range(3))
        literal = F.concat(_slots(w0), _slots(w1, "\x02name")) if names else _slots(w0)
        rows = [F.struct(i.alias("at"), F.xxhash64(_head(w)).alias("hash"), slots.alias("slots"), F.size(_slots(w1)).alias("n_slots")) for w, slots in ((w0, literal), (w1, _slots(w1)), (w2, _slots(w2)))]
        return F.array_distinct(F.array(*rows))

    at = F.flatten(F.transform(_starts(F.col("w0")), each))
    return words.select(*keys, F.explode(at).alias("x")).select(*keys, "x.*")


ITEM = ["item_id", "version"]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, version, at, hash, slots, n_windows of the benchmark's usable windows, by reading. An item with names of several
    words has a second version where each is so many words, as a document in one case shows them."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", canonical(F.col("text")).alias("folded"), canonical(F.col("text"), runs=False).alias("single"))
    versions = items.select("item_id", F.posexplode(F.array_distinct(F.array("folded", "single"))).alias("version", "text"))
    w = _windows(versions, *ITEM, names=True, text=F.col("text"))
    w = w.filter((F.col("n_slots") <= WORDS - LITERALS) & (F.size("slots") <= WORDS - LITERALS + 1)).drop("n_slots")
    return w.join(w.groupBy(*ITEM).agg(F.countDistinct("at").alias("n_windows")), ITEM)


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, run: int = 26) -> DataFrame:
    """doc_id, row_key, item_id, n_windows, n_matched, coverage, n_slots, changed_slots of every leak, by the item's version that is met best."""
    items = written(item_windows(benchmark), "benchmark-windows")
    index = items.select(*ITEM, "hash", F.col("at").alias("item_at"), "n_windows").distinct()
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    docs = docs.filter("text IS NOT NULL").select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))
    enough = F.least(F.ceil(F.col("n_windows") * similarity), F.lit(run))
    hits = window_hashes(docs).join(index, "hash")
    suspects = hits.select("row_key", *ITEM, "n_windows", "item_at").distinct().groupBy("row_key", *ITEM, "n_windows").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("row_key", *ITEM)
    suspects = written(suspects, "suspects")

    # Few documents are suspects: the others' texts are told apart before the shuffle.
    texts, _ = split_by(docs, "row_key", suspects, "row_key")
    texts = texts.join(suspects.select("row_key").distinct(), "row_key").dropDuplicates(["row_key"])
    own = _windows(texts, "row_key", "doc_id").drop("n_slots").join(suspects, "row_key")
    theirs = items.select(*ITEM, "n_windows", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    met = written(own.join(theirs, [*ITEM, "hash"]), "met-windows")
    pair, place = ["row_key", *ITEM], ["at", "item_at", "hash"]
    # Names that are met as literal words stand for themselves.
    ours = F.coalesce("s.slots", "s.item_slots").alias("ours")
    slots = met.select(*pair, *place, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*pair, *place, F.col("s.item_slots").alias("theirs"), ours)
    counted = slots.groupBy(*pair, "theirs", "ours").agg(F.count(F.lit(1)).alias("n"))
    mapping = counted.groupBy(*pair, "theirs").agg(F.max_by("ours", F.struct("n", "ours")).alias("mapped"))
    at_odds = slots.join(mapping, [*pair, "theirs"]).filter("ours <> mapped").select(*pair, *place).distinct()
    matched = met.join(at_odds, [*pair, *place], "left_anti").groupBy(*pair, "doc_id", "n_windows").agg(F.countDistinct("item_at").alias("n_matched"))
    of_slots = mapping.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("theirs") != F.col("mapped")).alias("changed_slots"))
    coverage = F.col("n_matched") / F.col("n_windows")
    told = F.struct(coverage.alias("coverage"), F.lit(0) - F.col("version"), "n_windows", "n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))
    best = matched.filter(F.col("n_matched") >= enough).join(of_slots, pair, "left").groupBy("doc_id", "row_key", "item_id").agg(F.max(told).alias("x"))
    return best.select("doc_id", "row_key", "item_id", "x.n_windows", "x.n_matched", "x.coverage", "x.n_slots", "x.changed_slots")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a leak. Rows with null texts stay, rows that repeat are kept or dropped together."""
    bad = written(leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias("_tl_bad")).distinct(), "leaking")
    # Few documents leak: the others are told apart by a bounded bitmap and are not shuffled, whatever their number.
    perhaps, kept = split_by(docs.withColumn("_tl_key", row_key("doc_id", "text")), "_tl_key", bad, "_tl_bad")
    return kept.unionByName(perhaps.join(bad, perhaps._tl_key == bad._tl_bad, "left_anti")).select(*docs.columns)
