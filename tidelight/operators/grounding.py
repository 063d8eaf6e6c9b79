"""Whether the numbers in a text stand in the facts that it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLOCK = r"(\b\d{1,2}:\d{2}\b)"
_NUMBER = r"((?<![\w.])\d+(?:\.\d+)?)"


def grounding_audit(texts: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, n_numbers, n_clocks, ungrounded (sorted), grounded for texts (key, text) against facts (key, text)."""

    def tokens(df: DataFrame) -> DataFrame:
        rest = F.regexp_replace("text", _CLOCK, " ")
        return df.filter("text IS NOT NULL").select(key, F.explode(F.concat(F.regexp_extract_all("text", F.lit(_CLOCK)), F.regexp_extract_all(rest, F.lit(_NUMBER)))).alias("token"))

    said = tokens(texts).distinct()
    known = tokens(facts).distinct().withColumn("known", F.lit(True))
    met = said.join(known, [key, "token"], "left")
    clock = F.col("token").contains(":")
    counts = met.groupBy(key).agg(F.count_if(~clock).alias("n_numbers"), F.count_if(clock).alias("n_clocks"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("token")))).alias("ungrounded"))
    out = texts.select(key).distinct().join(counts, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, F.coalesce("n_numbers", F.lit(0)).alias("n_numbers"), F.coalesce("n_clocks", F.lit(0)).alias("n_clocks"), F.coalesce("ungrounded", none).alias("ungrounded")).withColumn("grounded", F.size("ungrounded") == 0)
