"""Sampled statistics as a table of lines (SNK-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats_lines(samples: DataFrame, pattern: str = ".*") -> DataFrame:
    """(elapsed_ms, line): a heading (null elapsed_ms) with the names that ``pattern``
    matches as a whole, sorted, and one line a time with their values, empty where there
    is none. ``samples``: elapsed_ms, name, value; of a repeated name the greatest value.

    The names are those of the counters of a run, some dozens: they travel as one row."""
    names = samples.filter(F.col("name").rlike(f"^(?:{pattern})$")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    once = samples.groupBy("elapsed_ms", "name").agg(F.max("value").alias("value"))
    per = once.groupBy("elapsed_ms").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("string").alias("value")))).alias("values"))
    cells = F.transform("names", lambda n: F.concat(F.lit(","), F.coalesce(F.try_element_at("values", n), F.lit(""))))
    body = per.join(F.broadcast(names), F.lit(True)).select("elapsed_ms", F.concat(F.col("elapsed_ms").cast("string"), F.array_join(cells, "")).alias("line"))
    kind = samples.schema["elapsed_ms"].dataType
    head = names.select(F.lit(None).cast(kind).alias("elapsed_ms"), F.concat(F.lit("elapsed_ms"), F.array_join(F.transform("names", lambda n: F.concat(F.lit(","), n)), "")).alias("line"))
    return head.union(body)
