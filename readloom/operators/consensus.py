"""Ordered concatenation: corrected windows, consensus parts, chunks (AGG-24..26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered_text(order: str, text: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def join_windows(windows: DataFrame) -> DataFrame:
    """(name, seq) from (name, i, part): runs of non-empty parts; several of one name
    get ``:0``, ``:1``, ..."""
    island = F.sum(F.when(F.col("part") == "", 1).otherwise(0)).over(Window.partitionBy("name").orderBy("i"))
    parts = windows.withColumn("__g", island).filter("part != ''").groupBy("name", "__g").agg(_ordered_text("i", "part").alias("seq"))
    w = Window.partitionBy("name")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("__g")) - 1
    return parts.select(F.when(n == 1, F.col("name")).otherwise(F.concat_ws(":", "name", k.cast("string"))).alias("name"), "seq")


def stitch_consensus(parts: DataFrame, draft: DataFrame | None = None, fill: str | None = None) -> DataFrame:
    """(name, seq) from (name, start, end, seq), in order. What a part repeats of its
    predecessor goes; a gap is filled with the draft (name, draft) or a character,
    or, without either, begins a new part ``name:k``."""
    w = Window.partitionBy("name").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = parts.withColumn("__b", before).withColumn("__b", F.coalesce("__b", "start"))
    own = F.substr(F.regexp_replace("seq", "[*]", ""), (F.greatest(F.col("__b") - F.col("start"), F.lit(0)) + 1).cast("int"), F.length("seq"))
    gap = F.greatest(F.col("start") - F.col("__b"), F.lit(0)).cast("int")
    if draft is not None:
        p = p.join(draft, "name", "left")
        text = F.concat(F.when(gap > 0, F.substr(F.col("draft"), (F.col("__b") + 1).cast("int"), gap)).otherwise(""), own)
    elif fill is not None:
        text = F.concat(F.repeat(F.lit(fill), gap), own)
    else:
        p = p.withColumn("part", own).withColumn("__new", F.when(gap > 0, 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w))
        one = p.groupBy("name", "__g").agg(_ordered_text("start", "part").alias("seq"))
        n, k = F.count("*").over(Window.partitionBy("name")), F.row_number().over(Window.partitionBy("name").orderBy("__g")) - 1
        return one.select(F.when(n == 1, F.col("name")).otherwise(F.concat_ws(":", "name", k.cast("string"))).alias("name"), "seq")
    return p.withColumn("part", text).groupBy("name").agg(_ordered_text("start", "part").alias("seq"))
