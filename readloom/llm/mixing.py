"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Every document gets the exponential key ``-ln(u) / w`` with u from a hash of its
doc_id, so reruns agree. A source whose target is q whole epochs and a rest r
takes all its documents q times and then the first ones by key until r words are
taken. The prefix sums need no task that holds a whole source: the keys of a
source fall into ordered buckets, bucket totals are prefix-summed (a small
table), and only the one bucket in which a source's budget ends is sorted. At
last up to three documents change sides, each the one that brings the words
taken nearest to the target.

Defined cases: null or empty text has size 0 and is taken by whole epochs only;
a null source is a source of its own, last in order; a null or non-positive
quality weight counts as 1; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import text_key, word_count, written

BUCKETS = 4096  # ordered key buckets of a source
CLOSING = 3  # documents that may change sides to bring a source to its target


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, total: Column | None = None) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row a source.

    Sources in order of their names, null last, get the weights in turn, share the
    total, and stop at ``max_epochs`` times their size; the excess goes to the
    others by weight. Solved in closed form: in order of cap/weight the first k
    sources are full, the others have ``level * weight``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(max_epochs))})
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumns(
        {
            "left": (total if total is not None else F.sum("source_size").over(everything)) - F.coalesce(F.sum("cap").over(upto), zero),
            "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), zero),
        }
    )
    # Level if this source and all after it were not full; the first that holds it decides.
    per = per.withColumn("level", F.when(F.col("left") / F.col("left_w") <= F.col("cap") / F.col("w"), F.col("left") / F.col("left_w")))
    level = F.first("level", ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 11,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, k, size, source_size, target, epochs, taken): one row a document.

    ``quality`` has rows (id, weight); of several for one id the largest counts.
    ``epochs`` is how often the document is taken, ``taken`` that many times its
    size. ``k`` tells rows of one id apart.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if quality is None:
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        q = quality.select(F.col(id_col).alias("qid"), F.col("weight").cast("double").alias("w")).groupBy("qid").agg(F.max("w").alias("w"))
        rows = rows.join(q, rows["id"] == q["qid"], "left").drop("qid").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    # Words move as numbers from here on; texts never do.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = rows.withColumn("key", -F.log(u) / F.col("w"))
    rows = rows.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("long"))
    rows = written(rows, "sizes")
    targets = source_targets(rows, weights, max_epochs)
    whole = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_epochs))
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    names = targets.withColumnRenamed("source", "s")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    sums = sums.join(names, sums["source"].eqNullSafe(names["s"])).drop("s")
    before = F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("b") > F.col("rest")))
    # The bucket in which the budget ends (none: every document fits).
    ends = ends.groupBy(F.col("source").alias("es")).agg(F.min(F.struct("bucket", "before")).alias("e")).select("es", F.col("e.bucket").alias("end"), F.col("e.before").alias("before"))
    plan = names.join(ends, names["s"].eqNullSafe(ends["es"]), "left").drop("es")
    full = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).drop("s")
    inside = full.filter(F.col("bucket") == F.col("end"))
    order = Window.partitionBy("source").orderBy("key", "id", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("fits", F.sum("size").over(order) + F.col("before") <= F.col("rest"))
    outside = full.filter(F.coalesce(F.col("bucket") != F.col("end"), F.lit(True))).withColumn("fits", F.coalesce(F.col("bucket") < F.col("end"), F.col("rest") > 0))
    chosen = inside.unionByName(outside)
    chosen = chosen.select("id", "k", "source", "size", "source_size", "target", "whole", "rest", "key", "fits")
    # Each turn adds or takes back the one document that brings its source nearest.
    for _ in range(CLOSING):
        missing = chosen.groupBy(F.col("source").alias("ms")).agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("missing"))
        near = chosen.filter((F.col("size") > 0) & (F.col("whole") < max_epochs)).join(missing, chosen["source"].eqNullSafe(missing["ms"]))
        gap = F.abs(F.col("missing") - F.when(F.col("fits"), -F.col("size")).otherwise(F.col("size")))
        turned = near.filter(gap < F.abs("missing")).groupBy("ms").agg(F.min(F.struct(gap.alias("gap"), "key", "id", "k")).alias("c"))
        chosen = chosen.join(turned, chosen["source"].eqNullSafe(turned["ms"]), "left")
        this = F.coalesce(F.col("c").isNotNull() & F.col("id").eqNullSafe(F.col("c.id")) & (F.col("k") == F.col("c.k")), F.lit(False))
        chosen = written(chosen.withColumn("fits", F.col("fits") != this).drop("ms", "c"), "mix")
    epochs = (F.col("whole") + F.when(F.col("fits") & (F.col("whole") < max_epochs), 1).otherwise(0)).cast("long")
    return chosen.select("id", "k", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))
