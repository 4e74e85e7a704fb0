"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side minima and two equi-joins on the
node (hubs are skewed join partitions, which AQE splits); the edge table is
written after each round. Nothing but the round's size and checksum reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import release, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, 7, u))")).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for all nodes of edges (u, v): label is the least node reachable."""
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    was = _state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        now = _state(after)
        release(e)
        e, done = after, now == was
        was = now
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v")).distinct()
