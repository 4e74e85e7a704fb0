"""Interval operators: merge, complement, overlap, tiling, runs (AGG-09, AGG-11, JOI-05..08, WIN-03..07, WIN-12)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, key: list[str], start: str, end: str, gap: int, more: list[str]) -> DataFrame:
    """Unions of intervals of one key (and ``more``) that are at most ``gap`` apart."""
    part = [*key, *more]
    order = Window.partitionBy(*part).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    marked = df.select(*part, start, end).distinct().select(*part, start, end, new.alias("__new"))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("__island", island).groupBy(*part, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_intervals(df: DataFrame, key: list[str], start: str = "start", end: str = "end", gap: int = 0, bin_size: int = 1 << 20) -> DataFrame:
    """Union of half-open intervals by key. ``gap`` 0 joins touching ones, 1 those
    one apart (inclusive ends), larger values nearer ones. First inside bins of the
    start, so that one contig's intervals are sorted by many tasks, then the few
    unions of the bins."""
    binned = df.select(*key, start, end).withColumn("__bin", F.floor(F.col(start) / bin_size))
    return _islands(_islands(binned, key, start, end, gap, ["__bin"]), key, start, end, gap, [])


def complement(regions: DataFrame, covered: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of disjoint regions no covered interval takes.

    The join is by bins of the inputs' mean lengths; unions are together no longer than what
    they unite, so that neither side has more than about two copies a row. A row at the end
    of each region closes its last gap.
    """
    size = max(_mean_length(regions, start, end), _mean_length(covered, start, end))
    spans = regions.select(*key, F.col(start).alias("rs"), F.col(end).alias("re"))
    hits = overlap_join(regions.select(*key, start, end), merge_intervals(covered, key, start, end), key, start=start, end=end, bin_size=size)
    hits = hits.select(*key, F.col(start).alias("rs"), F.col(end).alias("re"), F.col(f"r_{start}").alias("s"), F.col(f"r_{end}").alias("e"))
    cut = hits.unionByName(spans.withColumns({"s": F.col("re"), "e": F.col("re")}))
    before = F.lag("e").over(Window.partitionBy(*key, "rs", "re").orderBy("s", "e"))
    return cut.select(*key, F.coalesce(before, F.col("rs")).alias(start), F.col("s").alias(end)).filter(F.col(start) < F.col(end))


def processed_regions(samples: DataFrame, key: list[str], merge: bool = False, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end) of the regions that samples [start, end) cover; empty ones are left
    out. Distinct ones, or, merged, unions of those that overlap or touch."""
    kept = samples.select(*key, start, end).filter(F.col(start) < F.col(end))
    return merge_intervals(kept, key, start, end) if merge else kept.distinct()


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, inclusive: bool = False) -> Column:
    return ~((a_start > b_end) | (a_end < b_start)) if inclusive else ~((a_start >= b_end) | (a_end <= b_start))


def _mean_length(df: DataFrame, start: str, end: str) -> int:
    """Rounded up to a power of two, 16 at least."""
    mean = df.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 0
    return 1 << max(4, math.ceil(math.log2(max(mean, 1))))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", start: str = "start", end: str = "end", inclusive: bool = False, bin_size: int | None = None) -> DataFrame:
    """Range join as an equi-join on bins, by default of the mean length of the side of longer intervals, so that a row has about two copies and meets its neighbourhood only. Both sides are repeated for the bins they
    touch, a pair is taken in the first common bin only; ``how`` is inner,
    left_semi or left_anti. Right columns get the prefix ``r_``."""
    more = 0 if inclusive else 1
    bin_size = bin_size or max(_mean_length(left, start, end), _mean_length(right, start, end))
    bins = lambda d: F.sequence(F.floor(d[start] / bin_size), F.greatest(F.floor(d[start] / bin_size), F.floor((d[end] - more) / bin_size)))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(bins(right)).alias("r_bin"))
    if how == "inner":
        left_binned = left.withColumn("__bin", F.explode(bins(left)))
        first = F.greatest(F.floor(left_binned[start] / bin_size), F.floor(r[f"r_{start}"] / bin_size))
        on = [left_binned[k] == r[f"r_{k}"] for k in key] + [left_binned["__bin"] == r["r_bin"], overlaps(left_binned[start], left_binned[end], r[f"r_{start}"], r[f"r_{end}"], inclusive), left_binned["__bin"] == first]
        return left_binned.join(r, on).drop("__bin", "r_bin")
    # Semi and anti joins need the left row once: hits are found on its interval alone.
    spans = left.select(*key, start, end).distinct()
    hits = overlap_join(spans, right, key, "inner", start, end, inclusive, bin_size).select(*key, start, end).distinct()
    return left.join(hits, [*key, start, end], how)


def overlap_counts(left: DataFrame, right: DataFrame, key: list[str], ident: str, **options) -> DataFrame:
    """Left rows with the number of right intervals they hit."""
    hits = overlap_join(left, right, key, **options).groupBy(ident).agg(F.count("*").alias("hits"))
    return left.join(hits, ident, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def genome_windows(seqs: DataFrame, name: str, length: str, window: int, overlap: int) -> DataFrame:
    """Tiles of ``window`` bases with ``overlap``, the last one clipped, and the part
    of each that is its own: overlaps are halved."""
    if overlap >= window / 2:
        return seqs.select(F.col(name).alias("seq_id"), *[F.lit(0).cast("long").alias(c) for c in ("start", "end", "start_no_overlap", "end_no_overlap")]).limit(0)
    step = window - overlap
    n = F.greatest(F.ceil((F.col(length) - overlap) / step), F.lit(1))
    tiles = seqs.filter(F.col(length) > 0).select(F.col(name).alias("seq_id"), F.col(length).cast("long").alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("i"), n.alias("__tiles"))
    start, end = F.col("i") * step, F.least(F.col("i") * step + window, F.col("__n"))
    last = F.col("i") == F.col("__tiles") - 1
    return tiles.select("seq_id", start.alias("start"), end.alias("end"), F.when(F.col("i") == 0, start).otherwise(start + overlap // 2).alias("start_no_overlap"), F.when(last, end).otherwise(start + window - overlap + overlap // 2).alias("end_no_overlap"))


def chunk_starts(n: Column, size: int, overlap: int, stride: int = 1) -> Column:
    """Offsets of fixed chunks; the last is set back so that it ends at n, on the stride."""
    step = size - overlap
    last = F.greatest(n - size, F.lit(0))
    aligned = (F.ceil(last / stride) * stride).cast("long")
    regular = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long"), F.lit(step).cast("long")), lambda x: x + size < n)
    return F.when(n <= size, F.array(F.lit(0).cast("long"))).otherwise(F.concat(regular, F.array(aligned)))


def even_chunks(n: Column, most: int, overlap: int, stride: int = 1) -> Column:
    """(start, size) of as few chunks of at most ``most`` as cover n, of equal size on the stride."""
    count = F.greatest(F.ceil((n - overlap) / F.lit(most - overlap)), F.lit(1)).cast("long")
    size = F.least(F.ceil((n + (count - 1) * overlap) / count / stride) * stride, F.lit(most)).cast("long")
    size = F.when(count == 1, n.cast("long")).otherwise(size)
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct((i * (size - overlap)).alias("start"), F.least(size, n - i * (size - overlap)).cast("long").alias("size")))


def stepped_chunks(n: Column, size: int) -> Column:
    """(start, size): whole chunks while at least ``size`` is left, then the rest."""
    count = F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct((i * size).alias("start"), F.least(F.lit(size), n - i * size).cast("long").alias("size")))


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding of ``value`` along ``order`` (must be total): first, last and length."""
    w = Window.partitionBy(*key).orderBy(*order)
    v = Window.partitionBy(*key, value).orderBy(*order)
    marked = df.withColumns({"__i": F.row_number().over(w), "__j": F.row_number().over(v)}).withColumn("__run", F.col("__i") - F.col("__j"))
    return marked.groupBy(*key, value, "__run").agg(F.min("__i").alias("__a"), F.max("__i").alias("__b")).select(*key, value, (F.col("__a") - 1).cast("long").alias("run_start"), F.col("__b").cast("long").alias("run_end"))


def depth_islands(df: DataFrame, key: list[str], pos: str, depth: str, least: int) -> DataFrame:
    """Intervals of consecutive positions whose depth reaches ``least`` (not positive: all)."""
    kept = df.filter(F.col(depth) >= least) if least > 0 else df
    w = Window.partitionBy(*key).orderBy(pos)
    grouped = kept.select(*key, pos).distinct().withColumn("__g", F.col(pos) - F.row_number().over(w))
    return grouped.groupBy(*key, "__g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__g")


def merge_adjacent(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Samples whose start is the next place after an end become one."""
    return _islands(df, key, start, end, 0, [])


def cut_overlaps(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ordered samples, each overlap cut at its middle; contained ones are dropped."""
    order = Window.partitionBy(*key).orderBy(F.col(start), F.col(end).desc())
    covered = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("__c", covered).filter(F.col("__c").isNull() | (F.col(end) > F.col("__c"))).drop("__c")
    before, after = F.lag(end).over(order), F.lead(start).over(order)
    new_start = F.when(before > F.col(start), F.floor((before + F.col(start)) / 2).cast("long")).otherwise(F.col(start))
    new_end = F.when(after < F.col(end), F.floor((after + F.col(end)) / 2).cast("long")).otherwise(F.col(end))
    return kept.withColumns({"trim_start": new_start, "trim_end": new_end})
