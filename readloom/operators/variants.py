"""Pile-ups, correction, variants and gVCF (AGG-08, AGG-10..13, AGG-21, VAR-*, PRJ-24..29, FLT-10/11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.piles import pileup_counts


def normalised_counts(counts: DataFrame, by_strand: bool = False) -> DataFrame:
    """Counts as shares of the column's depth, or of its strand's total."""
    names = [c for c in counts.columns if c.endswith(("_fwd", "_rev"))]
    total = lambda s: sum((F.col(c) for c in names if c.endswith(s)), F.lit(0))
    per = {c: F.coalesce(F.col(c) / F.nullif(total(c[-4:]) if by_strand else F.col("depth"), F.lit(0)), F.lit(0.0)) for c in names}
    return counts.withColumns(per)


def majority_vote(columns: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """(key, base) of rows (key, base, target_base): the most frequent base if at least
    ``least`` hold it; ties and rarer ones keep the target's base."""
    n = columns.groupBy(*key, "target_base", "base").agg(F.count("*").alias("n"))
    top = n.groupBy(*key, "target_base").agg(F.max("n").alias("top"))
    best = n.join(top, [*key, "target_base"]).filter("n = top").groupBy(*key, "target_base", "top").agg(F.count("*").alias("tied"), F.min("base").alias("b"))
    return best.select(*key, F.when((F.col("top") >= least) & (F.col("tied") == 1), F.col("b")).otherwise(F.col("target_base")).alias("base"))


def is_valid(ref: Column, alts: Column) -> Column:
    """Nothing empty, and not all alternatives equal to the reference."""
    return (ref != "") & (F.size(alts) > 0) & F.forall(alts, lambda a: a != "") & ~F.forall(alts, lambda a: a == ref)


def variant_end(pos: Column, ref: Column, info_end: Column, format_len: Column) -> Column:
    return F.coalesce(info_end, pos + format_len, pos + F.greatest(F.lit(1), F.length(ref)))


def normalise_genotype(ref: Column, alleles: Column, qual: Column, least_qual: float) -> Column:
    """alts (distinct, sorted, without the reference), GT of sorted allele numbers, GQ and FILTER."""
    alts = F.array_sort(F.array_distinct(F.filter(alleles, lambda a: a != ref)))
    numbers = F.array_sort(F.transform(alleles, lambda a: F.when(a == ref, F.lit(0)).otherwise(F.array_position(alts, a)).cast("int")))
    return F.struct(alts.alias("alts"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), "/").alias("gt"), F.round(qual).cast("int").alias("gq"), F.when(qual >= least_qual, F.lit("PASS")).otherwise(F.lit("LowQual")).alias("filter"))


def hemizygous_filter(variants: DataFrame, haploid: DataFrame) -> DataFrame:
    """Inside haploid regions only variants with one allele stay; those that straddle a
    region's edge stay unchanged."""
    from readloom.operators.intervals import overlap_join

    hit = overlap_join(variants.select("seq_id", "start", "end").distinct(), haploid, ["seq_id"]).filter("start >= r_start and end <= r_end").select("seq_id", "start", "end").distinct().withColumn("inside", F.lit(True))
    kept = variants.join(hit, ["seq_id", "start", "end"], "left")
    one = F.size(F.array_distinct(F.split("gt", "[/|]"))) == 1
    return kept.filter(F.col("inside").isNull() | one).drop("inside")


def variant_columns(columns: DataFrame) -> DataFrame:
    """Columns (seq_id, major, minor, ref, call) with whether they vary: an insertion run
    varies as a whole when its major column or any member does."""
    differs = F.when(F.col("ref") != F.col("call"), 1).otherwise(0)
    w = Window.partitionBy("seq_id", "major")
    return columns.withColumn("varies", F.when(F.max("minor").over(w) > 0, F.max(differs).over(w)).otherwise(differs) == 1)


def decode(probabilities: Column, symbols: str = "*ACGT", cap: float = 70.0) -> Column:
    """Base of the largest probability and its capped Phred quality."""
    from readloom.functions.numeric import argmax_index, capped_phred

    return F.struct(F.substr(F.lit(symbols), argmax_index(probabilities) + 1, F.lit(1)).alias("base"), capped_phred(1 - F.array_max(probabilities), cap).alias("q"))


def merge_variants(variants: DataFrame) -> DataFrame:
    """Groups of variants of one sequence that overlap or touch, by the running maximum of ends."""
    w = Window.partitionBy("seq_id").orderBy("pos", "end", "var")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = variants.withColumn("__new", F.when(before.isNull() | (F.col("pos") > before), 1).otherwise(0))
    return marked.withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def normalise_variant(ref: str, alts: list[str], pos: int, draft: str) -> tuple[int, str, list[str]]:
    """Left-aligned and trimmed alleles: common last bases go (an allele that would be
    empty takes the base before from the draft), then common first ones while all have more."""
    ref, alts = ref, list(alts)
    while True:
        alleles = [ref, *alts]
        if all(alleles) and len({a[-1] for a in alleles}) == 1 and (min(map(len, alleles)) > 1 or pos > 0):
            ref, alts = ref[:-1], [a[:-1] for a in alts]
        elif not all(alleles):
            if pos == 0:
                nxt = draft[pos + len(ref) : pos + len(ref) + 1]
                ref, alts = ref + nxt, [a + nxt for a in alts]
                break
            pos -= 1
            ref, alts = draft[pos] + ref, [draft[pos] + a for a in alts]
        else:
            break
        if len({*alts, ref}) == 1:
            break
    while min(len(a) for a in (ref, *alts)) > 1 and len({a[0] for a in (ref, *alts)}) == 1:
        pos, ref, alts = pos + 1, ref[1:], [a[1:] for a in alts]
    return pos, ref, alts


def gvcf_compact(records: DataFrame, thresholds: list[int], margins: list[int]) -> DataFrame:
    """Blocks (seq_id, start, end, gt, gq) of consecutive one-base reference records of
    equal GT whose GQ stays within the margin of the block's first. The block depends
    on its first record, so a contig is walked in order; records stream through the
    task batch by batch and only the open block is held."""
    at = np.array(thresholds)
    steps = np.array([margins[0], *margins])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for df in batches:
            out = []
            for seq_id, pos, gt, gq in df[["seq_id", "pos", "gt", "gq"]].itertuples(index=False):
                if block and (seq_id, gt) == (block[0], block[3]) and pos == block[2] and abs(gq - block[5]) <= block[6]:
                    block[2], block[4] = pos + 1, min(block[4], gq)
                else:
                    if block:
                        out.append(block[:5])
                    block = [seq_id, pos, pos + 1, gt, gq, gq, int(steps[np.searchsorted(at, gq, "right")])]
            if out:
                yield pd.DataFrame(out, columns=["seq_id", "start", "end", "gt", "gq"])
        if block:
            yield pd.DataFrame([block[:5]], columns=["seq_id", "start", "end", "gt", "gq"])

    ordered = records.repartition("seq_id").sortWithinPartitions("seq_id", "pos")
    return ordered.mapInPandas(walk, "seq_id string, start long, end long, gt string, gq int")


def correct_piles(targets: DataFrame, overlaps: DataFrame, window: int = 4096, top: int = 30, least: int = 2) -> DataFrame:
    """(name, seq): targets corrected by the majority of the reads aligned to them.

    ``targets`` (name, seq); ``overlaps`` (qname, tname, tstart, cigar, seq of the
    aligned part, accuracy, long_indel). Of each window of a target the ``top`` overlaps by
    accuracy count; a window of fewer than ``least`` is empty and cuts the target.
    """
    from readloom.operators.consensus import join_windows

    good = overlaps.filter("qname != tname and not long_indel")
    w = Window.partitionBy("tname", "win").orderBy(F.desc("accuracy"), "qname")
    spread = good.withColumn("win", F.floor(F.col("tstart") / window)).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    piles = spread.select(F.col("tname").alias("rname"), F.lit(0).alias("flag"), F.col("tstart").alias("pos"), "cigar", "seq")
    counts = pileup_counts(piles)
    votes = counts.filter("minor = 0").select("rname", "major", F.col("depth"), F.array(*[F.struct((F.col(f"{b}_fwd")).alias("n"), F.lit(b.upper() if b != "del" else "").alias("b")) for b in ("a", "c", "g", "t", "del")]).alias("v"))
    bases = targets.select("name", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("major", "base"))
    full = bases.join(votes, (bases["name"] == votes["rname"]) & (bases["major"] == votes["major"]), "left").select("name", bases["major"], "base", "depth", "v")
    best = F.array_max("v")
    tied = F.size(F.filter("v", lambda x: x["n"] == best["n"])) > 1
    called = F.when(F.col("v").isNull() | (best["n"] < 2) | tied, F.col("base")).otherwise(best["b"])
    wins = full.withColumns({"i": F.floor(F.col("major") / window), "call": called}).groupBy("name", "i").agg(F.max(F.coalesce("depth", F.lit(0))).alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("major", "call"))), lambda x: x["call"]), "").alias("s"))
    return join_windows(wins.select("name", "i", F.when(F.col("d") >= least, F.col("s")).otherwise("").alias("part")))


def variants_of_columns(majors: list[int], minors: list[int], ref: str, calls: list[str], draft: str) -> list[tuple[int, str, list[str]]]:
    """(pos, ref, alleles) of the runs of varying columns; ``*`` is a gap, one call string
    a haplotype. An insertion run varies as a whole; an allele that would be empty takes
    the draft's base before."""
    n = len(majors)
    differs = [any(c[i] != ref[i] for c in calls) for i in range(n)]
    runs_of: dict[int, list[int]] = {}
    for i, m in enumerate(majors):
        runs_of.setdefault(m, []).append(i)
    for places in runs_of.values():
        if len(places) > 1 and any(differs[i] for i in places):
            for i in places:
                differs[i] = True
    out, i = [], 0
    while i < n:
        if not differs[i]:
            i += 1
            continue
        j = i
        while j < n and differs[j] and (j == i or majors[j] - majors[j - 1] <= 1):
            j += 1
        pos = majors[i] if minors[i] == 0 else majors[i] + 1
        r, alleles = ref[i:j].replace("*", ""), [c[i:j].replace("*", "") for c in calls]
        if not r or not all(alleles):
            if pos > 0:
                pos -= 1
                r, alleles = draft[pos] + r, [draft[pos] + a for a in alleles]
            else:
                nxt = draft[len(r) : len(r) + 1]
                r, alleles = r + nxt, [a + nxt for a in alleles]
        if any(a != r for a in alleles):
            out.append((pos, r, alleles))
        i = j
    return out


def column_windows(insertions: list[int], limit: int) -> list[tuple[int, int]]:
    """Target windows of at most ``limit`` columns (a base and its insertions), each of
    one position at least; a window begins where the last one ended."""
    out, start, used = [], 0, 0
    for p, ins in enumerate(insertions):
        if p > start and used + 1 + ins > limit:
            out.append((start, p))
            start, used = p, 0
        used += 1 + ins
    return [*out, (start, len(insertions))] if insertions else []


def poly_tail_settings(reads: DataFrame, settings: DataFrame) -> DataFrame:
    """Reads with the poly-tail settings of their barcode, else the default row (null
    barcode); disabled ones are not estimated."""
    default = settings.filter("barcode is null").drop("barcode")
    own = settings.filter("barcode is not null")
    rest = [c for c in settings.columns if c != "barcode"]
    joined = reads.join(own, "barcode", "left").join(F.broadcast(default.limit(1).select(*[F.col(c).alias(f"__{c}") for c in rest])), F.lit(True), "left")
    full = joined.withColumns({c: F.coalesce(c, f"__{c}") for c in rest}).drop(*[f"__{c}" for c in rest])
    return full.filter(F.coalesce("enabled", F.lit(True)))
