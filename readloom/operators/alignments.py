"""Operators on alignments and overlaps (PRJ-03, PRJ-15, PRJ-24, AGG-23, JOI-15, FLT-09, WIN-08)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions.seq import reverse_complement
from readloom.operators.intervals import overlap_join
from readloom.operators.reads import REVERSE, UNMAPPED, has_flag

# Tags that describe an alignment.
ALIGNMENT_TAGS = ["SA", "NM", "ms", "AS", "nn", "de", "dv", "tp", "cm", "s1", "s2", "MD", "zd", "rl", "bh", "cs", "TS"]
LEAST_FLANK = 3


def metrics(cigar: Column, nm: Column, read_len: Column, ref_len: Column) -> Column:
    """Identity, accuracy and coverage of an alignment. Hard-clipped bases count for the
    length of the read; null where nothing is aligned."""
    ops, c = C.parse(cigar), C.op_counts(cigar, nm)
    correct = c["matches"] - c["substitutions"]
    whole = read_len + F.when(F.exists(ops, lambda o: o["op"] == "H"), c["clips"]).otherwise(0)
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return F.struct(
        c["matches"].alias("aligned"), correct.alias("correct"), share(correct, c["matches"]).alias("identity"),
        share(correct, c["matches"] + c["insertions"] + c["deletions"]).alias("accuracy"), share(c["matches"], F.least(whole, ref_len)).alias("coverage"),
    )


def strip_alignment(records: DataFrame) -> DataFrame:
    """Records as unaligned reads: bases and qualities of reverse ones turned back,
    alignment columns reset, alignment tags gone. Columns that are not there stay away."""
    back = has_flag(F.col("flag"), REVERSE)
    turned = {"seq": reverse_complement, "qual": F.reverse}
    cols = {"flag": F.lit(UNMAPPED), "rname": F.lit("*"), "pos": F.lit(-1).cast("long"), "mapq": F.lit(0), "cigar": F.lit("*"), "rnext": F.lit("*"), "pnext": F.lit(-1).cast("long"), "tlen": F.lit(0).cast("long")}
    cols |= {n: F.when(back, f(F.col(n))).otherwise(F.col(n)) for n, f in turned.items()}
    cols["tags"] = F.map_filter("tags", lambda k, _: ~k.isin(ALIGNMENT_TAGS)) if "tags" in records.columns else None
    return records.withColumns({n: c for n, c in cols.items() if n in records.columns})


def gapped_draft(draft: Column, majors: Column, minors: Column) -> Column:
    """The draft's base at each major column, ``*`` at insertions; fails on a place outside."""
    outside = F.raise_error(F.lit("a column lies outside of the draft")).cast("string")
    at = lambda p: F.when((p < 0) | (p >= F.length(draft)), outside).otherwise(F.substr(draft, (p + 1).cast("int"), F.lit(1)))
    return F.array_join(F.zip_with(majors, minors, lambda p, m: F.when(m == 0, at(p)).otherwise(F.lit("*"))), "")


def max_insertions(records: DataFrame) -> DataFrame:
    """(rname, major, max_ins): the longest insertion after each target position that has one."""
    placed = F.filter(C._with_offsets(C.parse(F.col("cigar")), C.REFERENCE), lambda o: o["op"] == "I")
    rows = records.select("rname", "pos", F.explode(placed).alias("o"))
    return rows.groupBy("rname", (F.col("pos") + F.col("o.at") - 1).alias("major")).agg(F.max("o.n").alias("max_ins"))


def first_overlaps(overlaps: DataFrame, order: list[str]) -> DataFrame:
    """Of the overlaps of a query with a target the first by ``order`` (ties: by the other
    columns); none of a read with itself. An aggregation with map-side minima, so a pair
    of very many overlaps does no harm."""
    rest = [*order, *[c for c in overlaps.columns if c not in ("qname", "tname", *order)]]
    least = overlaps.filter("qname != tname").groupBy("qname", "tname").agg(F.min(F.struct(*rest)).alias("o"))
    return least.select("qname", "tname", "o.*")


def overlap_piles(overlaps: DataFrame, order: list[str]) -> DataFrame:
    """The overlaps of each target's pile: first ones that lie inside both reads."""
    return first_overlaps(overlaps, order).filter("qlen >= qstart and qlen >= qend and tlen >= tstart and tlen >= tend")


def candidate_windows(majors: np.ndarray, positions: np.ndarray, size: int, flank: int, least: int = LEAST_FLANK) -> list[tuple[int, int]]:
    """Column ranges of ``size`` columns around positions, as wide a flank in front as
    leaves it behind too. A position that the last range covers is skipped, and so is one
    without a flank of ``least``; a range that would reach the end of the sample ends the search."""
    out: list[tuple[int, int]] = []
    covered = None
    flanks = np.arange(flank, least - 1, -1)
    for p in np.sort(positions).tolist():
        if covered is not None and p < covered:
            continue
        begin = np.searchsorted(majors, p - flanks)
        end = begin + size
        beyond = end >= len(majors)
        fits = p <= majors[np.minimum(end, len(majors) - 1)] - flanks
        tried = np.flatnonzero(beyond | fits)
        if not len(tried):
            continue
        k = int(tried[0])
        if beyond[k]:
            break
        out.append((int(begin[k]), int(end[k])))
        covered = int(majors[end[k] - 1]) + 1 - int(flanks[k])
    return out


def samples_around(samples: DataFrame, candidates: DataFrame, size: int, flank: int) -> DataFrame:
    """(sample, first, last, columns): ranges of samples around candidate positions, first
    and last major column. ``samples``: seq_id, sample, start, end, majors; ``candidates``:
    seq_id, pos. Positions meet samples in a binned range join; a row has one sample."""
    if size <= 0 or not 0 <= flank <= size:
        raise ValueError("the size must be positive and the flank from 0 to the size")
    points = candidates.select("seq_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    met = overlap_join(samples.select("seq_id", "sample", "start", "end"), points, ["seq_id"])
    per = met.groupBy("sample").agg(F.collect_list("r_start").alias("positions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sample, majors, positions in zip(b["sample"], b["majors"], b["positions"], strict=True):
                m = np.asarray(majors)
                out.extend((sample, int(m[a]), int(m[e - 1]), e - a) for a, e in candidate_windows(m, np.asarray(positions), size, flank))
            yield pd.DataFrame(out, columns=["sample", "first", "last", "columns"])

    kind = samples.schema["sample"].dataType.simpleString()
    return samples.join(per, "sample").select("sample", "majors", "positions").mapInPandas(run, f"sample {kind}, first long, last long, columns long")
