"""Operators on reads and alignment records (SRC-*, FLT-*, PRJ-*, JOI-*, WIN-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import numeric

SECONDARY, SUPPLEMENTARY, UNMAPPED, REVERSE, QCFAIL, DUPLICATE = 256, 2048, 4, 16, 512, 1024


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def primary_only(records: DataFrame) -> DataFrame:
    return records.filter(~has_flag(F.col("flag"), SECONDARY | SUPPLEMENTARY))


def select_reads(reads: DataFrame, allowed: DataFrame | None = None, ignored: DataFrame | None = None, on: str = "read_id") -> DataFrame:
    """Reads of an allow list but not of an ignore list."""
    if allowed is not None:
        reads = reads.join(allowed.select(on), on, "left_semi")
    return reads if ignored is None else reads.join(ignored.select(on), on, "left_anti")


def filter_reads(reads: DataFrame, min_q: float = 0, min_len: int = 5, drop: DataFrame | None = None, q: str = "mean_q") -> DataFrame:
    """Drops reads of low quality (if asked for), short ones and listed ones."""
    kept = reads.filter(~((F.lit(min_q) > 0) & (F.col(q) < min_q)) & (F.length("seq") >= min_len))
    return kept if drop is None else kept.join(drop.select("read_id"), "read_id", "left_anti")


def pileup_filter(records: DataFrame, min_mapq: int = 1, min_snp_accuracy: float = 0.0, tag: str | None = None, tag_value: int = 0, keep_missing: bool = False, read_group: str | None = None) -> DataFrame:
    """Records for a pile-up. With ``keep_missing`` a record without the tag passes
    before its read group is looked at."""
    bad = has_flag(F.col("flag"), UNMAPPED | SECONDARY | SUPPLEMENTARY | QCFAIL | DUPLICATE)
    kept = records.filter(~bad & (F.col("mapq") >= min_mapq) & (F.col("snp_accuracy") >= min_snp_accuracy))
    group = F.lit(True) if read_group is None else F.col("rg_id") == read_group
    if tag is None:
        return kept.filter(group)
    missing = F.lit(keep_missing) & F.col(tag).isNull()
    return kept.filter(missing | ((F.col(tag) == tag_value) & group))


def neighbours(reads: DataFrame) -> DataFrame:
    """Previous and next read of a channel by mux and read number."""
    w = Window.partitionBy("channel").orderBy("mux", "read_number", "read_id")
    return reads.withColumns({"prev_read": F.lag("read_id").over(w), "next_read": F.lead("read_id").over(w)})


def alignment_counts(records: DataFrame, on: str = "qname") -> DataFrame:
    """All mapped records of a name, and the secondary and supplementary ones among them."""
    one = lambda bit: F.sum(F.when(has_flag(F.col("flag"), bit), 1).otherwise(0)).cast("long")
    return records.groupBy(on).agg(F.count("*").alias("num_alignments"), one(SECONDARY).alias("num_secondary"), one(SUPPLEMENTARY).alias("num_supplementary"))


def with_read_groups(reads: DataFrame, groups: DataFrame, on: str = "rg_id") -> DataFrame:
    """Read-group facts. The dimension is small; whether it is broadcast is left to
    its size at run time."""
    return reads.join(groups, on, "left")


def sample_sheet_row(reads: DataFrame, sheet: DataFrame, present: list[str], barcode: str = "barcode") -> DataFrame:
    """Alias of the first sheet row that agrees on the columns the sheet has."""
    first = sheet.groupBy(*present, barcode).agg(F.min_by("alias", "row").alias("alias"))
    return reads.join(first, [*present, barcode], "left")


def template_times(reads: DataFrame) -> DataFrame:
    """Template start, duration and number of events; zero guards as null-free zeros."""
    ns, ts, rate, stride = F.col("num_samples"), F.col("num_trimmed_samples"), F.col("sample_rate"), F.col("model_stride")
    du = F.when(rate > 0, ns / rate).otherwise(0.0)
    start = F.col("start_time_ms") / 1000.0 + F.when((du > 0) & (ns > 0), ts / (ns / du)).otherwise(0.0)
    return reads.withColumns(
        {
            "template_start": start,
            "template_duration": F.when(rate > 0, (ns - ts) / rate).otherwise(0.0),
            "num_events_template": F.when(stride > 0, F.floor((ns - ts) / stride)).otherwise(0).cast("long"),
        }
    )


def pair_candidates(reads: DataFrame, max_gap_ms: int = 10_000, min_len: int = 500, min_q: float = 8) -> DataFrame:
    """Each read with the next one of its channel, run and flow cell, where the gap
    between end and start, lengths and qualities allow a template and its complement."""
    w = Window.partitionBy("channel", "run_id", "flowcell_id").orderBy("start_time_ms", "read_id")
    end = F.col("start_time_ms") + F.floor(F.col("num_samples") * 1000 / F.col("sample_rate")).cast("long")
    timed = reads.withColumns({"end_ms": end, **{f"next_{c}": F.lead(c).over(w) for c in ("read_id", "start_time_ms", "seq_len", "mean_q")}})
    gap = F.col("next_start_time_ms") - F.col("end_ms")
    ok = (gap >= 0) & (gap < max_gap_ms) & (F.least("seq_len", "next_seq_len") >= min_len) & (F.least("mean_q", "next_mean_q") >= min_q)
    ratio = F.least("seq_len", "next_seq_len") / F.greatest("seq_len", "next_seq_len")
    early = (gap <= 100) & (ratio >= 0.98) & (F.least("seq_len", "next_seq_len") >= 5000)
    return timed.filter(ok).select(F.col("read_id").alias("template_id"), F.col("next_read_id").alias("complement_id"), gap.alias("gap_ms"), early.alias("early_accept"))


def pair_alignment_ok(mapq: Column, frac: Column, reverse: Column, end_gap: Column, overlap: Column) -> Column:
    """Whether the complement's alignment on the template makes a pair."""
    return (mapq >= 50) & (frac > 0.8) & reverse & (end_gap <= 500) & (overlap > 50)


def last_pairs(pairs: DataFrame) -> DataFrame:
    """(template_id, complement_id): of the lines of a template the last."""
    return pairs.groupBy("template_id").agg(F.max_by("complement_id", "line").alias("complement_id"))


def pairs_from_list(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads of listed pairs, side by side; all others are dropped. The last line of a template wins."""
    last = last_pairs(pairs)
    t = reads.select(*[F.col(c).alias(f"template_{c}") for c in reads.columns if c != "read_id"], F.col("read_id").alias("template_id"))
    c = reads.select(*[F.col(c).alias(f"complement_{c}") for c in reads.columns if c != "read_id"], F.col("read_id").alias("complement_id"))
    return last.join(t, "template_id").join(c, "complement_id")


def tag_duplex_parents(reads: DataFrame, duplex: DataFrame) -> DataFrame:
    """Simplex reads with whether a duplex read ``template;complement`` was made of them."""
    parents = duplex.select(F.explode(F.split("read_id", ";")).alias("read_id")).distinct().withColumn("is_duplex_parent", F.lit(True))
    return reads.join(parents, "read_id", "left").withColumn("is_duplex_parent", F.coalesce("is_duplex_parent", F.lit(False)))


def complete_groups(subreads: DataFrame, group: str = "read_tag", expected: str = "split_count", order: str = "subread_id") -> DataFrame:
    """Sub-reads of groups of which all have arrived, renumbered from 0."""
    sizes = subreads.groupBy(group).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy(order)
    return subreads.join(sizes, group).filter(F.col("__n") == F.col(expected)).drop("__n").withColumn("subread_number", (F.row_number().over(w) - 1).cast("long"))


def combine_trims(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column, length: Column) -> Column:
    """The innermost of two trim intervals; the whole read if nothing would be left."""
    begin, end = F.greatest(a_begin, b_begin), F.least(a_end, b_end)
    bad = (begin >= end) | (begin < 0) | (end > length)
    return F.struct(F.when(bad, 0).otherwise(begin).cast("int").alias("begin"), F.when(bad, length).otherwise(end).cast("int").alias("end"))


def adapter_trim(length: Column, front_score: Column, front_end: Column, rear_score: Column, rear_start: Column, least: float = 0.8) -> Column:
    return F.struct(F.when(front_score >= least, front_end + 1).otherwise(0).cast("int").alias("begin"), F.when(rear_score >= least, rear_start).otherwise(length).cast("int").alias("end"))


def barcode_trim(length: Column, top_score: Column, top_end: Column, bottom_score: Column, bottom_start: Column, use_top: Column, least: float = 0.6) -> Column:
    """Ends whose flank score is above ``least`` move; overlapping ends keep the better one."""
    begin = F.when(top_score > least, top_end + 1).otherwise(0)
    end = F.when(bottom_score > least, bottom_start).otherwise(length)
    clash = begin > end
    return F.struct(F.when(clash & ~use_top, 0).otherwise(begin).cast("int").alias("begin"), F.when(clash & use_top, length).otherwise(end).cast("int").alias("end"))


def shift_barcode(pos: Column, front_trim: Column, kept_len: Column) -> Column:
    """A barcode position after the front was trimmed."""
    return F.when(pos < 0, pos).otherwise(F.greatest(F.lit(0), F.least(pos - front_trim, kept_len)))


def apply_trim(reads: DataFrame, begin: str = "trim_begin", end: str = "trim_end", rna: bool = False) -> DataFrame:
    """Sequence and qualities of the interval; RNA runs the other way round."""
    n = F.length("seq")
    lo = n - F.col(end) if rna else F.col(begin)
    size = F.col(end) - F.col(begin)
    return reads.withColumns({c: F.substr(F.col(c), (lo + 1).cast("int"), size.cast("int")) for c in ("seq", "qstring")})


def sub_reads(reads: DataFrame, pieces: str = "pieces") -> DataFrame:
    """One row a piece (begin, end) of a read, with derived ids."""
    from readloom.functions.seq import derive_uuid

    rows = reads.select("*", F.posexplode(pieces).alias("subread_id", "piece")).drop(pieces)
    out = rows.withColumns({c: F.substr(F.col(c), F.col("piece.begin") + 1, F.col("piece.end") - F.col("piece.begin")) for c in ("seq", "qstring")})
    return out.withColumns({"parent_read_id": F.col("read_id"), "read_id": derive_uuid(F.col("read_id"), F.col("subread_id").cast("string"))}).drop("piece")


def resume(finished: DataFrame, todo: DataFrame) -> DataFrame:
    """Ids still to do: finished rows count under their parent id where they have one."""
    done = finished.select(F.coalesce("pi", "qname").alias("read_id")).distinct()
    return todo.join(done, "read_id", "left_anti")


def header_conflicts(sequences: DataFrame) -> DataFrame:
    """Reference names that occur with different lengths."""
    return sequences.groupBy("name").agg(F.countDistinct("length").alias("n")).filter("n > 1")


def merge_headers(sequences: DataFrame) -> DataFrame:
    """Union of reference lists with a common number, in order of first file and place."""
    first = sequences.groupBy("name", "length").agg(F.min(F.struct("file", "tid")).alias("at"))
    return first.withColumn("new_tid", (F.row_number().over(Window.orderBy("at.file", "at.tid", "name")) - 1).cast("long")).select("name", "length", "new_tid")


def output_alias(alias: Column, barcode: Column, tags: list[Column], kit: Column) -> Column:
    """Folder name of a read: alias, normalised barcode, tags without kit prefix, or unclassified."""
    from readloom.functions.seq import UNCLASSIFIED, normalize_barcode

    given = lambda c: F.when(c != "", c)
    bare = [given(F.replace(t, F.concat(kit, F.lit("_")), F.lit(""))) for t in tags]
    return F.coalesce(given(alias), normalize_barcode(given(barcode)), *bare, F.lit(UNCLASSIFIED))


def nested_path(experiment: Column, sample: Column, stamp: Column, position: Column, flowcell: Column, run: Column, passed: Column, alias: Column, kind: str = "bam") -> Column:
    """``experiment/sample/date_pos_flowcell_run8/kind_pass|fail/alias``."""
    run_dir = F.concat_ws("_", stamp, position, flowcell, F.substring(run, 1, 8))
    return F.concat_ws("/", experiment, sample, run_dir, F.when(passed, F.lit(f"{kind}_pass")).otherwise(F.lit(f"{kind}_fail")), alias)


def mean_q(reads: DataFrame) -> DataFrame:
    return reads.withColumn("mean_q", numeric.mean_qscore(F.col("qstring")))
