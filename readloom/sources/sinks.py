"""Writers: summary TSV, PAF, SAM, FASTQ/FASTA, VCF, BED, partitioned layouts (SNK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Columns of the general and basecall groups of a run summary.
SUMMARY_COLUMNS = [
    "input_filename", "batch_id", "parent_read_id", "read_id", "run_id", "channel", "mux", "minknow_events", "start_time", "duration",
    "passes_filtering", "template_start", "num_events_template", "template_duration", "sequence_length_template", "mean_qscore_template",
    "pore_type", "experiment_id", "sample_id", "end_reason",
]
_SIX = {"start_time", "duration", "template_start", "template_duration", "mean_qscore_template"}


def summary_rows(reads: DataFrame) -> DataFrame:
    """The summary's columns in order; missing ones empty, times with six decimals, flags as TRUE or FALSE."""
    def col(c: str) -> Column:
        if c not in reads.columns:
            return F.lit("").alias(c)
        if c in _SIX:
            return F.format_string("%.6f", F.col(c).cast("double")).alias(c)
        if dict(reads.dtypes)[c] == "boolean":
            return F.upper(F.col(c).cast("string")).alias(c)
        return F.col(c)

    return reads.select(*[col(c) for c in SUMMARY_COLUMNS])


def write_summary(reads: DataFrame, path: str) -> None:
    summary_rows(reads).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def fastq_line(name: Column, seq: Column, qual: Column, comment: Column | None = None) -> Column:
    head = F.concat(F.lit("@"), name) if comment is None else F.concat_ws("\t", F.concat(F.lit("@"), name), F.when(comment != "", comment))
    return F.concat_ws("\n", head, seq, F.lit("+"), qual)


def fasta_line(name: Column, seq: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), name), seq)


def sam_line(r: DataFrame, tags: Column | None = None) -> Column:
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    parts = [(F.col(c) + 1 if c == "pos" else F.col(c)).cast("string") for c in cols]
    return F.concat_ws("\t", *parts, *([F.nullif(tags, F.lit(""))] if tags is not None else []))


def vcf_header(contigs: list[tuple[str, int]]) -> list[str]:
    lines = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowQual,Description="Low quality">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##INFO=<ID=END,Number=1,Type=Integer,Description="Block end">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">']
    return [*lines, *[f"##contig=<ID={n},length={k}>" for n, k in contigs], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def vcf_line(seq_id: Column, pos: Column, ref: Column, alts: Column, qual: Column, flt: Column, info: Column, fields: list[tuple[str, Column]], gvcf: bool = False) -> Column:
    """One record; a negative quality is missing; gVCF adds ``<*>`` to variants."""
    alt = F.array_join(F.concat(alts, F.array(F.lit("<*>"))) if gvcf else alts, ",")
    q = F.when(qual >= 0, qual.cast("string")).otherwise(".")
    return F.concat_ws("\t", seq_id, (pos + 1).cast("string"), F.lit("."), ref, alt, q, flt, F.coalesce(info, F.lit(".")), F.lit(":".join(k for k, _ in fields)), F.concat_ws(":", *[v for _, v in fields]))


def write_sorted(records: DataFrame, path: str, contigs: DataFrame | None = None) -> None:
    """Coordinate-sorted Parquet: range partitions in order, sorted inside. Contigs stand
    in the order of the header, (rname, tid) rows, or by name without one; those that it
    lacks follow by name, and unmapped records (``*`` or null) come last."""
    rows = records.withColumn("__tid", F.lit(None).cast("long")) if contigs is None else records.join(contigs.select("rname", F.col("tid").cast("long").alias("__tid")), "rname", "left").select(*records.columns, "__tid")
    unmapped = (F.coalesce(F.col("rname"), F.lit("*")) == "*").alias("__unmapped")
    by = [unmapped, F.col("__tid").asc_nulls_last(), F.col("rname").asc_nulls_last(), F.col("pos")]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tid").write.mode("overwrite").parquet(path)


def write_nested(records: DataFrame, path: str, parts: list[str]) -> None:
    """A folder for each value of the path columns. Rows are dealt by these columns and
    a salt, so that a barcode of very many reads is written by many tasks."""
    salted = records.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in records.columns if c not in parts][:1]), F.lit(16)))
    salted.repartition(*parts, "__salt").drop("__salt").write.mode("overwrite").partitionBy(*parts).parquet(path)


def checked(records: DataFrame) -> DataFrame:
    """Fails on a record whose MN differs from its sequence length."""
    ok = F.assert_true(F.col("mn").isNull() | (F.col("mn") == F.length("seq")), F.lit("MN differs from the sequence length"))
    return records.filter(ok.isNull())


def counted(records: DataFrame, name: str = "written") -> tuple[DataFrame, Observation]:
    """records with counters that are ready once they have been written."""
    obs = Observation(name)
    flag = lambda bits: F.count_if(F.col("flag").bitwiseAND(F.lit(bits)) != 0)
    return records.observe(obs, F.count(F.lit(1)).alias("total"), flag(4).alias("unmapped"), flag(256).alias("secondary"), flag(2048).alias("supplementary")), obs


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def output_format(fastq: bool = False, sam: bool = False, cram: bool = False, to_terminal: bool = False, to_pipe: bool = False) -> str:
    """Of several requests the first of: FASTQ, SAM on a terminal, SAM, CRAM, UBAM into a pipe, BAM."""
    order = ((fastq, "fastq"), (to_terminal, "sam"), (sam, "sam"), (cram, "cram"), (to_pipe, "ubam"))
    return next((name for wanted, name in order if wanted), "bam")
