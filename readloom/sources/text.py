"""Readers and line formats: SAM, FASTA/FASTQ, BED, PAF, VCF, sample sheets, lists (SRC-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAF = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block_len", "mapq"]
_PAF_INT = {"qlen", "qstart", "qend", "tlen", "tstart", "tend", "matches", "block_len", "mapq"}
# The columns that a sample sheet may have.
SHEET_COLUMNS = ["protocol_run_id", "flow_cell_id", "position_id", "sample_id", "experiment_id", "flow_cell_product_code", "kit", "alias", "type", "barcode"]


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True)


def parse_sam(lines: DataFrame) -> DataFrame:
    """Records of SAM text lines: the eleven columns and a map of tags (``TAG`` to text;
    of a tag that a line repeats the last)."""
    p = F.split("value", "\t")
    at = lambda i: F.get(p, F.lit(i))
    tags = F.transform(F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6), F.length(t)).alias("v")))
    last = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, i + 2, 1 << 20), lambda u: u["k"] == t["k"]))
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("@"))
    ints = {"flag": (1, "int"), "pos": (3, "long"), "mapq": (4, "int"), "pnext": (7, "long"), "tlen": (8, "long")}
    names = {"qname": 0, "rname": 2, "cigar": 5, "rnext": 6, "seq": 9, "qual": 10}
    cols = {n: at(i) for n, i in names.items()} | {n: at(i).cast(t) for n, (i, t) in ints.items()}
    cols["pos"] = cols["pos"] - 1
    order = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return rows.select(*[cols[c].alias(c) for c in order], F.map_from_entries(last).alias("tags"))


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Records of SAM files; the tag ``fn`` is the file's name where a line has none."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = _lines(spark, path).select("value", name.alias("file")).filter((F.col("value") != "") & ~F.col("value").startswith("@"))
    named = F.when(F.contains("value", F.lit("\tfn:Z:")), F.col("value")).otherwise(F.concat("value", F.lit("\tfn:Z:"), "file"))
    return parse_sam(rows.select(named.alias("value")))


def sam_header(lines: DataFrame) -> DataFrame:
    """(kind, fields) of header lines, fields as a map."""
    rows = lines.filter(F.col("value").rlike("^@[A-Z]{2}\\t"))
    p = F.split("value", "\t")
    fields = F.transform(F.slice(p, 2, F.size(p) - 1), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(4), F.length(t)).alias("v")))
    return rows.select(F.substr(F.get(p, F.lit(0)), F.lit(2), F.lit(2)).alias("kind"), F.map_from_entries(fields).alias("fields"))


def sam_references(lines: DataFrame) -> DataFrame:
    return sam_header(lines).filter("kind = 'SQ'").select(F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("long").alias("length"))


def parse_fastq(texts: DataFrame) -> DataFrame:
    """Reads of whole FASTQ texts (column ``value``): name, comment, seq, qual. Use a
    reader that never cuts a record, such as ``read_fastq``."""
    groups = F.regexp_extract_all("value", F.lit(r"@[^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*"), F.lit(0))
    lines = texts.select(F.explode(groups).alias("r")).select(F.split("r", "\n").alias("p"))
    return lines.select(*_named(F.substr(F.get("p", F.lit(0)), F.lit(2), F.length(F.get("p", F.lit(0))))), F.get("p", F.lit(1)).alias("seq"), F.get("p", F.lit(3)).alias("qual"))


def _named(head: Column) -> list[Column]:
    rest = F.regexp_replace(head, r"^\S+\s?", "")
    return [F.regexp_extract(head, r"^\S+", 0).alias("name"), rest.alias("comment")]


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """Four-line FASTQ files. A file is one task: write large inputs as many files."""
    return parse_fastq(spark.read.text(path, wholetext=True))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """Sequences of whole FASTA texts: name, comment, seq."""
    records = texts.select(F.explode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("r")).filter(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    return records.select(*_named(head), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    return parse_fasta(spark.read.text(path, wholetext=True))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED lines without headers and comments; the strand of short lines is ``.``."""
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    p = F.split("value", "\t")
    return rows.select(F.get(p, F.lit(0)).alias("genome"), F.get(p, F.lit(1)).cast("long").alias("start"), F.get(p, F.lit(2)).cast("long").alias("end"), F.coalesce(F.get(p, F.lit(5)), F.lit(".")).alias("strand"), F.col("value").alias("bed_line"))


def read_bed(spark: SparkSession, path, check: bool = True) -> DataFrame:
    """BED files; all lines must have as many columns, from 3 to 12."""
    lines = _lines(spark, path)
    out = parse_bed(lines)
    if check:
        n = out.agg(F.min(F.size(F.split("bed_line", "\t"))).alias("a"), F.max(F.size(F.split("bed_line", "\t"))).alias("b")).first()
        if n["a"] is not None and (n["a"] != n["b"] or not 3 <= n["a"] <= 12):
            raise ValueError("BED lines must have one number of columns from 3 to 12")
    return out


def parse_paf(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    cols = [F.get(p, F.lit(i)).cast("int" if c in _PAF_INT else "string").alias(c) for i, c in enumerate(PAF)]
    aux = F.array_join(F.slice(p, 13, F.greatest(F.size(p) - 12, F.lit(0))), "\t")
    return lines.select(*cols, aux.alias("aux"), paf_aux(aux, "cg").alias("cg"))


def paf_aux(aux: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(aux, rf"(?:^|\t){tag}:[AifZHB]:([^\t]*)", 1), F.lit(""))


def paf_line(cigar: Column | None = None, **cols: Column) -> Column:
    parts = [cols[c].cast("string") for c in PAF]
    return F.concat_ws("\t", *parts, *([F.concat(F.lit("cg:Z:"), cigar)] if cigar is not None else []))


def read_paf(spark: SparkSession, path) -> DataFrame:
    return parse_paf(_lines(spark, path))


def sam_tags(tags: dict[str, tuple[str, Column]]) -> Column:
    """Tags text in the given order; null values are left out."""
    return F.concat_ws("\t", *[F.concat(F.lit(f"{k}:{t}:"), v.cast("string")) for k, (t, v) in tags.items()])


def read_group_of_tags(comment: Column) -> Column:
    """run_id, model and barcode of the RG tag of a FASTQ comment."""
    rg = F.regexp_extract(comment, r"(?:^|\t)RG:Z:([^\t]*)", 1)
    pattern = r"^([^_]+)_([^@_]+)(?:@([^_]*))?(?:_(.*))?$"
    return F.struct(rg.alias("rg_id"), *[F.nullif(F.regexp_extract(rg, pattern, i), F.lit("")).alias(n) for i, n in ((1, "run_id"), (2, "model"), (3, "version"), (4, "barcode"))])


def alias_ok(alias: Column) -> Column:
    """Free text of a sample sheet: 1 to 40 of A-Za-z0-9_-, no barcode name."""
    return alias.rlike("^[A-Za-z0-9_-]{1,40}$") & ~alias.rlike("^barcode[0-9]+$") & (alias != "unclassified")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sample sheet with its row number; raises on unknown columns, several
    experiments or bad aliases."""
    df = spark.read.csv(path, header=True)
    unknown = set(df.columns) - set(SHEET_COLUMNS)
    if unknown:
        raise ValueError(f"unknown sample sheet columns: {sorted(unknown)}")
    if "experiment_id" not in df.columns:
        raise ValueError("a sample sheet needs experiment_id")
    checks = [F.countDistinct("experiment_id").alias("experiments")]
    if "alias" in df.columns:
        checks.append(F.count_if(~alias_ok(F.col("alias"))).alias("bad"))
    facts = df.agg(*checks).first().asDict()
    if facts["experiments"] > 1 or facts.get("bad"):
        raise ValueError(f"bad sample sheet: {facts}")
    return df.withColumn("row", F.monotonically_increasing_id())


def parse_list(lines: DataFrame) -> DataFrame:
    """The distinct ids of lines, blanks around them and empty lines aside."""
    return lines.select(F.trim("value").alias("read_id")).filter("read_id != ''").distinct()


def read_list(spark: SparkSession, path) -> DataFrame:
    return parse_list(_lines(spark, path))


def read_pairs(spark: SparkSession, path) -> DataFrame:
    lines = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(p, F.lit(0)).alias("template_id"), F.get(p, F.lit(1)).alias("complement_id"), "line")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Variants of VCF lines; POS becomes 0-based, INFO and the sample's fields maps."""
    p = F.split("value", "\t")
    at = lambda i: F.get(p, F.lit(i))
    info = F.transform(F.filter(F.split(at(7), ";"), lambda t: (t != ".") & (t != "")), lambda t: F.struct(F.element_at(F.split(t, "="), 1).alias("k"), F.coalesce(F.get(F.split(t, "=", 2), F.lit(1)), F.lit("")).alias("v")))
    sample = F.map_from_arrays(F.split(at(8), ":"), F.split(at(9), ":"))
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(at(0).alias("seq_id"), (at(1).cast("long") - 1).alias("pos"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).try_cast("float").alias("qual"), at(6).alias("filter"), F.map_from_entries(info).alias("info"), sample.alias("genotype"))
