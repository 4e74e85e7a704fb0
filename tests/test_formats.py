"""Text formats, writers and streams."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from readloom.sources import sinks, text
from readloom.streaming import pairing


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_sam(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100\nr1\t0\tchr1\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tRG:Z:g\n")
    r = text.read_sam(spark, p).first()
    assert (r.qname, r.pos, r.cigar, r.tags["RG"], r.tags["fn"]) == ("r1", 10, "4M", "g", "a.sam")
    assert [tuple(x) for x in text.sam_references(spark.read.text(p)).collect()] == [("chr1", 100)]


def test_fastx(spark, tmp_path):
    q = put(tmp_path, "a.fq", "@r1\tRG:Z:run_hac@v1_bc\nACGT\n+\nII@I\n@r2 x\nGG\n+\n@I\n")
    rows = text.read_fastq(spark, q).collect()
    assert [(r.name, r.seq, r.qual) for r in rows] == [("r1", "ACGT", "II@I"), ("r2", "GG", "@I")]
    f = put(tmp_path, "a.fa", ">c1 d\nAC\nGT\n>c2\nTT\n")
    assert [(r.name, r.comment, r.seq) for r in text.read_fasta(spark, f).collect()] == [("c1", "d", "ACGT"), ("c2", "", "TT")]


def test_bed_and_sheet(spark, tmp_path):
    b = put(tmp_path, "a.bed", "track x\n#c\nchr1\t1\t5\nchr2\t2\t9\n")
    assert [(r.genome, r.start, r.strand) for r in text.read_bed(spark, b).collect()] == [("chr1", 1, "."), ("chr2", 2, ".")]
    with pytest.raises(ValueError):
        text.read_bed(spark, put(tmp_path, "b.bed", "chr1\t1\t5\nchr2\t2\t9\tx\n"))
    with pytest.raises(ValueError):
        text.read_sample_sheet(spark, put(tmp_path, "s.csv", "experiment_id,alias\ne,barcode01\n"))
    assert text.read_sample_sheet(spark, put(tmp_path, "t.csv", "experiment_id,barcode,alias\ne,barcode01,me\n")).count() == 1


def test_vcf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 9, "A", ["C"], 30.0)], "s string, p long, r string, a array<string>, q double")
    line = df.select(sinks.vcf_line(F.col("s"), F.col("p"), F.col("r"), F.col("a"), F.col("q"), F.lit("PASS"), F.lit("DP=3"), [("GT", F.lit("0/1")), ("GQ", F.lit("30"))]).alias("value"))
    r = text.parse_vcf(line).first()
    assert (r.seq_id, r.pos, r.alts, r.info["DP"], r.genotype["GT"]) == ("chr1", 9, ["C"], "3", "0/1")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 5, 4, "x"), ("a", 7, 0, "y"), ("a", 2, 256, "x")], "rname string, pos long, flag int, alias string")
    sinks.write_sorted(df, str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).select("rname", "pos").collect()] == [("a", 2), ("a", 7), ("b", 5)]
    more = df.union(spark.createDataFrame([("*", 0, 4, "y"), (None, None, 4, "y"), ("c", 1, 0, "y"), ("b", 4, 0, "y")], df.schema))
    header = spark.createDataFrame([("c", 0), ("b", 1)], "rname string, tid int")
    sinks.write_sorted(more, str(tmp_path / "h"), header)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "h")).select("rname", "pos").collect()] == [("c", 1), ("b", 4), ("b", 5), ("a", 2), ("a", 7), ("*", 0), (None, None)]
    sinks.write_nested(df, str(tmp_path / "n"), ["alias"])
    assert sorted(p.name for p in (tmp_path / "n").iterdir() if p.is_dir()) == ["alias=x", "alias=y"]
    out, obs = sinks.counted(df)
    sinks.discard(out)
    assert obs.get["total"] == 3 and obs.get["unmapped"] == 1 and obs.get["secondary"] == 1
    assert sinks.output_format(fastq=True, sam=True) == "fastq" and sinks.output_format() == "bam"
    reads = spark.createDataFrame([("r", 1.5, True)], "read_id string, start_time double, passes_filtering boolean")
    row = sinks.summary_rows(reads).first()
    assert row.start_time == "1.500000" and row.passes_filtering == "TRUE" and row.pore_type == ""


def drain(spark, stream, name, n):
    """Rows of a stream once there are n, or after 60 s."""
    q = stream.writeStream.format("memory").queryName(name).start()
    try:
        for _ in range(120):
            if q.exception() or spark.table(name).count() >= n:
                break
            time.sleep(0.5)
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_barrier_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, 2), ("a", 0, 2), ("b", 0, 2)], "read_tag string, subread_id long, split_count int").write.parquet(str(src))
    s = spark.readStream.schema("read_tag string, subread_id long, split_count int").parquet(str(src))
    assert sorted(drain(spark, pairing.barrier_stream(s), "barrier", 2)) == [("a", 0, 0, True), ("a", 1, 1, True)]


def test_pair_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    ms = lambda s: int((t0 + datetime.timedelta(seconds=s)).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    rows = [(f"r{i}", 1, "run", "fc", t0 + datetime.timedelta(seconds=s), ms(s), ms(s) + 1000) for i, s in enumerate([0, 3, 60, 62, 300])]
    src = tmp_path / "in"
    schema = "read_id string, channel int, run_id string, flowcell_id string, ts timestamp, start_time_ms long, end_ms long"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    assert set(drain(spark, pairing.pair_stream(s), "pairs", 2)) == {("r0", "r1", 2000), ("r2", "r3", 1000)}


def test_repeated_tag_keeps_the_last(spark):
    line = "r1\t0\tchr1\t10\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXX:Z:a\tNM:i:2"
    r = text.parse_sam(spark.createDataFrame([(line,)], "value string")).first()
    assert r.tags == {"NM": "2", "XX": "a"}
