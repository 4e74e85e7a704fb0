"""Column functions on fixed inputs, kits and pile-ups."""

import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar, numeric, seq
from readloom.operators import intervals, piles, reads, variants
from readloom.sources import kits


def one(spark, col, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("chr1", ("chr1", 0, None)), ("chr1:", ("chr1", 0, None)), ("chr1:5-9", ("chr1", 4, 9)), ("chr1:-9", ("chr1", 0, 9))])
def test_regions(spark, text, want):
    assert tuple(one(spark, seq.parse_region(F.col("t")), t=(text, "string"))) == want


@pytest.mark.parametrize(("bases", "quals", "want"), [("ACGTCG", "!!!!!!", 2), ("ACGTCG", "!G!!!!", 2), ("ACGTCG", "G!!!G!GG", 3), ("CGCG", "G", 2), ("", "GG", 0), ("CG", None, 1), (None, "GG", None)])
def test_motif_mask(spark, bases, quals, want):
    got = seq.motif_mask(F.col("s"), "CG", numeric.phred_scores(F.col("q")), 38)
    assert one(spark, got, s=(bases, "string"), q=(quals, "string")) == want


def test_motif_mask_of_a_long_read(spark):
    """The work grows with the read's length, not with its square: at 120,000 bases each place is looked at once."""
    read = "ACGTRN" * 20000
    began = time.monotonic()
    assert one(spark, seq.motif_mask(F.col("s"), "CG", numeric.phred_scores(F.col("q")), 38), s=(read, "string"), q=("!" * len(read), "string")) == 20000
    assert one(spark, seq.motif_hits(F.col("s"), "RAC"), s=("GACAAC" * 2, "string")) == [0, 3, 6, 9]
    assert time.monotonic() - began < 60


@pytest.mark.parametrize(("text", "want"), [("none", 0), ("adapter,barcode", 5), ("adapter,none", None), ("primer", 2)])
def test_trim_mask(spark, text, want):
    assert one(spark, seq.trim_mask(F.col("t")), t=(text, "string")) == want


def test_sequences(spark):
    assert one(spark, seq.reverse_complement(F.lit("ACGTNacgt"))) == "acgtNACGT"
    assert one(spark, seq.motif_hits(F.lit("AAAA"), "AA")) == [0, 1, 2]
    assert one(spark, seq.motif_hits(F.lit("A"), "AA")) == []
    assert one(spark, seq.rna_polya_start(F.lit("CCAAAAAACC"))) == 2
    assert one(spark, seq.number_prefix(F.lit("12ab"))) == 12
    assert one(spark, seq.cli_token(F.lit("x --kit-name 'A B' -y"), "--kit-name")) == "A B"
    assert one(spark, seq.description_field(F.lit("a=1 b=2=3 c=4"), "c")) == "4"
    assert one(spark, seq.description_field(F.lit("a=1 b=2=3"), "b")) is None


def test_cigar(spark):
    assert one(spark, cigar.trim(F.lit("5S10M2D3I8M4S"), F.lit(7), F.lit(20))) == "8M2D3I2M"
    assert one(spark, cigar.reference_at(F.lit("5S10M2D8M"), F.lit(16))) == 13
    assert one(spark, cigar.op_counts(F.lit("5S10M2D3I8M4S"), F.lit(7)))["substitutions"] == 2


def test_numbers(spark):
    assert one(spark, numeric.mean_qscore(F.lit(""))) == 0.0
    assert one(spark, numeric.mean_qscore(F.lit("5555"))) == pytest.approx(20)
    assert one(spark, numeric.counting_quantile(F.array(*map(F.lit, [5, 1, 3, 9])), 0.5)) == 3
    assert one(spark, numeric.lower_median(F.array(*map(F.lit, [4, 1, 3, 2])))) == 2
    assert [tuple(r) for r in one(spark, numeric.run_lengths(F.array(*map(F.lit, [1, 1, 2, 1]))))] == [(0, 2, 1), (2, 3, 2), (3, 4, 1)]
    assert one(spark, numeric.run_lengths(F.array().cast("array<int>"))) == []
    assert one(spark, numeric.iso_to_ms(F.lit("junk"))) == 0
    assert one(spark, numeric.iso_to_ms(F.lit("2024-01-01T00:00:00.123456+00:00"))) == 1704067200123
    assert one(spark, numeric.mapq_of(F.lit(2))) == 3


def test_kit_file():
    toml = '[arrangement]\nname="K"\nmask1_front="ACG"\nmask1_rear="TTG"\nbarcode1_pattern="B%02i"\nfirst_index=1\nlast_index=2\n[scoring]\nmax_barcode_penalty=4\n'
    k = kits.parse_kit(toml, ">B01\nACGT\n>B02 x\nGGTT\n")
    assert k.barcodes == (("B01", "ACGT"), ("B02", "GGTT")) and k.max_penalty == 4 and not k.double_ends
    with pytest.raises(ValueError):
        kits.parse_kit(toml, ">B01\nACGT\n")
    front, rear = kits.parse_primers(">p type=front kits=X\nACG\n>q\nAAC\n", "Y")
    assert [x.name for x in front] == ["q_FWD"] and rear[0].seq == "GTT"


def test_pileup_and_intervals(spark):
    r = spark.createDataFrame([("c", 0, 10, "1S2M1I1D1M", "TACGT")], "rname string, flag int, pos long, cigar string, seq string")
    got = {(x.major, x.minor): {b for b in "acgt" if x[f"{b}_fwd"]} | ({"-"} if x.del_fwd else set()) for x in variants.pileup_counts(r).collect()}
    assert got == {(10, 0): {"a"}, (11, 0): {"c"}, (11, 1): {"g"}, (12, 0): {"-"}, (13, 0): {"t"}}
    reg = spark.createDataFrame([("c", 0, 10), ("d", 0, 5)], "k string, start long, end long")
    cov = spark.createDataFrame([("c", 2, 4), ("c", 4, 6), ("c", 9, 20)], "k string, start long, end long")
    assert sorted(tuple(x) for x in intervals.complement(reg, cov, ["k"]).collect()) == [("c", 0, 2), ("c", 6, 9), ("d", 0, 5)]
    rows = spark.createDataFrame([(1, 20, 0.9, None, "a"), (2, 20, 0.9, 1, "b"), (3, 20, 0.9, 1, "a"), (4, 0, 0.9, 1, "a")], "id int, mapq int, snp_accuracy double, hp int, rg_id string").withColumn("flag", F.lit(0))
    assert [x.id for x in reads.pileup_filter(rows, 1, 0.5, "hp", 1, True, "a").orderBy("id").collect()] == [1, 3]


def plain_piles(rows):
    want = {}
    for rname, flag, pos, text, bases in rows:
        q, r = 0, pos
        for n, op in re.findall("([0-9]+)([MIDNSHP=X])", text or ""):
            for i in range(int(n)):
                b = "-" if op == "D" else (bases or "")[q + i : q + i + 1]
                if op in "MID=X" and (op == "D" or bases is not None):
                    at = (rname, None if r is None else r - 1 if op == "I" else r + i, i + 1 if op == "I" else 0)
                    cell = want.setdefault(at, Counter())
                    cell["n"] += 1
                    if b and b in "ACGT-" and flag is not None:
                        cell[("del" if b == "-" else b.lower()) + ("_rev" if flag & 16 else "_fwd")] += 1
            q += int(n) * (op in "MIS=X")
            r = None if r is None else r + int(n) * (op in "MDN=X")
    return {(*k, x, v) for k, c in want.items() for x, v in c.items() if x != "n"}, {(*k, want.get((*k[:2], 0), c)["n"]) for k, c in want.items()}


def test_pileup_counts_of_odd_records(spark, monkeypatch):
    """Deep columns, bin borders, long insertions, odd texts, nulls; small arrays so that bins stay open over many."""
    rng = random.Random(5)
    rows = [(rng.choice(["c1", "c2", "é"]), rng.choice([0, 16]), rng.randrange(990, 1030), f"{rng.randrange(1, 9)}S{rng.randrange(0, 40)}M{rng.randrange(1, 4)}I3000N5D7=4X2H", "".join(rng.choice("ACGTN") for _ in range(60))) for _ in range(300)]
    rows += [("c1", 0, 0, "2I3M", "ACGTA"), ("c1", 0, 5, "700I1M", "ACGT" * 200), ("c1", 16, 1000, "3000D0M", ""), ("c1", 0, 7, "*", "ACG"), ("c1", 0, 7, "4M?x2M3", "AéGTACG"), ("c1", 0, 7, None, "A"), ("c1", 0, 7, "3M1D", None)]
    rows += [(None, 0, 7, "3M", "ACG"), ("c1", None, 7, "3M", "ACG"), ("c2", 0, None, "3M2I", "ACGTT"), ("c1", 0, 2**40, "3M", "AC")]
    rows += [("deep", 0, 1022, "4M", "ACGT")] * 700
    df = spark.createDataFrame(rows, "rname string, flag int, pos long, cigar string, seq string").repartition(3)
    cells, depths = plain_piles(rows)
    got = variants.pileup_counts(df).collect()
    assert len({(x.rname, x.major, x.minor) for x in got}) == len(got)
    assert {(x.rname, x.major, x.minor, c, x[c]) for x in got for c in piles.COUNTS if x[c]} == cells
    assert {(x.rname, x.major, x.minor, x.depth) for x in got} == depths
    assert variants.pileup_counts(df.limit(0)).count() == 0
    # The same in slices of a few bases, without Spark, rows sorted by bin.
    monkeypatch.setattr(piles, "WORK", 50)
    table = pa.table({n: pa.array(c, k) for n, c, k in zip(("rname", "flag", "pos", "cigar", "seq"), zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)})
    parts = pa.Table.from_batches(list(piles._count(iter(table.to_batches(max_chunksize=100)))))
    parts = parts.sort_by([("rname", "ascending"), ("bin", "ascending")])
    got = [x for b in piles._sum(iter(parts.to_batches(max_chunksize=7))) for x in b.to_pylist()]
    assert {(x["rname"], x["major"], x["minor"], c, x[c]) for x in got for c in piles.COUNTS if x[c]} == cells
    assert {(x["rname"], x["major"], x["minor"], x["depth"]) for x in got} == depths


def test_pileup_sends_bins_not_bases(spark):
    """Records that share their columns leave a task as a few rows, and one exchange is all."""
    df = spark.range(5000).selectExpr("'c' as rname", "0 as flag", "id % 7 as pos", "'100M' as cigar", "repeat('ACGT', 25) as seq")
    counts = variants.pileup_counts(df)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sum(x.depth for x in counts.collect()) == 500000
