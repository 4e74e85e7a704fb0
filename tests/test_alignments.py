"""Alignment operators, single-cell tags and texts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import texts as T
from readloom.operators import alignments as A
from readloom.operators import kernels as K
from readloom.operators import single_cell as S
from readloom.operators import statistics


def plain_windows(majors, positions, size, flank):
    out, edge = [], None
    for p in sorted(positions):
        if edge is not None and p < edge:
            continue
        for f in range(flank, 2, -1):
            a = next((i for i, m in enumerate(majors) if m >= p - f), len(majors))
            if a + size >= len(majors):
                return out
            if p + f <= majors[a + size]:
                out.append((a, a + size))
                edge = majors[a + size - 1] + 1 - f
                break
    return out


@pytest.mark.parametrize("seed", range(20))
def test_candidate_windows(seed):
    r = random.Random(seed)
    majors = sorted(p for p in range(100, 400) for _ in range(r.choice([1, 1, 1, 2, 5])))
    positions = r.sample(range(100, 400), 12)
    assert A.candidate_windows(np.array(majors), np.array(positions), 30, 10) == plain_windows(majors, positions, 30, 10)


def test_candidate_windows_without_room():
    majors = np.repeat(np.arange(10), 20)
    assert A.candidate_windows(majors, np.array([4]), 8, 6) == []
    assert A.candidate_windows(np.arange(10), np.array([5]), 20, 5) == []


def test_samples_around(spark):
    samples = spark.createDataFrame([("a", "s1", 0, 50, list(range(50))), ("a", "s2", 50, 100, list(range(50, 100))), ("b", "s3", 0, 50, list(range(50)))], "seq_id string, sample string, start long, end long, majors array<long>")
    found = spark.createDataFrame([("a", 20), ("a", 20), ("a", 22), ("a", 70)], "seq_id string, pos long")
    got = sorted(map(tuple, A.samples_around(samples, found, 10, 4).collect()))
    assert got == [("s1", 16, 25, 10), ("s1", 18, 27, 10), ("s2", 66, 75, 10)]
    with pytest.raises(ValueError):
        A.samples_around(samples, found, 10, 11)


def plain_tag(seq, way, begin, end):
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    text = ""
    if way == "+" and begin:
        text = seq[begin:end][:56]
    elif way == "-" and end != len(seq):
        text = back(seq[begin:end][-56:])
    if not text:
        return begin, end, None
    best = {}
    for name, p in (("switch", S.TSO), ("poly", S.POLY_T)):
        best[name] = min((K.edit_distance(p, text[i:j]), j, i) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    name = "poly" if best["poly"][0] < best["switch"][0] else "switch"
    d, j, i = best[name]
    if 1 - d / 13 <= 0.8:
        return begin, end, None
    cut = i if name == "poly" else j
    return (begin + cut, end, text[:i] if cut else None) if way == "+" else (begin, end - cut, text[:i] if cut else None)


def test_single_cell_tags(spark):
    r = random.Random(5)
    bases = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = []
    for k in range(40):
        tail = [S.TSO, S.POLY_T, "", S.TSO[:6] + S.TSO[7:], "TTTTTTGTTTTTT"][k % 5]
        s = bases(5) + bases(r.randrange(0, 30)) + tail + bases(8)
        way = "+" if k % 2 else "-"
        if way == "-":
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((f"r{k}", s, way, 5 if way == "+" else 0, len(s) if way == "+" else len(s) - 5))
    rows += [("none", "ACGT", "+", 0, 4), ("empty", "", "-", 0, 0), ("other", "ACGTACGT", "?", 2, 6)]
    df = spark.createDataFrame(rows, "read_id string, seq string, orientation string, trim_begin int, trim_end int")
    got = {x["read_id"]: (x["trim_begin"], x["trim_end"], x["tag"]) for x in S.single_cell_tags(df).collect()}
    assert got == {i: plain_tag(s, w, a, b) for i, s, w, a, b in rows}
    assert sum(t is not None for _, _, t in got.values()) > 20


def test_joined_items(spark):
    rows = [([],), (["", ""],), (["", "a", "", "b"],), (["a", ""],), ([None, "x"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<string>").select(T.join_items(F.col("v"), "|")).collect()]
    assert got == ["", "", "a||b", "a|", "x"]


def test_stats_lines(spark):
    rows = [(0, "a.x", 1), (0, "b.x", 2), (10, "b.x", 3), (10, "c", 4)]
    df = spark.createDataFrame(rows, "elapsed_ms long, name string, value long")
    assert sorted(r["line"] for r in statistics.stats_lines(df, r".*\.x").collect()) == ["0,1,2", "10,,3", "elapsed_ms,a.x,b.x"]
    assert [r["line"] for r in statistics.stats_lines(df.limit(0)).collect()] == ["elapsed_ms"]


def test_metrics_and_strip(spark):
    df = spark.createDataFrame([(16, "c", 5, "3H2S4M1I2D4=2S", 5, "AACGTTTTTTCCC", {"NM": "5", "RG": "g"}), (4, "*", -1, "*", 0, "AC", {})], "flag int, rname string, pos long, cigar string, nm long, seq string, tags map<string,string>")
    m = df.select(A.metrics(F.col("cigar"), F.col("nm"), F.length("seq").cast("long"), F.lit(1000).cast("long")).alias("m")).select("m.*").collect()
    assert m[0]["aligned"] == 8 and m[0]["correct"] == 6 and m[0]["coverage"] == 8 / (13 + 7)
    assert m[1]["identity"] is None
    s = A.strip_alignment(df).collect()
    assert (s[0]["flag"], s[0]["rname"], s[0]["pos"], s[0]["cigar"], s[0]["seq"], s[0]["tags"]) == (4, "*", -1, "*", "GGGAAAAAACGTT", {"RG": "g"})
    assert s[1]["seq"] == "AC"


def test_draft_outside(spark):
    df = spark.createDataFrame([("ACG", [0, 1, 1, 3], [0, 0, 1, 0])], "s string, a array<int>, b array<int>")
    with pytest.raises(Exception, match="outside"):
        df.select(A.gapped_draft(F.col("s"), F.col("a"), F.col("b"))).collect()
