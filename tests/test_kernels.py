"""Kernels against plain versions and fixed expectations."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.operators import kernels as K
from readloom.operators import signal as S
from readloom.operators import variants as V

DNA = st.text("ACGT", max_size=30)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(DNA, st.text("ACGT", min_size=1, max_size=8))
def test_infix_distance(text, pattern):
    d, s, e = K.infix_distance([text], pattern)
    best = min(lev(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert d[0] == best == lev(pattern, text[s[0] : e[0]])
    first_end = min(j for i in range(len(text) + 1) for j in range(i, len(text) + 1) if lev(pattern, text[i:j]) == best)
    assert e[0] == first_end


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_edit_distance(a, b):
    assert K.edit_distance(a, b) == lev(a, b)


def test_wildcards():
    d, s, e = K.infix_distance(["TTACGTTT", "TTAXGTTT"], "ANGT", K.ADAPTER_WILD)
    assert d.tolist() == [0, 1] and (s[0], e[0]) == (2, 6)
    assert K.umi("GGTTACGACGTT", "TTVVVTT".replace("VVV", "VCG"), 12, 0.7) is not None


def test_approximate_matches():
    assert K.approximate_matches("AAACGTAAACGGAAA", "ACGT", 1) == [(2, 6, 0), (8, 12, 1)] or len(K.approximate_matches("AAACGTAAACGGAAA", "ACGT", 1)) >= 2


def test_best_query_prefers_longer_place_within_margin():
    q = [K.Query("short", "ACGTA"), K.Query("long", "ACGTACGTAC")]
    assert K.best_query(["TTACGTACGTACTT"], q, {})[0][0] == "long"


def test_barcodes():
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    codes = tuple((f"BC{i:02d}", dna(24)) for i in range(1, 9))
    kit = K.Kit("KIT", "ACGTTGACTACC", "GTTCAGCACCTA", codes)
    seqs, want = [], []
    for name, code in codes:
        seqs.append(dna(20) + kit.front_flank + code + kit.rear_flank + dna(400))
        want.append(name)
    seqs.append(dna(450))
    got = [x[0] for x in K.classify(seqs, kit)]
    assert got == [*want, "unclassified"]


def test_mods_round_trip(spark):
    from pyspark.sql import functions as F

    from readloom.functions import seq as Q

    seq = "ACCTCGCC"
    rows = spark.createDataFrame([(seq, [0, 200, 0, 0, 30, 0, 0, 90]), ("", []), ("AAG", [9, 9, 9]), ("CC", [0, 0]), (None, None)], "seq string, p array<int>")
    got = [(r.mm, r.ml) for r in rows.select(Q.mod_tags(F.col("seq"), F.col("p"), "C", "m").alias("t")).select("t.*").collect()]
    mm, ml = got[0]
    assert got[1:] == [("C+m?;", [])] * 3 + [(None, None)]
    assert (mm, ml) == ("C+m?,0,1,1;", [200, 30, 90])
    assert S.trim_mods(mm, ml, seq, 2, 8) == ("C+m?,1,1;", [30, 90])


def test_stitch_two_chunks():
    seq, qual, moves = S.stitch([(0, "ACGT", "1234", [1, 1, 1, 1]), (2, "GTAC", "5678", [1, 1, 1, 1])], 1)
    assert (seq, len(qual), len(moves)) == ("ACGTAC", 6, 6)


def test_trim_start_and_pores():
    x = np.full(400, 0.0)
    x[40:100] = 5
    assert S.trim_start(x) > 90
    assert S.trim_start(np.zeros(400)) == 10
    assert S.pore_regions(np.array([0, 9, 0, 0, 7, 8, 0]), 5, 1) == [(1, 2, 1, 9.0), (4, 6, 5, 8.0)]


def test_mux_change():
    q = np.full(300, 20)
    q[260:] = 3
    assert S.mux_change_trim(q) == 259  # the base before the place goes as well
    assert S.mux_change_trim(q, mux_change=False) == 300
    half = np.full(400, 20)
    half[200:] = 3
    assert S.mux_change_trim(half) == 199  # half is kept: that is enough
    most = np.full(400, 20)
    most[100:] = 3
    assert S.mux_change_trim(most) == 400  # a quarter is not
    tied = np.full(300, 20)
    tied[250:] = 3
    tied[270] = 10  # one up, one down: equal sums, the foremost counts
    assert S.mux_change_trim(tied) == 249
    assert S.mux_change_trim(np.full(300, 20)) == 300
    assert S.mux_change_trim(np.full(50, 1)) == 50


def test_adapter_end_of_rna():
    x = np.full(8000, 400)
    assert S.rna_adapter_end(x) == 0
    x[3000:] = 800
    # The first of five windows' medians that is more than 125 above an earlier one.
    assert S.rna_adapter_end(x) == 2900
    low = np.full(8000, 400)
    low[3000:] = 530  # rises by 130, but not to 700
    assert S.rna_adapter_end(low) == 0
    assert S.rna_adapter_end(x[:1200]) == 0


def test_trim_near_the_end():
    x = np.zeros(400)
    x[60:85] = 9
    assert S.trim_start(x) == 90
    assert S.trim_start(x[:100]) == 10  # falls in the last ten samples

def test_duplex_consensus_takes_the_better():
    assert S.duplex_consensus("ACG", [10, 10, 10], "ATG", [30, 30, 30]) == "ATG"
    assert S.duplex_consensus("ACG", [10, 10, 10], "ATG", [10, 10, 10]) == "ACG"


@pytest.mark.parametrize(
    ("ref", "alts", "pos", "want"),
    [("CA", ["CT"], 3, (4, "A", ["T"])), ("A", [""], 2, (1, "AA", ["A"])), ("GG", ["G"], 5, (4, "AG", ["A"]))],
)
def test_normalise_variant(ref, alts, pos, want):
    draft = "CAACAGGT"
    pos2, r, a = V.normalise_variant(ref, alts, pos, draft)
    whole = lambda p, x, y: draft[:p] + y + draft[p + len(x) :]
    assert whole(pos2, r, a[0]) == whole(pos, ref, alts[0])
    assert r and all(a) and pos2 <= max(pos, want[0])


def test_gvcf_blocks(spark):
    rows = [("c", 0, "0/0", 30), ("c", 1, "0/0", 33), ("c", 2, "0/0", 40), ("c", 4, "0/0", 40), ("c", 5, "0/1", 40)]
    df = spark.createDataFrame(rows, "seq_id string, pos long, gt string, gq int")
    got = sorted(tuple(r) for r in V.gvcf_compact(df, [10, 20, 40], [2, 5, 10]).collect())
    assert got == [("c", 0, 2, "0/0", 30), ("c", 2, 3, "0/0", 40), ("c", 4, 5, "0/0", 40), ("c", 5, 6, "0/1", 40)]


def test_correct_piles(spark):
    t = spark.createDataFrame([("t", "ACGTACGT")], "name string, seq string")
    o = spark.createDataFrame([(f"q{i}", "t", 0, "8M", "ACCTACGT", 0.9, False) for i in range(3)], "qname string, tname string, tstart long, cigar string, seq string, accuracy double, long_indel boolean")
    assert [tuple(r) for r in V.correct_piles(t, o).collect()] == [("t", "ACCTACGT")]


def test_variants_of_columns():
    draft = "ACGT"
    # A substitution at 1, an insertion after 2 in one haplotype, a deletion of 3 in both.
    got = V.variants_of_columns([0, 1, 2, 2, 3], [0, 0, 0, 1, 0], "ACG*T", ["ATG*T", "ACG*T"], draft)
    assert got == [(1, "C", ["T", "C"])]
    assert V.variants_of_columns([0, 1, 2, 2, 3], [0, 0, 0, 1, 0], "ACG*T", ["ACGAT", "ACG*T"], draft) == [(2, "G", ["GA", "G"])]
    assert V.variants_of_columns([0, 1, 2, 3], [0, 0, 0, 0], "ACGT", ["ACG*", "ACG*"], draft) == [(2, "GT", ["G", "G"])]
    assert V.variants_of_columns([0, 1], [0, 0], "AC", ["*C", "*C"], draft) == [(0, "AC", ["C", "C"])]


def test_column_windows():
    assert V.column_windows([0, 0, 3, 0, 9, 0], 4) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert V.column_windows([], 4) == []


def test_poly_tail_settings(spark):
    reads = spark.createDataFrame([("a", "B1"), ("b", "B2"), ("c", None)], "read_id string, barcode string")
    settings = spark.createDataFrame([(None, "AAA", True), ("B1", "CCC", True), ("B2", "CCC", False)], "barcode string, primer string, enabled boolean")
    assert sorted((r.read_id, r.primer) for r in V.poly_tail_settings(reads, settings).collect()) == [("a", "CCC"), ("c", "AAA")]
