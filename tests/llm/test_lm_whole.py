"""Cross-entropy difference against exact counts in plain Python."""

import math
import random
from collections import Counter

import pytest

from readloom.llm import lm_score


def by_hand(docs, hit, prior):
    """Per document: tokens, target and background loss, by the formula of the module."""
    words = [[x.translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split()] for _, t in docs]
    side = [0 if i in hit else 1 for i, _ in docs]
    uni, both, ctx, tokens = Counter(), (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for w, k in zip(words, side, strict=True):
        pairs = list(zip([None, *w], w, strict=False))
        uni.update(w)
        both[k].update(pairs)
        ctx[k].update(c for c, _ in pairs)
        tokens[k] += len(w)
    least = min([x for x in tokens if x], default=0)
    scale = [least / x if x else 0 for x in tokens]
    mass = sum(tokens) + len(uni) + 1
    out = []
    for w, k in zip(words, side, strict=True):
        pairs = list(zip([None, *w], w, strict=False))
        mine, used = Counter(pairs), Counter(c for c, _ in pairs)
        loss = [0.0, 0.0]
        for m in (0, 1):
            for c, x in pairs:
                n, a = both[m][c, x] - (mine[c, x] if m == k else 0), ctx[m][c] - (used[c] if m == k else 0)
                loss[m] -= math.log((scale[m] * n + prior * (uni[x] + 1) / mass) / (scale[m] * a + prior))
        out.append((len(w), *[x / len(w) if w else None for x in loss]))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    zipf = [f"z{i}" for i in range(60) for _ in range(60 // (i + 1))]
    docs = [(i, " ".join([rng.choice(words) if rng.random() < 0.5 else rng.choice(zipf) for _ in range(rng.randint(1, 300))] + ["The End"] * rng.randint(0, 20))) for i in range(300)]
    return docs + [(1000, None), (1001, docs[3][1]), (1002, "one"), (1003, docs[100][1]), (1003, docs[100][1]), (None, "the end one"), (1004, " \t"), (1005, "end " * 5000)]


@pytest.mark.parametrize(("heavy", "parts"), [(0, 1), (20, 3), (512, 2)])
def test_losses_are_those_of_exact_counts(spark, heavy, parts):
    docs, hit = corpus(), {*range(40), 1003}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as k", "3 as hit", "4 as n").repartition(3)
    targets = spark.createDataFrame([(i,) for i in [*hit, 3, None, 77777]], "doc_id long")
    got = sorted(lm_score.cross_entropy_difference(df, targets, heavy=heavy, parts=parts).collect(), key=str)
    want = sorted([(i, *x) for (i, _), x in zip(docs, by_hand(docs, hit, lm_score.PRIOR), strict=True)], key=str)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], round(r[2] or 0, 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        if w[2] is None:
            assert g[2] is None and g[3] is None and g.score is None
        else:
            assert math.isclose(g[2], w[2], rel_tol=1e-9) and math.isclose(g[3], w[3], rel_tol=1e-9)
            assert math.isclose(g.score, w[2] - w[3], rel_tol=1e-6, abs_tol=1e-9)


def test_one_side_is_empty(spark):
    docs = corpus(5)[:50]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = {r.id: r for r in lm_score.cross_entropy_difference(df, none).collect()}
    for (i, _), (n, t, b) in zip(docs, by_hand(docs, set(), lm_score.PRIOR), strict=True):
        assert got[i].n_tokens == n and math.isclose(got[i].target_loss, t, rel_tol=1e-9) and math.isclose(got[i].background_loss, b, rel_tol=1e-9)
    assert lm_score.cross_entropy_difference(df.limit(0), none).count() == 0


def test_score_does_not_follow_the_size_of_the_background(spark):
    """Documents of one kind score about 0 however few of them are the target."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    other = [(1000 + i, " ".join(rng.choice(words[:60]) for _ in range(200))) for i in range(20)]
    both = df.union(spark.createDataFrame(other, df.schema))
    mean = lambda out, keep: sum(r.score for r in out if keep(r.id)) / sum(keep(r.id) for r in out)
    targets = spark.createDataFrame([(i,) for i in [*range(10), *range(1000, 1010)]], "doc_id long")
    out = lm_score.cross_entropy_difference(both, targets).collect()
    assert mean(out, lambda i: 1010 <= i) < mean(out, lambda i: 10 <= i < 1000)
    alike = lm_score.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in range(20)], "doc_id long")).collect()
    assert abs(mean(alike, lambda i: True)) < 0.15


def test_pairs_move_packed_by_bucket(spark, monkeypatch):
    """Pairs are shuffled as arrays, not one by one, and no group is sorted or windowed row by row."""
    plans, write = [], lm_score.written

    def noted(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(lm_score, "written", noted)
    docs, hit = corpus(7), {*range(60)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i in hit], "doc_id long")
    got = lm_score.cross_entropy_difference(df, targets, heavy=30, bucket=500).collect()
    key = lambda x: (str(x[0]), x[1], round(x[2] or 0, 6))
    want = sorted([(i, *x) for (i, _), x in zip(docs, by_hand(docs, hit, lm_score.PRIOR), strict=True)], key=key)
    for g, w in zip(sorted(got, key=key), want, strict=True):
        assert g[:2] == w[:2]
        assert w[2] is None or math.isclose(g[2], w[2], rel_tol=1e-9) and math.isclose(g[3], w[3], rel_tol=1e-9)
    losses = [p for name, p in plans if name == "losses"]
    assert len(losses) == lm_score.PARTS == 2
    assert not any("Window" in p or "Aggregate" in p for p in losses)
