"""Neighbours of tables whose vectors differ much in size or lie close together."""

import numpy as np

from readloom.llm import ann


def recall(spark, x, every):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, lambda c: c % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, n, x = 0, 0, x.astype(float)
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hit, n = hit + len(got.get(q, set()) & set(want.tolist())), n + 10
    return hit / n


def test_one_long_vector(spark):
    x = np.random.default_rng(1).standard_normal((2000, 16)).astype(np.float32)
    x[7] *= 1e4
    found = recall(spark, x, 100)
    print("recall beside a long vector", found)
    assert found >= 0.9


def test_clump_of_close_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    x[1000:] = (x[1000] + 1e-4 * rng.standard_normal((3000, 16))).astype(np.float32)
    found = recall(spark, x, 100)
    print("recall with a clump", found)
    assert found >= 0.9


def test_plans_of_hops_do_not_grow(spark, monkeypatch):
    """What a query has seen is one join in each hop, and hops are few: the driver holds their plans."""
    plans, write = [], ann.written

    def noted(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(ann, "written", noted)
    x = np.random.default_rng(3).standard_normal((3000, 16)).astype(np.float32)
    assert recall(spark, x, 100) >= 0.9
    assert not any("Broadcast" in p for _, p in plans)
    near = [p for name, p in plans if name == "near"]
    assert 3 <= len(near) <= 8
    assert max(p.count("LeftAnti") for p in near) == 1
    assert len(near[-1]) < 1.2 * len(near[1])


def test_stages_are_few(spark, monkeypatch):
    """Classes take no join, a round deals what it needs once, and a search starts at the query's list."""
    plans, starts, write = [], [], ann.written

    def noted(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = write(df, name)
        if name == "near" and not starts:
            starts.append(out.count())
        return out

    monkeypatch.setattr(ann, "written", noted)
    x = np.random.default_rng(4).standard_normal((1000, 16)).astype(np.float32)
    assert recall(spark, x, 100) >= 0.9
    assert "Join" not in next(p for name, p in plans if name == "classes")
    rounds = [p for name, p in plans if name == "graph" and "Join" in p]
    assert rounds and all(p.split("== Initial Plan ==")[-1].count("Exchange") == 5 for p in rounds)
    assert starts[0] == 10 * (ann.DEGREE + 1)
    assert sum(name == "near" for name, _ in plans) <= 6


def test_what_blocks_send_grows_with_the_rows(spark, monkeypatch):
    """five times the rows make some five times the rows, links and vectors in a round of local joins, not with the square."""
    sent = {k: spark.sparkContext.accumulator(0) for k in ("rows", "vectors", "rounds")}
    join, write = ann._local_join, ann.written

    def counted(*args):
        run = join(*args)

        def go(batches):
            def noted():
                for b in batches:
                    sent["vectors"].add(len(b) - b.column(2).null_count)
                    yield b

            for r in run(noted()):
                sent["rows"].add(len(r))
                yield r

        return go

    def rounds(df, name="step"):
        if name == "hoods":
            sent["rounds"].add(1)
        return write(df, name)

    monkeypatch.setattr(ann, "CHUNK", 128)
    monkeypatch.setattr(ann, "_local_join", counted)
    monkeypatch.setattr(ann, "written", rounds)

    def of(n):
        x = np.random.default_rng(5).standard_normal((n, 32)).astype(np.float32)
        classes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, v binary")
        before = {k: v.value for k, v in sent.items()}
        assert ann.build_graph(classes, np.float32).count() == n
        now = {k: v.value - before[k] for k, v in sent.items()}
        return now["rows"] / now["rounds"], now["vectors"] / now["rounds"]

    small, large = of(1000), of(5000)
    print("rows and vectors a round", small, large)
    assert all(b <= 8 * a for a, b in zip(small, large, strict=True))


def test_wide_blocks_are_cut_by_bytes(spark, monkeypatch):
    """Blocks of local joins and of queries that hold few vectors each find the same."""
    x = np.random.default_rng(6).standard_normal((1500, 24)).astype(np.float32)
    one = recall(spark, x, 50)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 100 * 64 * 96)
    assert recall(spark, x, 50) == one >= 0.9
