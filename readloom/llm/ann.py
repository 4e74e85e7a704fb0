"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node, so that a vector of very many rows takes one place in
neighbour lists. The graph starts from chunks of random-projection orders and is
improved by NN-descent: each node's neighbours and reverse neighbours meet in a
local join that proposes every pair closer than the end of a list. Only pairs of
which one is new in its list meet, and rounds go on until fewer than ``SETTLED`` of all
links change.

A list is one packed row of its node. Local joins run by blocks of nodes that are
neighbours in the first projection: a block sends for each vector once,
and keeps the best proposals for each node before it sends them on. There are as many
blocks as cores until their vectors need more than ``BLOCK_BYTES``, and a vector goes to
``DEGREE + REVERSE`` blocks at most. Lists and proposals are sent as one packed row for
each bucket of nodes. Distances are
those of the original vectors in double precision, from products of vectors that
are first moved to their group's middle; results are measured by differences.

Search keeps the ``ef`` best nodes of each query, and hop by hop opens the best
``width`` not yet opened, until none is left. A query starts at its own list. Queries go
in blocks, to each of which a vector is sent once a hop. The driver
keeps a plan for each hop: hops are few and wide, and what a query has seen is one scan and
one join however many hops there were.

Lists and beams are bounded by parameters, so no group that a task holds grows
with the data; reverse lists are cut to their nearest where they are made, a batch
at a time. Every row is in the graph.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite
components take no part, nor do null ids; vectors of other lengths are no neighbours and
have a graph of their own; rows of one id and one vector are one row, rows of one id
and different vectors are neighbours like others; with fewer candidates than k all
that the search reaches are returned; equal distances go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import release, together, whole_groups, written

DEGREE, REVERSE = 32, 32
TREES, TREE_LINKS, CHUNK, TREE_BITS = 6, 24, 2048, 6
SETTLED = 0.02  # NN-descent ends below this share of changed links
EF, WIDTH = 160, 160
BLOCK_BYTES = 1 << 27  # vectors that a block of local joins holds at most
BUCKET = 1024  # nodes whose lists are merged at once
_CELLS = 1 << 20  # numbers that a step by differences holds

_LIST = "u long, b long, ids binary, ds binary, state binary"
_NAMES = ["u", "b", "ids", "ds", "state"]
_DEALT = "k long, u binary, b binary, n binary, ids binary, ds binary, state binary"
OLD, NEW, PROPOSED = 0, 1, 2  # state of a link


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(col: pa.Array, dtype) -> np.ndarray:
    """Packed vectors of one length."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1).astype(np.float64)


def _pack(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(v, dtype).tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary())], names=["id", "h1", "h2", "v"])

    return run


def _bounds(*keys: np.ndarray) -> list[tuple[int, int]]:
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to each other."""
    x = x - np.median(x, axis=0)
    s = np.einsum("ij,ij->i", x, x)
    d = np.maximum(s[:, None] + s[None] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _project(trees: int, bits: int, seed: int, dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(1).to_pylist()])
            for n in np.unique(size).tolist():
                part = b.filter(pa.array(size == n))
                x = _matrix(part.column(1), dtype)
                x = x / np.abs(x).max(1, keepdims=True)  # directions: nothing overflows
                for t in range(trees):
                    rng = np.random.Generator(np.random.PCG64([seed, t]))
                    p = x @ rng.standard_normal((x.shape[1], bits + 1))
                    code = ((p[:, :bits] > 0) << np.arange(bits)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), n)), pa.array(code.astype(np.int32)), pa.array(p[:, bits]), part.column(0), part.column(1)], names=["t", "n", "code", "p", "node", "v"])

    return run


def _slices(x: np.ndarray, begin: np.ndarray, kind) -> pa.Array:
    """Packed numbers; row i is begin[i]:begin[i + 1]."""
    raw = np.ascontiguousarray(x, kind)
    offsets = pa.py_buffer((begin * raw.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(raw.tobytes())])


def _packed(u: np.ndarray, b: np.ndarray, begin: np.ndarray, ids: np.ndarray, ds: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """Rows of lists; list i is begin[i]:begin[i + 1]."""
    cols = [_slices(x, begin, kind) for x, kind in ((ids, np.int64), (ds, np.float64), (state, np.uint8))]
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(b.astype(np.int64)), *cols], names=_NAMES)


def _dealt(buckets: int, u: np.ndarray, b: np.ndarray, n: np.ndarray, ids: np.ndarray, ds: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """Lists of n links each, one after the other, as one row for each bucket of nodes."""
    mixed = (u.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    k = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, at, n = k[order], (np.cumsum(n) - n)[order], n[order]
    begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    take = np.repeat(at - begin[:-1], n) + np.arange(begin[-1])
    heads = np.array([lo for lo, _ in _bounds(k)] + [len(k)])
    cols = [_slices(x, heads, np.int64) for x in (u[order], b[order], n)] + [_slices(x[take], begin[heads], kind) for x, kind in ((ids, np.int64), (ds, np.float64), (state, np.uint8))]
    return pa.RecordBatch.from_arrays([pa.array(k[heads[:-1]]), *cols], names=["k", "u", "b", "n", "ids", "ds", "state"])


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each bucket: its nodes, their blocks, and owner (position of the node), ids, distances and states of all links."""
    for b in whole_groups(batches):
        for lo, hi in _bounds(b.column(0).to_numpy()):
            part = b.slice(lo, hi - lo)
            u, block, n, ids, ds, state = [np.frombuffer(b"".join(part.column(c).to_pylist()), k) for c, k in zip(range(1, 7), (np.int64, np.int64, np.int64, np.int64, np.float64, np.uint8), strict=True)]
            nodes, at = np.unique(u, return_inverse=True)
            blocks = np.full(len(nodes), -1)
            np.maximum.at(blocks, at, block)
            yield nodes, blocks, np.repeat(at, n), ids, ds, state


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Owner (row), ids, distances and states of the links of a batch."""
    raw = [np.frombuffer(b"".join(b.column(c).to_pylist()), k) for c, k in (("ids", np.int64), ("ds", np.float64), ("state", np.uint8))]
    n = np.array([len(x) for x in b.column("state").to_pylist()], np.int64)
    return np.repeat(np.arange(len(b)), n), *raw


def _cut(owner: np.ndarray, ids: np.ndarray, ds: np.ndarray, state: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest distinct ids of each owner, nearest first; of equal links the oldest."""
    order = np.lexsort((state, ids, owner))
    owner, ids, ds, state = owner[order], ids[order], ds[order], state[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, ds, state = owner[keep], ids[keep], ds[keep], state[keep]
    order = np.lexsort((ids, ds, owner))
    owner, ids, ds, state = owner[order], ids[order], ds[order], state[order]
    first = np.searchsorted(owner, owner, "left")
    keep = np.arange(len(owner)) - first < k
    return owner[keep], ids[keep], ds[keep], state[keep]


def _chunks(chunk: int, links: int, dtype, size: int, buckets: int):
    """Nearest of each node within a chunk of one projection's order; of the first projection,
    ``size`` nodes that follow each other are a block."""

    def near(nodes: np.ndarray, x: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        n = len(nodes)
        k, wide = min(links, n - 1), min(2 * links, n - 1)
        p, ds = np.zeros((n, 0), np.int64), np.zeros((n, 0))
        if k > 0:
            wide = np.argpartition(_squares(x), wide - 1, axis=1)[:, :wide]
            step = max(1, _CELLS // (wide.shape[1] * x.shape[1]))
            exact = np.concatenate([((x[wide[lo : lo + step]] - x[lo : lo + step, None]) ** 2).sum(2) for lo in range(0, n, step)])
            best = np.argsort(exact, axis=1, kind="stable")[:, :k]
            p, ds = np.take_along_axis(wide, best, 1), np.take_along_axis(exact, best, 1)
        return _dealt(buckets, nodes, block, np.full(n, p.shape[1]), nodes[p].ravel(), ds.ravel(), np.full(p.size, PROPOSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, placed, at, nodes, x = TaskContext.get().partitionId() << 24, 0, None, [], []

        def full() -> pa.RecordBatch:
            nonlocal placed, nodes, x
            ids = np.concatenate(nodes)
            block = first + (placed + np.arange(len(ids))) // size if at[0] == 0 else np.full(len(ids), -1)
            out = near(ids, np.concatenate(x), block)
            placed, nodes, x = placed + len(ids), [], []
            return out

        for b in batches:
            t, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in _bounds(t, n) if len(b) else []:
                if nodes and (t[lo], n[lo]) != at:
                    yield full()
                if (t[lo], n[lo]) != at:
                    first, placed = first + -(-placed // size), 0
                at = (t[lo], n[lo])
                ids, m = b.column(4).slice(lo, hi - lo).to_numpy(), _matrix(b.column(5).slice(lo, hi - lo), dtype)
                while len(ids):
                    room = chunk - sum(map(len, nodes))
                    nodes.append(ids[:room])
                    x.append(m[:room])
                    ids, m = ids[room:], m[room:]
                    if sum(map(len, nodes)) == chunk:
                        yield full()
        if nodes:
            yield full()

    return run


def _merge(degree: int):
    """Lists and proposals of a node as one list; kept links are old, proposed ones new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, block, *links in _buckets_of(batches):
            owner, ids, ds, state = _cut(*links, degree)
            yield _packed(nodes, block, np.searchsorted(owner, np.arange(len(nodes) + 1)), ids, ds, np.where(state == PROPOSED, NEW, OLD))

    return run


def _deal(buckets: int, limit: int = 0):
    """Lists by bucket, with a limit also the links the other way (states from 4), the ``limit``
    nearest of each node in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            u, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            row, ids, ds, state = _unpacked(b)
            lists = [(u, block, np.bincount(row, minlength=len(u)), ids, ds, state)]
            if limit and len(row):
                v, at = np.unique(ids, return_inverse=True)
                owner, back, ds, state = _cut(at, u[row], ds, state, limit)
                lists.append((v, np.full(len(v), -1), np.bincount(owner, minlength=len(v)), back, ds, state + 4))
            yield _dealt(buckets, *[np.concatenate(x) for x in zip(*lists, strict=True)])

    return run


def _around(degree: int, limit: int):
    """Neighbours and the nearest ``limit`` reverse neighbours: u, b, far (where a full
    list ends), members, fresh (which links are new)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, block, owner, ids, ds, state in _buckets_of(batches):
            own = state < 4
            n = np.bincount(owner[own], minlength=len(nodes))
            far = np.zeros(len(nodes))
            np.maximum.at(far, owner[own], ds[own])
            back = _cut(owner[~own], ids[~own], ds[~own], state[~own] - 4, limit)
            parts = [np.concatenate(x) for x in zip((owner[own], ids[own], ds[own], state[own]), back, strict=True)]
            owner, ids, _, state = _cut(*parts, degree + limit)
            offsets = pa.array(np.searchsorted(owner, np.arange(len(nodes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, state == NEW)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(block), pa.array(np.where(n < degree, np.inf, far)), *lists], names=["u", "b", "far", "members", "fresh"])

    return run


def _local_join(degree: int, dtype, buckets: int):
    """Columns b, u, x, far (a vector of the block), members, fresh (a list): the best
    proposals for each node of a block, by bucket."""

    def proposals(us: list, vs: list, ds: list) -> pa.RecordBatch:
        u, at = np.unique(np.concatenate(us), return_inverse=True)
        v = np.concatenate(vs)
        owner, ids, d, state = _cut(at, v, np.concatenate(ds), np.full(len(v), PROPOSED), degree)
        return _dealt(buckets, u, np.full(len(u), -1), np.bincount(owner, minlength=len(u)), ids, d, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vectors, table, held, pairs = None, [], None, ([], [], []), 0
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi in _bounds(keys) if len(b) else []:
                if keys[lo] != block:
                    if pairs:
                        yield proposals(*held)
                    block, vectors, table, held, pairs = keys[lo], [], None, ([], [], []), 0
                part = b.slice(lo, hi - lo)
                given = len(part) - part.column(2).null_count  # a block's vectors come before its lists
                if given:
                    vectors.append((part.column(1).slice(0, given).to_numpy(), part.column(3).slice(0, given).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(part.column(2).slice(0, given).to_pylist()), dtype).reshape(given, -1)))
                part = part.slice(given)
                if not len(part):
                    continue
                if table is None:
                    nodes, far, x = [np.concatenate(c) for c in zip(*vectors, strict=True)]
                    order = np.argsort(nodes)
                    table, vectors = (nodes[order], far[order], x[order]), []
                names, new = part.column(4).flatten().to_numpy(), part.column(5).flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(table[0], names)
                ends = np.cumsum(part.column(4).value_lengths().to_numpy()).tolist()
                for begin, end in zip([0, *ends], ends, strict=False):
                    own, who, fresh = at[begin:end], names[begin:end], new[begin:end]
                    d = _squares(table[2][own].astype(np.float64))
                    i, j = np.nonzero((d < table[1][own][:, None]) & (fresh[:, None] | fresh[None]))
                    for out, y in zip(held, (who[i], who[j], d[i, j]), strict=True):
                        out.append(y)
                    pairs += len(i)
                    if pairs > 500_000:
                        yield proposals(*held)
                        held, pairs = ([], [], []), 0
        if pairs:
            yield proposals(*held)

    return run


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Never by broadcast: tables of node numbers compress so well that a file below Spark's
    threshold may be hundreds of MB in the driver."""
    return left.join(right.hint("merge"), on, how)


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k")


def _sizes(classes: DataFrame) -> tuple[int, int]:
    """Number of vectors, and bytes of the longest."""
    return tuple(classes.agg(F.count("node"), F.coalesce(F.max(F.octet_length("v")), F.lit(1))).first())


def _buckets(classes: DataFrame, n: int) -> int:
    """So many buckets that each has about ``BUCKET`` nodes, and each task some of them."""
    return max(-(-n // BUCKET), 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _neighbourhoods(lists: DataFrame, degree: int, reverse: int, buckets: int) -> DataFrame:
    dealt = _by_bucket(lists.mapInArrow(_deal(buckets, reverse), _DEALT))
    return dealt.mapInArrow(_around(degree, reverse), "u long, b long, far double, members array<long>, fresh array<boolean>")


def build_graph(classes: DataFrame, dtype, degree: int = DEGREE, reverse: int = REVERSE, settled: float = SETTLED, seed: int = 1) -> DataFrame:
    """(u, b, ids, ds, state): for each node its approximate nearest ones, packed, with squared distances."""
    n, width = _sizes(classes)
    cores = classes.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(max(CHUNK, -(-n // cores)), BLOCK_BYTES // ((degree + reverse) * width)))
    buckets = _buckets(classes, n)
    spread = classes.mapInArrow(_project(TREES, TREE_BITS, seed, dtype), "t int, n long, code int, p double, node long, v binary")
    order = ["t", "n", "code", "p", "node"]
    spread = spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks(CHUNK, TREE_LINKS, dtype, size, buckets), _DEALT)
    lists = written(_by_bucket(spread).mapInArrow(_merge(degree), _LIST), "graph")
    while True:
        hoods = written(_neighbourhoods(lists, degree, reverse, buckets), "hoods")
        active = hoods.filter(F.exists("fresh", lambda x: x))
        # Dealt by node before they are made distinct, which spares an exchange.
        need = active.select("b", F.explode("members").alias("node")).repartition("node").distinct()
        ends = _joined(classes, hoods.select(F.col("u").alias("node"), "far"), "node")
        vectors = _joined(need, ends, "node").select("b", F.col("node").alias("u"), F.col("v").alias("x"), "far", F.lit(None).cast("array<long>").alias("members"), F.lit(None).cast("array<boolean>").alias("fresh"))
        joins = active.select("b", "u", F.lit(None).cast("binary").alias("x"), F.lit(None).cast("double").alias("far"), "members", "fresh")
        meet = vectors.union(joins).withColumn("last", F.col("x").isNull()).repartition("b").sortWithinPartitions("b", "last").drop("last")
        found = meet.mapInArrow(_local_join(degree, dtype, buckets), _DEALT)
        after = written(_by_bucket(lists.mapInArrow(_deal(buckets), _DEALT).union(found)).mapInArrow(_merge(degree), _LIST), "graph")
        release(lists, hoods)
        lists = after
        links = F.octet_length("state")
        total, changed = lists.agg(F.sum(links), F.sum(links - F.octet_length(F.replace(F.hex("state"), F.lit("01"), F.lit(""))) / 2)).first()
        if not total or changed <= settled * total:
            return lists


_BEAM = ["query", "x", "ids", "ds", "opened", "turn"]
_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]


def _starts(width: int):
    """Columns query, x, near, far (the query's list, packed): the first beam, its own node before its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for query, x, near, far in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids, ds = [query, *np.frombuffer(near, np.int64).tolist()], [0.0, *np.frombuffer(far, np.float64).tolist()]
                turn = ids[:width]
                out.append((query, x, ids, ds, [i < len(turn) for i in range(len(ids))], turn))
            cols = list(zip(*out, strict=True)) or [()] * len(_BEAM)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_BEAM)

    return run


_CANDIDATES = "block long, of binary, nodes binary"
_HOP = ["node", "v", "of", "nodes", "query", "x", "ids", "ds", "opened"]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns block, query, node: the pairs of a batch, packed by block."""
    for b in batches:
        k = b.column(0).to_numpy()
        if len(k):
            order = np.argsort(k, kind="stable")
            heads = np.array([lo for lo, _ in _bounds(k[order])] + [len(k)])
            yield pa.RecordBatch.from_arrays([pa.array(k[order][heads[:-1]]), *[_slices(b.column(c).to_numpy()[order], heads, np.int64) for c in (1, 2)]], names=["block", "of", "nodes"])


def _beams(ef: int, width: int, dtype):
    """Columns block and _HOP, by block: rows of vectors (node, v), of packed candidates (of, nodes) and of beams (the rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            out: list[tuple] = []
            for begin, end in _bounds(b.column(0).to_numpy()):
                part = b.slice(begin, end - begin)
                vectors, packed, beams = [part.filter(part.column(c).is_valid()) for c in ("v", "of", "x")]
                nodes, raw = vectors.column("node").to_numpy(), vectors.column("v").to_pylist()
                place = np.argsort(nodes)
                nodes = nodes[place]
                of, cands = [np.frombuffer(b"".join(packed.column(c).to_pylist()), np.int64) for c in ("of", "nodes")]
                order = np.argsort(of, kind="stable")
                of, cands = of[order], cands[order]
                for query, x, *beam in zip(*[beams.column(c).to_pylist() for c in _HOP[4:]], strict=True):
                    ids, ds, opened = [np.array(v, k) for v, k in zip(beam, (np.int64, np.float64, bool), strict=True)]
                    more = cands[np.searchsorted(of, query, "left") : np.searchsorted(of, query, "right")]
                    if len(more):
                        own = np.frombuffer(x, dtype).astype(np.float64)
                        y = np.frombuffer(b"".join([raw[i] for i in place[np.searchsorted(nodes, more)].tolist()]), dtype).reshape(len(more), -1)
                        ids, ds, opened = np.concatenate([ids, more]), np.concatenate([ds, ((y.astype(np.float64) - own) ** 2).sum(1)]), np.concatenate([opened, np.zeros(len(more), bool)])
                    best = np.lexsort((ids, ds))[:ef]
                    ids, ds, opened = ids[best], ds[best], opened[best]
                    turn = np.flatnonzero(~opened)[:width]
                    opened[turn] = True
                    out.append((query, x, ids.tolist(), ds.tolist(), opened.tolist(), ids[turn].tolist()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_BEAM)

    return run


def search(classes: DataFrame, lists: DataFrame, queries: DataFrame, dtype, k: int, ef: int = EF, width: int = WIDTH, degree: int = DEGREE, reverse: int = REVERSE) -> DataFrame:
    """(query, node, score): for each query node its k nearest nodes found, itself included."""
    ef = max(ef, k)
    n, size = _sizes(classes)
    graph = written(_neighbourhoods(lists, degree, reverse, _buckets(classes, n)).select("u", "members"), "graph")
    starts = _joined(_joined(queries.select(F.col("node").alias("query")), classes.withColumnRenamed("node", "query"), "query"), lists.withColumnRenamed("u", "query"), "query")
    kinds = "query long, x binary, ids array<long>, ds array<double>, opened array<boolean>, turn array<long>"
    beam = written(starts.select("query", F.col("v").alias("x"), F.col("ids").alias("near"), F.col("ds").alias("far")).mapInArrow(_starts(width), kinds), "beam")
    seen = [written(beam.select("query", F.explode("ids").alias("node")), "near")]
    # A block's queries share the vectors of their candidates, as local joins do.
    n_queries, cores = beam.count(), classes.sparkSession.sparkContext.defaultParallelism
    blocks = max(min(2 * cores, n_queries), -(-n_queries * width * (degree + reverse) * size // BLOCK_BYTES), 1)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    while True:
        turn = beam.select("query", F.explode("turn").alias("u"))
        near = _joined(turn, graph, "u").select("query", F.explode("members").alias("node")).distinct()
        near = written(_joined(near, together(*seen), ["query", "node"], "left_anti"), "near")
        seen.append(near)
        need = near.select(block, "node").repartition("node").distinct()
        vectors = _joined(need, classes, "node").select("block", "node", "v")
        cands = near.select(block, "query", "node").mapInArrow(_candidates, _CANDIDATES)
        rows = vectors.unionByName(cands, allowMissingColumns=True).unionByName(beam.drop("turn").withColumn("block", block), allowMissingColumns=True)
        rows = rows.select("block", *_HOP).repartition("block").sortWithinPartitions("block")
        after = written(rows.mapInArrow(_beams(ef, width, dtype), kinds), "beam")
        release(beam)
        beam = after
        if beam.filter(F.size("turn") > 0).isEmpty():
            break
    release(graph, *seen)
    pairs = beam.select("query", F.explode(F.slice(F.arrays_zip("ids", "ds"), 1, k)).alias("c"))
    return pairs.select("query", F.col("c.ids").alias("node"), F.sqrt("c.ds").alias("score"))


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **search_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for
    which ``is_query`` (a function of the id column) holds, by Euclidean distance."""
    rows = usable(vectors, id_col, vec_col)
    dtype = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    key = ["h1", "h2"]
    keyed = rows.select("id", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), "v")
    one = keyed.groupBy(*key).agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    one = one.select("id", *key, "v").mapInArrow(_pack(dtype), "id long, h1 long, h2 long, v binary")
    classes = written(one.select(F.monotonically_increasing_id().alias("node"), *key, "v"), "classes")
    members = written(_joined(keyed.select("id", *key).distinct(), classes.select("node", *key), key).select("id", "node"), "members")
    classes = classes.select("node", "v")
    lists = build_graph(classes, dtype)
    asked = members.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    found = search(classes, lists, asked.select(F.col("query").alias("node")).distinct(), dtype, k + 1, **search_options)
    release(lists)
    # Of each class the k + 1 smallest ids are enough.
    few = members.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("node", "s").orderBy("id"))).filter(F.col("r") <= k + 1).drop("s", "r")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).select("node", F.col("id").alias("vec_id"))
    out = _joined(_joined(found, asked, "query"), few, "node").filter((F.col("vec_id") != F.col("query_id")) | (F.col("node") != F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id", "node"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
