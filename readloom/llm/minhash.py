"""Near-duplicate documents by b-bit MinHash.

A document's set holds hashes of its distinct shingles. Documents of equal sets
are one class and only its representative goes on. Bands of the class's minima
give buckets; what is kept of a minimum besides is its low bits, packed, from
which the collision-corrected similarity of a candidate pair is estimated by
counting bits; pairs that may reach the threshold are confirmed on their full
sets.

No bucket is expanded to pairs. Round one links every member of a bucket to one
hub; linked members form components, and round two (with other hubs) looks only
at buckets that still hold several components. At last the members outside a
bucket's main component are compared with all its members, block by block inside
tasks, so that no link between components is lost.

Bands are chosen so that a pair right at the threshold shares a bucket with
probability 1 - 1e-7 at least.

Defined cases: null, empty and blank texts have an empty set and are linked with
nothing; fewer words than a shingle make one shingle of the whole sequence;
repeated rows are one class; a null doc_id never names a component unless all
its members' are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import hashing as H
from readloom.llm.common import release, text_key, whole_groups, written
from readloom.llm.components import components

ROWS = 5  # minima of a band
MISS = 1e-7  # chance that a pair at the threshold shares no bucket
LOW_BITS = 2
_CELLS = 32  # two-bit cells of a long
BLOCK = 1024  # members of a bucket that one task compares with as many others


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_sets(w: H.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other, and where they begin."""
    h = H.word_hashes(w)
    count = np.diff(w.first)
    place = np.flatnonzero(H.inside(w.first, len(h), n))
    x, text = H.windows(h, n)[place], H.text_of(place, w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        fold = [H.windows(h[w.first[t] : w.first[t + 1]], int(count[t]))[0] for t in short.tolist()]
        x, text = np.append(x, H.mix(np.array(fold, H.U64))), np.append(text, short)
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    x, text = x[new], text[new]
    return x, np.searchsorted(text, np.arange(len(count) + 1))


def _signatures(n: int, n_bands: int):
    rng = np.random.Generator(np.random.PCG64(977))
    n_min = ROWS * n_bands
    a = rng.integers(0, 2**63, n_min, dtype=np.int64).astype(H.U64) * H.U64(2) + H.U64(1)
    c = rng.integers(0, 2**63, n_min, dtype=np.int64).astype(H.U64)
    longs = -(-n_min // _CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in H.steps(b.column(2), lower=True):
                texts = len(w.first) - 1
                x, begin = shingle_sets(w, n)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                minima = np.zeros((len(full), n_min), H.U64)
                node = np.zeros((len(full), 2), ">u8")
                if len(full):
                    at = begin[:-1][full]
                    for j in range(n_min):
                        minima[:, j] = np.minimum.reduceat((x ^ c[j]) * a[j], at)
                    node[:, 0] = H.mix(np.add.reduceat(H.mix(x + H._P), at) + size[full].astype(H.U64))
                    node[:, 1] = H.mix(np.add.reduceat(H.mix(x ^ H._Q), at))
                minima = H.mix(minima)
                band = np.zeros((len(full), n_bands), H.U64)
                for j in range(ROWS):
                    band = (band + minima[:, j::ROWS][:, :n_bands]) * H._Q
                band = H.mix(band + np.arange(n_bands, dtype=H.U64))
                cells = np.zeros((len(full), longs * _CELLS), H.U64)
                cells[:, :n_min] = minima & H.U64(2**LOW_BITS - 1)
                shift = np.arange(_CELLS, dtype=H.U64) * H.U64(LOW_BITS)
                packed = np.bitwise_or.reduce(cells.reshape(len(full), longs, _CELLS) << shift, axis=2) if len(full) else np.zeros((0, longs), H.U64)
                where = np.full(texts, -1)
                where[full] = np.arange(len(full))
                take = pa.array(where, mask=where < 0)
                raw = node.tobytes()
                nodes = pa.array([raw[16 * i : 16 * i + 16] for i in range(len(full))], pa.binary())
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(H.signed(m).ravel()))
                ids, keys = b.column(0).slice(w.lo, texts), b.column(1).slice(w.lo, texts)
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(size.astype(np.int64)), nodes.take(take), lists(band).take(take), lists(packed).take(take)], names=["id", "k", "n", "node", "bands", "bits"])

    return run


def estimate(left: str, right: str, n_min: int):
    """Similarity from the packed low bits: agreeing cells, corrected for chance."""
    longs = -(-n_min // _CELLS)
    differ = " + ".join(f"bit_count((({left}[{i}] ^ {right}[{i}]) | shiftrightunsigned({left}[{i}] ^ {right}[{i}], 1)) & 6148914691236517205L)" for i in range(longs))
    chance = 2.0**-LOW_BITS
    return (F.lit(1.0) - F.expr(differ) / F.lit(float(n_min)) - chance) / (1 - chance)


def _confirm(n: int, percent: int):
    """Pairs whose full sets reach the threshold; equal left texts follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes | None, np.ndarray | None] = (None, None)
        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = np.zeros(len(u), bool)
            right: dict[int, np.ndarray] = {}
            for w in H.steps(b.column(3), lower=True):
                x, begin = shingle_sets(w, n)
                for t in range(len(begin) - 1):
                    right[w.lo + t] = x[begin[t] : begin[t + 1]]
                done = sorted(right)
                for i in done:
                    if held[0] != u[i]:
                        (one,) = H.steps(b.column(2).slice(i, 1), lower=True)
                        held = (u[i], shingle_sets(one, n)[0])
                    s, t2 = held[1], right.pop(i)
                    both = len(np.intersect1d(s, t2, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(s) + len(t2) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])

    return run


def _blocks(n: int, percent: int):
    """Links between labels inside groups of rows (g, side, node, label, text): every
    side 0 row against every side 1 row, on full sets; a spanning forest of each group."""

    def links(side: np.ndarray, nodes: list[bytes], labels: list[bytes], texts: pa.Array) -> list[tuple[bytes, bytes]]:
        if len(set(labels)) < 2:
            return []
        parts = [shingle_sets(w, n) for w in H.steps(texts, lower=True)]
        x = np.concatenate([p[0] for p in parts])
        size = np.concatenate([np.diff(p[1]) for p in parts])
        owner = np.repeat(np.arange(len(size)), size)
        number = {lab: i for i, lab in enumerate(dict.fromkeys(labels))}
        lab = np.array([number[v] for v in labels])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.zeros(len(size), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        # Only shingles that both sides hold can meet.
        _, x = np.unique(x, return_inverse=True)
        is_left = side[owner] == 0
        both = (np.bincount(x[is_left], minlength=x.max() + 1) > 0) & (np.bincount(x[~is_left], minlength=x.max() + 1) > 0)
        column = np.cumsum(both) - 1
        common = np.zeros((len(left), len(right)), np.float32)
        total = int(both.sum())
        keep = both[x]
        o, c, sl = owner[keep], column[x[keep]], is_left[keep]
        for lo in range(0, total, 4096):  # exact: counts are far below 2**24
            m = (c >= lo) & (c < lo + 4096)
            width = min(4096, total - lo)
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            a[place[o[m & sl]], c[m & sl] - lo] = 1
            b[place[o[m & ~sl]], c[m & ~sl] - lo] = 1
            common += a @ b.T
        common = common.astype(np.int64)
        i, j = np.nonzero((100 * common >= percent * (size[left][:, None] + size[right][None] - common)) & (lab[left][:, None] != lab[right][None]))
        up = list(range(len(number)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        out = []
        for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
            r, s = root(int(lab[a])), root(int(lab[b]))
            if r != s:
                up[r] = s
                out.append((nodes[a], nodes[b]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            g, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                found += links(side[lo:hi], b.column(2).slice(lo, hi - lo).to_pylist(), b.column(3).slice(lo, hi - lo).to_pylist(), b.column(4).slice(lo, hi - lo))
            u, v = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that star rounds have not found. In each bucket of several components the
    members outside its main one meet all members, in blocks of BLOCK by BLOCK: a row
    is sent once for each block of the other side, and no row stands for a pair."""
    at = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = at.groupBy("band", "key", "label").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("m"))
    per = per.filter(F.col("all") > F.col("m.c")).select("band", "key", F.col("m.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).cast("int").alias("na"))
    mixed = at.join(per, ["band", "key"])
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    sides = F.concat(
        F.when(F.col("label") != F.col("main"), F.transform(upto("nb"), lambda j: F.struct(F.lit(0).alias("side"), own("na").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>")),
        F.transform(upto("na"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), own("nb").alias("j"))),
    )
    rows = mixed.select("band", "key", "node", "label", F.explode(sides).alias("s")).select(F.xxhash64("band", "key", "s.i", "s.j").alias("g"), "s.side", "node", "label")
    rows = rows.join(texts, "node").select("g", "side", "node", "label", "text")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_blocks(n, percent), "u binary, v binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, rounds: int = 2) -> DataFrame:
    """(id, k, n_shingles, component_id), a row for each document.

    Links pairs with 100 * intersection >= ``percent`` * union of their shingle
    sets and names each component by its smallest id; ``k`` tells rows of one id
    apart.
    """
    threshold = percent / 100
    n_bands = bands_for(threshold)
    n_min = n_bands * ROWS
    chance = threshold + (1 - threshold) * 2.0**-LOW_BITS
    cutoff = threshold - 5.5 * math.sqrt(chance * (1 - chance) / n_min) / (1 - 2.0**-LOW_BITS)
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_signatures(shingle, n_bands), f"id {id_type}, k long, n long, node binary, bands array<long>, bits array<long>"), "signatures")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "k")).alias("r"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes.select("node", "low", "r.id", "r.k", "bands", "bits"), "classes")
    bits = classes.select("node", "bits")
    spread = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1").select("band", "key")
    members = written(spread.join(shared, ["band", "key"]), "members")
    # Texts of all classes that share a bucket, once.
    wanted = members.select("node").distinct().join(classes.select("node", F.col("id").alias("wid"), F.col("k").alias("wk")), "node")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["wid"]) & (rows["k"] == wanted["wk"])).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    links, tested, labels = None, None, None
    for turn in range(rounds):
        if labels is None:
            hubs = members.groupBy("band", "key").agg(F.min("node").alias("hub"))
            pairs = members.join(hubs, ["band", "key"]).filter("node != hub")
        else:
            at = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = at.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.min(F.struct(F.xxhash64(F.lit(turn), "band", "node"), "node", "label")).alias("h")).filter("a != z")
            pairs = at.join(mixed.select("band", "key", F.col("h.node").alias("hub"), F.col("h.label").alias("other")), ["band", "key"]).filter("label != other")
        pairs = pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = pairs.join(bits.select(F.col("node").alias("u"), F.col("bits").alias("ub")), "u").join(bits.select(F.col("node").alias("v"), F.col("bits").alias("vb")), "v")
        pairs = written(pairs.filter(estimate("ub", "vb", n_min) >= cutoff).select("u", "v"), "pairs")
        full = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("vt")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("ut")), "u")
        found = written(full.select("u", "v", "ut", "vt").mapInArrow(_confirm(shingle, percent), "u binary, v binary"), "links")
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        labels = written(components(links), "labels")
    links = links.union(written(_rest(members, labels, texts, shingle, percent), "links"))
    labels = written(components(links), "labels")
    release(texts, members)
    named = classes.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    names = named.groupBy("label").agg(F.min("low").alias("name"))
    by_node = named.join(names, "label").select("node", "name")
    return signed.join(by_node, "node", "left").select("id", "k", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))
