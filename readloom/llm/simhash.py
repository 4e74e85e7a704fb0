"""SimHash fingerprints, their likeness, and the search for near ones.

The terms of a text are its words and its word shingles; each occurrence adds its
weight to the bits that its hash sets and takes it from the others, and a
fingerprint keeps the signs. Votes are counted eight lanes to a 64-bit addition.

``near_fingerprints`` finds all pairs of distinct fingerprints within a Hamming
radius: they are cut into radius + 1 blocks, of which a pair within the radius
shares one at least; for each block a permuted table has that block first, and
rows of one leading block are compared in a join that AQE can split. Pairs are
between distinct fingerprints; documents keep theirs as class id.

``fingerprint_edits`` puts each document beside its successor by descending id.
Documents are range-partitioned and sorted by id, so a task meets almost all
successors itself; a document at the end of a partition and the first of each
partition are written apart and joined, one row a partition.

Defined cases: null counts as the empty text, whose fingerprint is 0; fewer words
than a shingle make one shingle; equal texts have equal fingerprints; repeated
ids are ordered by text; the successor of an only document is itself; a null id
comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import hashing as H
from readloom.llm.common import text_key, written

LANES = 4  # of 64 bits
SHINGLE = 5
SHINGLE_WEIGHT, LONG_WORD_WEIGHT, LONG_WORD = 1, 1, 4  # words of fewer bytes don't vote
_CHUNK = 255 // SHINGLE_WEIGHT


def fingerprints(w: H.Words) -> np.ndarray:
    """One row of LANES unsigned longs for each text."""
    texts = len(w.first) - 1
    h = H.word_hashes(w)
    count = np.diff(w.first)
    place = np.flatnonzero(H.inside(w.first, len(h), SHINGLE))
    x, text = [H.windows(h, SHINGLE)[place]], [H.text_of(place, w.first)]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        x.append(np.array([H.windows(h[w.first[t] : w.first[t + 1]], int(count[t]))[0] for t in short.tolist()], H.U64))
        text.append(short)
    n_shingles = sum(map(len, x))
    long = np.flatnonzero(w.ends - w.starts >= LONG_WORD)
    x.append(h[long])
    text.append(H.text_of(long, w.first))
    x, text = np.concatenate(x), np.concatenate(text)
    weight = np.full(len(x), LONG_WORD_WEIGHT, H.U64)
    weight[:n_shingles] = SHINGLE_WEIGHT
    order = np.argsort(text, kind="stable")
    x, text, weight = x[order], text[order], weight[order]
    begin = np.searchsorted(text, np.arange(texts + 1))
    n = np.diff(begin)
    out = np.zeros((texts, LANES), H.U64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    chunks = -(-n[full] // _CHUNK)
    first = np.cumsum(chunks) - chunks
    at = np.repeat(begin[:-1][full], chunks) + (np.arange(chunks.sum()) - np.repeat(first, chunks)) * _CHUNK
    mass = np.add.reduceat(weight.astype(np.int64), begin[:-1][full])
    for lane in range(LANES):
        bits = np.unpackbits(H.mix(x + H.U64((lane + 1) * int(H._P) % 2**64)).view(np.uint8)).view(H.U64).reshape(-1, 8)
        votes = np.add.reduceat(bits * weight[:, None], at, axis=0).view(np.uint8).astype(np.int64)
        votes = np.add.reduceat(votes, first, axis=0)
        out[full, lane] = np.packbits(2 * votes > mass[:, None], axis=1).view(H.U64).ravel()
    return out


def of_texts(texts: pa.Array) -> np.ndarray:
    parts = [fingerprints(w) for w in H.steps(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, LANES), H.U64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (64.0 * LANES)


def as_hex(fp: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in np.ascontiguousarray(fp)]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _columns(texts: list[str], following: list[str], fp: np.ndarray, fp_next: np.ndarray) -> list:
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    efp = of_texts(pa.array(edited, pa.large_string()))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    return [pa.array([len(x) for x in texts], pa.int64()), pa.array(sha), pa.array(as_hex(fp)), pa.array(as_hex(efp)), pa.array(likeness(fp, efp)), pa.array(likeness(fp, fp_next))]


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_STEP = 256  # documents handled at once


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose successor is in the partition; its first and last row as text."""
    part = TaskContext.get().partitionId()
    held, first_seen = None, False
    for whole in batches:
        for lo in range(0, len(whole), _STEP):
            b = whole.slice(lo, _STEP)
            ids, texts = b.column(0), b.column(1).fill_null("")
            text, fp = texts.to_pylist(), of_texts(texts)
            if not first_seen:
                first_seen = True
                yield _edge(ids.slice(0, 1), "first", part, text[0])
            if held is not None:
                ids, text, fp = pa.concat_arrays([held[0], ids]), [held[1], *text], np.concatenate([held[2], fp])
            n = len(text) - 1
            held = (ids.slice(n, 1), text[n], fp[n : n + 1])
            if n:
                cols = _columns(text[:n], text[1:], fp[:n], fp[1:])
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *cols, pa.array(["done"] * n), pa.array(np.full(n, part, np.int32)), none], names=["id", *_NAMES, "kind", "part", "text"])
    if held is not None:
        yield _edge(held[0], "last", part, held[1])


def _edge(ids: pa.Array, kind: str, part: int, text: str) -> pa.RecordBatch:
    none = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
    return pa.RecordBatch.from_arrays([ids, *none, pa.array([kind]), pa.array([part], pa.int32()), pa.array([text], pa.string())], names=["id", *_NAMES, "kind", "part", "text"])


def _seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, following = b.column(1).to_pylist(), b.column(2).to_pylist()
        cols = _columns(text, following, of_texts(b.column(1)), of_texts(b.column(2)))
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *_NAMES])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    kind = f"id {dict(docs.dtypes)[id_col]}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), text_key(F.col("text"))]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(rows.mapInArrow(_walk, f"{kind}, {_OUT}, kind string, part int, text string"), "edits")
    firsts = out.filter("kind = 'first'").select("part", F.col("text").alias("following"))
    parts = firsts.select("part")
    # A row a partition.
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    lasts = out.filter("kind = 'last'").select("id", "text", "part").join(after, "part")
    seams = lasts.join(firsts.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    seams = seams.mapInArrow(_seam, f"{kind}, {_OUT}")
    return out.filter("kind = 'done'").select("id", *_NAMES).unionByName(seams)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_hex(of_texts(b.column(1))))], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fingerprint string")


def near_fingerprints(prints: DataFrame, radius: int = 12) -> DataFrame:
    """(a, b, distance): all pairs a < b of distinct fingerprints within the radius."""
    digits = 16 * LANES
    if not 0 <= radius < digits:
        raise ValueError(f"radius must be from 0 to {digits - 1}")
    one = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    edges = [round(i * digits / (radius + 1)) for i in range(radius + 2)]
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.substring("fingerprint", lo + 1, hi - lo).alias("block")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    rows = one.select("fingerprint", F.explode(tables).alias("t")).select("fingerprint", "t.*")
    left, right = rows.withColumnRenamed("fingerprint", "a"), rows.withColumnRenamed("fingerprint", "b")
    distance = sum((F.bit_count(F.conv(F.substring("a", 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", 8 * i + 1, 8), 16, 10).cast("long"))) for i in range(digits // 8)), F.lit(0))
    pairs = left.join(right, ["table", "block"]).filter("a < b").withColumn("distance", distance).filter(F.col("distance") <= radius)
    return pairs.select("a", "b", "distance").distinct()
