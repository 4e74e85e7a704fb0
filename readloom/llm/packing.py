"""Mixture-controlled packing of token sequences.

Documents are tokenised where they are read, written as token ids and dealt over
packing partitions by a hash. Inside a partition the documents of a source form
a queue, and deficit round-robin fills sequence after sequence: in each round a
source's deficit grows by its share of a sequence, and a source whose deficit
covers its next packet (a document's next tokens, ``packet`` at most) is served.
Deficits stay over the ends of sequences. A document is cut where a sequence is
full, so all sequences of a partition are full.

Deficits are carried from partition to partition: partition p starts with what the
mixture owes each source after all earlier partitions, its share of their tokens less
its own tokens there. Both are prefix sums over a table of a row for each
partition and source, so partitions need not wait for each other. The mixture is
``shares`` or, by default, the sources' shares of all tokens: the one mixture
that every window can hold while every document is packed. Shares and deficits come
to a partition as rows; there is no limit to the number of sources.

When sources of more than ``slack`` of the mixture have run dry, the partition
stops: what is left goes, with its deficits, to a second level of fewer
partitions, in which the deficits of several first-level partitions add up and
packing goes on until all queues are empty. The last tokens of such a partition
form sequences of powers of two, which need no padding.

A task holds the token ids of a packing partition (about ``part_tokens``; of those
that a hash gives it, as the second level holds what FAN partitions left).

Defined cases: null text is empty; every document ends with ``end_id``, so an
empty one has one token; a null source is a source of its own; repeated rows are
documents of their own, spread over the partitions.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import release, text_key, written
from readloom.llm.encoding import encoder

FAN = 16  # first-level partitions that share one of the second level
PART_TOKENS = 4 << 20


def _tokenise(path: str, by_chunk: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, by_chunk)
        for b in batches:
            lo = 0
            for ids in enc.encode(b.column(3), end_id):
                part = b.slice(lo, len(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids], names=["id", "k", "source", "ids"])
                lo += len(ids)

    return run


class _Queue:
    """Documents (or the rest of them) of one source."""

    __slots__ = ("items", "at")

    def __init__(self):
        self.items, self.at = deque(), 0

    def head(self, packet: int) -> int:
        return min(packet, len(self.items[0][2]) - self.at) if self.items else 0


def deficit_round_robin(queues: list[_Queue], share: np.ndarray, deficit: np.ndarray, size: int, packet: int, slack: float, drain: bool):
    """Yields lists of pieces (document, from, to), a list a sequence; changes queues and deficits."""
    heads = np.array([q.head(packet) for q in queues], np.int64)
    left = sum(len(x[2]) for q in queues for x in q.items) - sum(q.at for q in queues)
    turn, pieces, room = 0, [], size
    n = len(queues)
    while left:
        if room == size and not drain and (left < size or share[heads == 0].sum() > slack):
            return
        live = heads > 0
        ready = np.flatnonzero(live & (deficit >= heads))
        if not len(ready):
            # As many rounds as the nearest source needs.
            rounds = np.min(np.ceil((heads[live] - deficit[live]) / np.maximum(share[live] * size, 1e-9)))
            deficit += max(1.0, rounds) * share * size
            continue
        for s in np.roll(ready, -int(np.searchsorted(ready, turn))).tolist():
            q = queues[s]
            take = min(int(heads[s]), room)
            doc = q.items[0]
            if pieces and pieces[-1][0] is doc and pieces[-1][2] == q.at:
                pieces[-1][2] += take
            else:
                pieces.append([doc, q.at, q.at + take])
            q.at += take
            if q.at == len(doc[2]):
                q.items.popleft()
                q.at = 0
            deficit[s] -= take
            heads[s] = q.head(packet)
            left -= take
            room -= take
            turn = s if room == 0 and deficit[s] >= heads[s] else s + 1
            if not room:
                break
        turn %= n
        if not room:
            yield pieces
            pieces, room = [], size
    if pieces:
        yield pieces


def _powers(pieces: list, size: int) -> Iterator[list]:
    """The last pieces as sequences of powers of two."""
    total = sum(b - a for _, a, b in pieces)
    while total:
        want = room = min(size, 1 << (total.bit_length() - 1))
        out = []
        while room:
            doc, a, b = pieces[0]
            cut = min(b, a + room)
            out.append([doc, a, cut])
            room -= cut - a
            if cut == b:
                pieces.pop(0)
            else:
                pieces[0] = [doc, cut, b]
        total -= want
        yield out


_PIECE = ["id", "k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ALL = [*_PIECE, "kind", "part", "source", "ids", "deficit", "share"]


def _pack(id_type: pa.DataType, dtype: str, size: int, packet: int, slack: float, level: int):
    """Packs partitions. Rows in: id, k, source, ids, start, doc_tokens, kind, part, deficit, share."""
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.float64(), pa.float64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_ALL)

    def one(part: int, docs: list[tuple], owed: dict, shares: dict) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda x: (x[0] is None, x[0], x[1], x[3]))
        names = sorted({x[5] for x in docs} | set(owed), key=lambda s: (s is None, s))
        number = {s: j for j, s in enumerate(names)}
        queues = [_Queue() for _ in names]
        for x in docs:
            queues[number[x[5]]].items.append(x)
        share = np.array([max(shares.get(s, 0.0), 1e-6) for s in names])
        share /= share.sum()
        begin = np.array([owed.get(s, 0.0) for s in names])
        deficit = begin.copy()
        base = (level << 62 >> 1 if level else 0) + (part << 32)
        rows, made = [], 0
        for full in deficit_round_robin(queues, share, deficit, size, packet, slack, bool(level)):
            for pieces in _powers(full, size) if sum(b - a for _, a, b in full) < size else (full,):
                offset = 0
                for doc, a, b in pieces:
                    crc = zlib.crc32(doc[2][a:b].astype("<u4").tobytes())
                    rows.append((doc[0], doc[1], doc[3] + a, b - a, crc, doc[4], base + made, offset, "piece", part, None, None, None, None))
                    offset += b - a
                made += 1
            if len(rows) > 5000:
                yield batch(rows)
                rows = []
        for s, q in zip(names, queues, strict=True):
            for j, doc in enumerate(q.items):
                a = q.at if j == 0 else 0
                rows.append((doc[0], doc[1], doc[3] + a, None, None, doc[4], None, None, "rest", part, s, doc[2][a:].tobytes(), None, None))
                if len(rows) > 500:
                    yield batch(rows)
                    rows = []
            if not level:  # what this partition adds to the debt
                j = number[s]
                rows.append((None, None, None, None, None, None, None, None, "deficit", part, s, None, float(deficit[j] - begin[j]), float(shares.get(s, 0.0))))
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list, dict, dict]] = {}
        for b in batches:
            for i, k, source, ids, start, total, kind, part, d, share in zip(*[b.column(c).to_pylist() for c in range(10)], strict=True):
                docs, owed, shares = parts.setdefault(part, ([], {}, {}))
                if kind == "deficit":
                    owed[source], shares[source] = owed.get(source, 0.0) + d, share
                else:
                    docs.append((i, k, np.frombuffer(ids, dtype), start or 0, total or len(ids) // np.dtype(dtype).itemsize, source))
        for part in sorted(parts):
            docs, owed, shares = parts.pop(part)
            if docs:
                yield from one(part, docs, owed, shares)

    return run


def carried(per: DataFrame, shares: DataFrame) -> DataFrame:
    """(part, source, deficit, share): what the mixture owes a source before each
    partition that has it, from (part, source, t) and (source, share)."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # A row a partition.
    totals = per.groupBy("part").agg(F.sum("t").alias("t")).select(F.col("part").alias("tp"), F.coalesce(F.sum("t").over(before.orderBy("part")), F.lit(0)).alias("all"))
    own = per.withColumn("own", F.coalesce(F.sum("t").over(before.partitionBy("source").orderBy("part")), F.lit(0)))
    shares = shares.select(F.col("source").alias("ss"), "share")
    out = own.join(totals, own["part"] == totals["tp"]).join(shares, own["source"].eqNullSafe(shares["ss"]), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return out.select("part", "source", (F.col("share") * F.col("all") - F.col("own")).alias("deficit"), "share")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shares: dict | None = None,
    by_chunk: bool = True,
    packet: int = 512,
    slack: float = 0.1,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """(id, k, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece.

    ``shares`` is the mixture that sequences aim at (source to weight; default: the
    sources' shares of all tokens). ``by_chunk`` must be false for tokenizers that see
    white space as part of tokens.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    dtype = encoder(tokenizer, by_chunk).dtype
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    tokens = written(rows.mapInArrow(_tokenise(tokenizer, by_chunk, end_id), f"id {id_type}, k long, source string, ids binary"), "tokens")
    size_of = F.expr(f"octet_length(ids) div {dtype.itemsize}")
    total = tokens.agg(F.sum(size_of)).first()[0] or 0
    parts = max(1, math.ceil(total / part_tokens))
    dealt = tokens.withColumn("part", F.pmod(F.xxhash64("id", "k", F.monotonically_increasing_id()), F.lit(parts)))
    per = dealt.groupBy("part", "source").agg(F.sum(size_of).alias("t"))
    if shares is None:
        mixture = per.groupBy("source").agg((F.sum("t") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        whole = sum(shares.values()) or 1.0
        mixture = spark.createDataFrame([(s, v / whole) for s, v in shares.items()], "source string, share double")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["id", "k", "source", "ids", "start", "doc_tokens", "kind", "part", "deficit", "share"]
    first = dealt.select("id", "k", "source", "ids", none("long").alias("start"), none("long").alias("doc_tokens"), F.lit("doc").alias("kind"), "part", none("double").alias("deficit"), none("double").alias("share"))
    owed = carried(per, mixture).select(none(id_type).alias("id"), none("long").alias("k"), "source", none("binary").alias("ids"), none("long").alias("start"), none("long").alias("doc_tokens"), F.lit("deficit").alias("kind"), "part", "deficit", "share")
    kind = f"id {id_type}, k long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, kind string, part long, source string, ids binary, deficit double, share double"
    one = written(first.unionByName(owed).repartition(parts, "part").mapInArrow(_pack(arrow, dtype.str, size, packet, slack, 0), kind), "packed")
    release(tokens)
    rest = one.filter("kind != 'piece'").withColumn("part", F.floor(F.col("part") / FAN)).select(*columns)
    two = rest.repartition(max(1, math.ceil(parts / FAN)), "part").mapInArrow(_pack(arrow, dtype.str, size, packet, slack, 1), kind)
    return one.filter("kind = 'piece'").select(*_PIECE).unionByName(two.select(*_PIECE))
