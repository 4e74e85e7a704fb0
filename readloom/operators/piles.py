"""Pile-up counts (AGG-08): bases are counted in arrays, by bins of reference columns.

A record is never exploded to rows. Each batch of records is summed to counts of its
(contig, bin) pairs, which are packed as one row each; these meet by bin and are summed
again, batch by batch, so that a task holds the counts of one open bin, however deep it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]
COUNTS = [(b if b != "-" else "del").lower() + s for b in [*BASES, "-"] for s in ("_fwd", "_rev")]
OTHER = len(COUNTS)  # other bases and records without flag count for the depth only
BIN = 10  # bits of a column's place in its bin
WORK = 1 << 17  # bases that are held at once


def _table(kinds: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(kinds.encode())] = True
    return out


_OPS, _QUERY, _REFERENCE, _SHOWN = _table("MIDNSHP=X"), _table("MIS=X"), _table("MDN=X"), _table("MID=X")
_CODE = np.full(256, OTHER // 2, np.int64)
for _i, _b in enumerate([*BASES, "-"]):
    _CODE[ord(_b)] = _i


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a text column, one byte each, and where each row's begin."""
    a = pa.concat_arrays([col.cast(pa.large_string()).fill_null("")]).cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if (raw > 127).any():
        return _bytes(pa.array([x.encode("ascii", "replace").decode() for x in col.fill_null("").to_pylist()], pa.large_string()))
    return raw, at - at[0]


def _operations(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, kind and length of each operation of CIGAR texts."""
    c, at = _bytes(col)
    digit, op = (c >= 48) & (c <= 57), _OPS[c]
    after_digit = np.zeros(len(c), bool)
    after_digit[1:] = digit[:-1]
    full = at[1:] > at[:-1]
    after_digit[at[:-1][full]] = False
    odd = ~(digit | op) | (op & ~after_digit)
    odd[at[1:][full] - 1] |= digit[at[1:][full] - 1]
    if odd.any():
        rows = col.fill_null("").to_pylist()
        for i in np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1).tolist():
            rows[i] = "".join(re.findall("[0-9]+[MIDNSHP=X]", rows[i]))
        return _operations(pa.array(rows, pa.string()))
    end = np.flatnonzero(op)
    digits = np.diff(end, prepend=-1) - 1
    n = np.zeros(len(end), np.int64)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        n[has] += (c[end[has] - 1 - k].astype(np.int64) - 48) * 10**k
    return np.searchsorted(at, end, "right") - 1, c[end], n


def _before(n: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Sum of the earlier n of the same record."""
    total = np.cumsum(n) - n
    return total - total[np.searchsorted(rec, rec, "left")]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _binaries(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(x)
    offsets = pa.py_buffer((cuts * raw.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(raw.tobytes())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rname, flag, pos, cigar, seq to rname, bin (null without position), wide, and packed:
    steps between columns, minor columns, kinds and, unless all are 1, counts."""
    for b in batches:
        if not len(b):
            continue
        rec, op, n = _operations(b.column("cigar"))
        seq, at = _bytes(b.column("seq"))
        no_seq = b.column("seq").is_null().to_numpy(zero_copy_only=False)
        flag, no_flag = b.column("flag").fill_null(0).to_numpy(), b.column("flag").is_null().to_numpy(zero_copy_only=False)
        pos, no_pos = b.column("pos").fill_null(0).to_numpy(), b.column("pos").is_null().to_numpy(zero_copy_only=False)
        names = b.column("rname").dictionary_encode()
        name = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)
        dictionary = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)])
        q, r = _before(n * _QUERY[op], rec), _before(n * _REFERENCE[op], rec)
        keep = _SHOWN[op] & (n > 0) & ((op == ord("D")) | ~no_seq[rec])
        rec, op, n, q, r = (x[keep] for x in (rec, op, n, q, r))
        ins = op == ord("I")
        first = pos[rec] + r - ins
        fixed = ins | no_pos[rec]  # all its bases in one column
        first[no_pos[rec]] = 0
        # Pieces that stay in one bin.
        pieces = np.where(fixed, 1, ((first + n - 1) >> BIN) - (first >> BIN) + 1)
        o = np.repeat(np.arange(len(n)), pieces)
        bins = (first >> BIN)[o] + np.arange(len(o)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = np.where(fixed[o], 0, np.maximum(bins << BIN, first[o]) - first[o])
        size = np.where(fixed[o], n[o], np.minimum((bins + 1) << BIN, (first + n)[o]) - first[o]) - lo
        total, begin = np.cumsum(size), 0
        while begin < len(o):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] - size[begin] + WORK, "right")))
            p = slice(begin, end)
            begin = end
            owner, k = rec[o[p]], o[p]
            order = np.lexsort((bins[p], name[owner], no_pos[owner]))
            heads = _runs(no_pos[owner][order], name[owner][order], bins[p][order])
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
            each = np.repeat(np.arange(len(k)), size[p])
            i = np.arange(len(each)) - np.repeat(np.cumsum(size[p]) - size[p] - lo[p], size[p])
            column = ((group << BIN) + (first[k] - (bins[p] << BIN)))[each] + np.where(fixed[k][each], 0, i)
            minor = np.where(ins[k][each], i + 1, 0)
            place = q[k][each] + i
            read = (op[k] != ord("D"))[each]
            there = read & (place < (at[owner + 1] - at[owner])[each])
            base = np.where(read, OTHER // 2, 4)
            base[there] = _CODE[seq[at[owner][each[there]] + place[there]]]
            kind = np.minimum(base * 2 + (flag[owner] & 16 != 0)[each], OTHER)
            kind[no_flag[owner][each]] = OTHER
            bits = int(minor.max()).bit_length()
            codes = np.sort((((column << bits) | minor) << 4) | kind)
            starts = _runs(codes)
            count, codes = np.diff(starts, append=len(codes)), codes[starts]
            column, minor, kind = codes >> (bits + 4), (codes >> 4) & ((1 << bits) - 1), codes & 15
            cuts = np.append(_runs(column >> BIN), len(codes))
            step = np.diff(column, prepend=0)
            step[cuts[:-1]] = column[cuts[:-1]] & ((1 << BIN) - 1)
            wide = 1 * (bits > 8) + 2 * (count.max() > 1) + 4 * (count.max() > 255)
            top = order[heads]
            yield pa.RecordBatch.from_arrays(
                [
                    dictionary.take(pa.array(name[owner[top]])), pa.array(bins[p][top], mask=no_pos[owner[top]]), pa.array(np.full(len(heads), wide, np.int32)),
                    _binaries(step.astype(np.uint16), cuts), _binaries(minor.astype(np.uint32 if wide & 1 else np.uint8), cuts), _binaries(kind.astype(np.uint8), cuts),
                    _binaries(count.astype(np.uint64 if wide & 4 else np.uint8), cuts if wide & 2 else cuts * 0),
                ],
                names=["rname", "bin", "wide", "steps", "minors", "kinds", "counts"],
            )


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, place in the bin, minor column, kind and count of all entries."""
    size = np.diff(_bytes_at(b.column("kinds")))
    row = np.repeat(np.arange(len(b)), size)
    steps, kinds = (np.frombuffer(b"".join(b.column(c).to_pylist()), k).astype(np.int64) for c, k in (("steps", np.uint16), ("kinds", np.uint8)))
    total = np.cumsum(steps)
    heads = np.cumsum(size) - size
    place = total - np.repeat(total[heads] - steps[heads], size)
    minor, count = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
    wide = b.column("wide").to_numpy()
    for w in np.unique(wide).tolist():
        part, into = b.filter(pa.array(wide == w)), (wide == w)[row]
        minor[into] = np.frombuffer(b"".join(part.column("minors").to_pylist()), np.uint32 if w & 1 else np.uint8)
        if w & 2:
            count[into] = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.uint64 if w & 4 else np.uint8).astype(np.int64)
    return row, place, minor, kinds, count


def _bytes_at(col: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum([len(x) for x in col.to_pylist()]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``WORK`` entries at most, one row at least."""
    for b in batches:
        total, begin = _bytes_at(b.column("kinds")), 0
        while begin < len(b):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + WORK, "right")) - 1)
            yield b.slice(begin, end - begin)
            begin = end


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by bin, to counts of columns."""
    held = None  # the open bin: its key and entries

    def shown(keys: list[tuple], entries: tuple[np.ndarray, ...], kind: pa.DataType) -> pa.RecordBatch:
        group, place, minor, kinds, count = entries
        starts = _runs(group, place, minor)
        column = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(group)))
        table = np.zeros((OTHER + 1, len(starts)), np.int64)
        table[kinds, column] = count
        group, place, minor = group[starts], place[starts], minor[starts]
        total = table.sum(0)
        heads = _runs(group, place)
        main = np.repeat(np.where(minor[heads] == 0, total[heads], -1), np.diff(heads, append=len(starts)))
        no_pos = np.array([k[1] is None for k in keys])[group]
        bins = np.array([k[1] or 0 for k in keys], np.int64)[group]
        names = pa.array([k[0] for k in keys], kind).take(pa.array(group))
        cols = [names, pa.array((bins << BIN) + place, mask=no_pos), pa.array(minor.astype(np.int32)), *map(pa.array, table[:OTHER]), pa.array(np.where(main < 0, total, main))]
        return pa.RecordBatch.from_arrays(cols, names=["rname", "major", "minor", *COUNTS, "depth"])

    kind = pa.string()
    for b in _slices(batches):
        kind = b.column("rname").type
        row, *entries = _unpacked(b)
        keys = list(zip(b.column("rname").to_pylist(), b.column("bin").to_pylist(), strict=True))
        new = np.array([True, *[x != y for x, y in zip(keys, keys[1:], strict=False)]])
        group = (np.cumsum(new) - 1)[row]
        keys = [keys[i] for i in np.flatnonzero(new).tolist()]
        if held:
            if held[0] != keys[0]:
                keys, group = [held[0], *keys], group + 1
            group, *entries = [np.concatenate(x) for x in zip((np.zeros(len(held[1][0]), np.int64), *held[1]), (group, *entries), strict=True)]
        place, minor, kinds, count = entries
        bits = int(minor.max()).bit_length()
        codes = (((((group << BIN) | place) << bits) | minor) << 4) | kinds
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = _runs(codes)
        count, codes = np.add.reduceat(count[order], starts), codes[starts]
        group, place, minor, kinds = codes >> (bits + 4 + BIN), (codes >> (bits + 4)) & ((1 << BIN) - 1), (codes >> 4) & ((1 << bits) - 1), codes & 15
        cut = int(np.searchsorted(group, len(keys) - 1))
        held = keys[-1], (place[cut:], minor[cut:], kinds[cut:], count[cut:])
        if cut:
            yield shown(keys, (group[:cut], place[:cut], minor[:cut], kinds[:cut], count[:cut]), kind)
    if held:
        yield shown([held[0]], (np.zeros(len(held[1][0]), np.int64), *held[1]), kind)


def pileup_counts(records: DataFrame) -> DataFrame:
    """(rname, major, minor, depth, a c g t and deletions by strand): counts of the
    aligned bases of each reference column; insertions are minor columns 1, 2, ...

    Bases past the end of the sequence count for the depth only, those of a record
    without sequence not at all.
    """
    plain = records.select(F.col("rname").cast("string").alias("rname"), F.col("flag").cast("int").alias("flag"), F.col("pos").cast("long").alias("pos"), "cigar", "seq")
    bins = plain.mapInArrow(_count, "rname string, bin long, wide int, steps binary, minors binary, kinds binary, counts binary")
    keys = [F.xxhash64("rname", "bin").alias("h"), F.col("rname"), F.col("bin")]
    bins = bins.select(*keys, *bins.columns[2:]).repartition("h").sortWithinPartitions("h", "rname", "bin").drop("h")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return bins.mapInArrow(_sum, f"rname string, major long, minor int, {counts}, depth long")
