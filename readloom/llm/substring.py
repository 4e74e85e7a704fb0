"""Removal of repeated word windows through a log-structured fingerprint index.

Windows of k words are fingerprinted by their minimiser: of the grams of
``GRAM`` words inside a window the one of smallest hash (the leftmost of equal
ones). Equal windows have equal minimisers at equal distances, so a window can
repeat only where its minimiser does, and consecutive windows share one: about
one word in twelve makes a fingerprint. Occurrences of a fingerprint whose whole
surrounding (all windows around it) is equal form one class, so a passage that
thousands of documents share is one entry, and no pairs are formed.

The index is a folder of immutable runs, bucketed and sorted by fingerprint: each
entry has (h, around, c, id), c occurrences of a class of which ``id`` is one
document. A batch becomes a run; the new run meets every earlier one in a merge join
of buckets, without a shuffle and without a sort. Classes of a fingerprint that
occurs again are verified: one document of each is fetched by its id, and its window
hashes are compared. Texts of other documents are not touched. What repeats is
marked in the new batch and, where an earlier occurrence was the only one until
then, in the earlier document as well. ``compact`` merges all runs into one.

Runs are named by the batches that they cover. A run counts once its ``_SUCCESS``
file is there, and not at all if a wider one covers it, so a writer or a compaction
that dies halfway changes nothing; a batch added again under its number is not
counted twice.

Defined cases: null and empty texts have no words and keep nothing; texts
shorter than k words lose nothing; a repeated row is a document of its own; rows of
one id and different texts are told apart; a null id is an id.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import hashing as H
from readloom.llm.common import _path, _quietly, _tidy, drop_table, release, shared_dir, text_key, written

GRAM = 12
FAN = 2  # runs that are merged into one
BATCHES = 3


def _sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m consecutive values."""
    width = 1
    while width * 2 <= m:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = m - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fingerprints(w: H.Words, k: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: (text, first window, windows, h, surrounding), and hashes of all windows."""
    h = H.word_hashes(w)
    whole = H.windows(h, k)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(H.U64), none.view(H.U64), whole
    m = k - gram + 1
    g = H.windows(h, gram)
    low = H.U64(24)
    at = np.arange(len(g), dtype=H.U64)
    # 40 bits of the hash, then the place: texts of one step have fewer than 2**24 words, longer ones keep order by blocks.
    if len(g) < 1 << 24:
        lead = (_sliding_min(((g >> low) << low) | at, m) & H.U64((1 << 24) - 1)).astype(np.int64)
    else:
        lead = np.array([], np.int64)
        for lo in range(0, len(whole), 1 << 23):
            part = g[lo : min(len(g), lo + (1 << 23) + m - 1)]
            lead = np.append(lead, (_sliding_min(((part >> low) << low) | at[: len(part)], m) & H.U64((1 << 24) - 1)).astype(np.int64) + lo)
    ok = H.inside(w.first, len(h), k)
    place = np.flatnonzero(ok)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(H.U64), none.view(H.U64), whole
    text = H.text_of(place, w.first)
    lead = lead[place]
    new = np.ones(len(place), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    first = place[head]
    # The surrounding: all window hashes in order, and how far the gram is.
    mixed = H.mix(whole[place] + H._P * (place - first.repeat(count) + 1).astype(H.U64))
    around = H.mix(np.add.reduceat(mixed, head) + (lead[head] - first).astype(H.U64))
    return text[head], first, count, H.mix(g[lead[head]]), around, whole


def _occurrences(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            for w in H.steps(b.column(2)):
                text, first, count, h, around, _ = fingerprints(w, k)
                if len(h):
                    row = pa.array(text + w.lo)
                    at = first - w.first[text]
                    yield pa.record_batch([ids.take(row), keys.take(row), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(H.signed(h)), pa.array(H.signed(around))], ["id", "k", "at", "n", "h", "around"])

    return run


def _fetch(k: int):
    """Columns text, id, k, asked (h, around, c, late, several): where each asked class is
    in this document, with the hashes of its windows if several classes must be compared."""
    names = ["h", "around", "c", "late", "id", "k", "at", "n", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in H.steps(b.column(0)):
                texts = len(w.first) - 1
                part = b.column(3).slice(w.lo, texts)
                flat = part.flatten()
                text, first, count, h, around, whole = fingerprints(w, k)
                if not len(flat) or not len(h):
                    continue
                number = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                owner = np.repeat(np.arange(texts), np.diff(np.asarray(part.offsets)))
                ah, aa = (number(c).astype(np.int64).view(H.U64) for c in ("h", "around"))
                key = lambda t, x, y: H.mix(H.mix(x + H._P * (t.astype(H.U64) + H.U64(1))) + y)
                found, at = np.unique(key(text, h, around), return_index=True)
                want = key(owner, ah, aa)
                place = np.minimum(np.searchsorted(found, want), len(found) - 1)
                o = at[place]
                hit = np.flatnonzero((found[place] == want) & (h[o] == ah) & (around[o] == aa) & (text[o] == owner))
                o = o[hit]
                size = np.where(number("several")[hit].astype(bool), count[o], 0)
                begin = np.cumsum(size) - size
                take = np.repeat(first[o], size) + np.arange(size.sum()) - np.repeat(begin, size)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, size.sum()).astype(np.int32)), pa.array(H.signed(whole[take])))
                row, pick = pa.array(text[o] + w.lo), pa.array(hit)
                yield pa.RecordBatch.from_arrays([*[flat.field(c).take(pick) for c in names[:4]], b.column(1).take(row), b.column(2).take(row), pa.array((first[o] - w.first[text[o]]).astype(np.int32)), pa.array(count[o].astype(np.int32)), lists], names=names)

    return run


def _cut(k: int):
    """Drops the words of marked windows; columns: text, marks, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, texts, n_words, n_gone = b.column(1), [], [], []
            for w in H.steps(b.column(0)):
                total = len(w.starts)
                part = marks.slice(w.lo, len(w.first) - 1)
                flat = part.flatten()
                gone = np.zeros(total + 1, np.int64)
                if len(flat):
                    size = np.diff(np.asarray(part.offsets)) if not part.null_count else np.array([len(x) if x is not None else 0 for x in part.to_pylist()])
                    at = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], size)
                    mask = flat.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
                    for o in range(63):
                        hit = at[(mask >> o) & 1 == 1] + o
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + k, -1)
                keep = np.cumsum(gone)[:total] == 0
                raw = w.data.tobytes()
                starts, ends = w.starts.tolist(), w.ends.tolist()
                for t in range(len(w.first) - 1):
                    lo, hi = int(w.first[t]), int(w.first[t + 1])
                    kept = np.flatnonzero(keep[lo:hi]) + lo
                    texts.append(b" ".join([raw[starts[i] : ends[i]] for i in kept.tolist()]).decode())
                    n_words.append(hi - lo)
                    n_gone.append(hi - lo - len(kept))
            rest = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), *rest], names=["text", "n_words", "n_removed", *[f"c{i}" for i in range(len(rest))]])

    return run


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings for the plans that run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bucketed(df: DataFrame, where: str, buckets: int, key: str, order: list[str], dealt: bool = False) -> None:
    """df as Parquet at ``where``, one file a bucket, sorted inside. Rows that already
    lie in the buckets' partitions (``dealt``) don't move."""
    name = f"readloom_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    w = rows.write.mode("overwrite").option("compression", "zstd").option("path", where).bucketBy(buckets, key)
    (w.sortBy(*order) if order else w).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    _tidy(df.sparkSession)


def _open_bucketed(spark: SparkSession, where: str, columns: str, buckets: int, key: str, order: list[str]) -> DataFrame:
    name = f"readloom_{uuid.uuid4().hex}"
    by = f"SORTED BY ({', '.join(order)})" if order else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) {by} INTO {buckets} BUCKETS LOCATION '{where}'")
    out = spark.table(name)
    out._readloom_table = name
    return out


def _close(*tables: DataFrame) -> None:
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._readloom_table}")


class Run(NamedTuple):
    low: int  # first and last batch that it covers
    high: int
    buckets: int
    path: str


_RUN = re.compile(r"run-(\d+)-(\d+)-of-(\d+)$")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints of all batches so far.

    ``buckets`` (default: the session's shuffle partitions) is fixed by the first
    run; ``remove_repeats`` compacts at ``fan`` runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, k: int = 35, buckets: int | None = None, fan: int = FAN, id_type: str = "bigint"):
        if not GRAM < k <= GRAM + 62:
            raise ValueError(f"k must be from {GRAM + 1} to {GRAM + 62}")
        self.spark, self.k, self.fan, self.id_type = spark, k, fan, id_type
        self.path = path or f"{shared_dir(spark)}/readloom-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
        old = self.runs()
        self.buckets = old[0].buckets if old else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[Run]:
        """Complete runs that no wider one covers, in order of their batches."""
        fs, path = _path(self.spark, self.path)
        found = []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            where = s.getPath().toString()
            m = _RUN.search(where)
            if m and fs.exists(_path(self.spark, f"{where}/_SUCCESS")[1]):
                found.append(Run(*map(int, m.groups()), where))
        wider = lambda a, b: b.low <= a.low and a.high <= b.high and (b.low, b.high) != (a.low, a.high)
        return sorted(a for a in found if not any(wider(a, b) for b in found))

    def drop(self) -> None:
        drop_table(self.spark, self.path)

    def _write(self, classes: DataFrame, low: int, high: int, dealt: bool = False) -> Run:
        run = Run(low, high, self.buckets, f"{self.path}/run-{low:06d}-{high:06d}-of-{self.buckets}")
        _bucketed(classes, run.path, self.buckets, "h", ["h"], dealt)
        return run

    def _read(self, run: Run) -> DataFrame:
        return _open_bucketed(self.spark, run.path, f"h BIGINT, around BIGINT, c BIGINT, id {self.id_type}", run.buckets, "h", ["h"])

    def compact(self) -> None:
        """Merges all runs into one, bucket by bucket: nothing is shuffled."""
        old = self.runs()
        if len(old) < 2:
            return
        tables = [self._read(r) for r in old]
        # The union of tables in equal buckets keeps them, so the sums form where the rows are.
        with _settings(self.spark, spark__sql__unionOutputPartitioning="true"):
            merged = reduce(DataFrame.union, tables).groupBy("h", "around").agg(F.sum("c").alias("c"), F.min("id").alias("id"))
            self.plans = [merged._jdf.queryExecution().executedPlan().toString()]
            dealt = "Exchange" not in self.plans[0]
            self._write(merged, old[0].low, max(r.high for r in old), dealt)
        _close(*tables)
        for r in old:
            drop_table(self.spark, r.path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, batch: int | None = None) -> DataFrame:
        """Takes up a batch; (id, k, at, mask) for windows that now repeat.

        ``at`` is the first window (place of its first word), bit o of ``mask``
        says that window ``at + o`` also starts elsewhere, in the batch or in an
        earlier one. The tables that the result reads are ``held`` until it is written. Rows are those of the batch, and of earlier documents whose
        windows were the only ones until now; ``history`` has these documents (from
        it the few that must be verified are fetched). ``batch`` numbers the batch; one that is
        added again under its number is not counted again.
        """
        k, runs = self.k, self.runs()
        batch = batch if batch is not None else max((r.high for r in runs), default=-1) + 1
        again = [r for r in runs if r.low <= batch <= r.high]
        if again and again[0].low != again[0].high:
            raise ValueError(f"batch {batch} is part of a compacted run")
        earlier = [r for r in runs if r not in again]
        if earlier and history is None:
            raise ValueError("matches with earlier batches are verified in history")
        rows = _rows(docs, id_col, text_col)
        id_type = rows.schema["id"].dataType.simpleString()
        if id_type != self.id_type:
            raise ValueError(f"the index has ids of type {self.id_type}, the batch {id_type}")
        found = written(rows.mapInArrow(_occurrences(k), f"id {id_type}, k long, at int, n int, h long, around long"), "found")
        if again:
            run = again[0]
        else:
            run = self._write(found.groupBy("h", "around").agg(F.count("*").alias("c"), F.min("id").alias("id")), batch, batch)
        new, olds = self._read(run), [self._read(r) for r in earlier]
        with _settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            # Merge joins of sorted buckets: entries of either side whose fingerprint the other has.
            more = new.groupBy("h").agg(F.sum("c").alias("m")).filter("m > 1").select("h")
            mine = [new.join(more.hint("merge"), "h", "left_semi")] + [new.join(o.select("h").hint("merge"), "h", "left_semi") for o in olds]
            theirs = [o.join(new.select("h").hint("merge"), "h", "left_semi") for o in olds]
            self.plans = [x._jdf.queryExecution().toString() for x in mine[1:] + theirs]
            # An entry of the new run may meet several runs.
            met = [x.withColumn("old", F.lit(0).cast("long")) for x in mine] + [x.withColumn("old", F.col("c")) for x in theirs]
            met = reduce(DataFrame.unionByName, met)
            fresh = F.max(F.when(F.col("old") == 0, F.col("c")))
            sums = [F.sum("old").alias("old"), F.coalesce(fresh, F.lit(0)).alias("fresh"), F.min(F.when(F.col("old") > 0, F.col("id"))).alias("old_id"), F.min("id").alias("any_id")]
            classes = met.groupBy("h", "around").agg(*sums).withColumn("c", F.col("old") + F.col("fresh"))
            classes = classes.withColumn("late", F.col("old") == 1).withColumn("id", F.when(F.col("late"), F.col("old_id")).otherwise(F.col("any_id")))
            classes = written(classes.select("h", "around", "c", "late", "id"), "classes")
        _close(new, *olds)
        # Only a fingerprint of several classes needs its windows compared.
        several = classes.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h", F.lit(True).alias("several"))
        asked = classes.join(several, "h", "left").withColumn("several", F.coalesce("several", F.lit(False))).filter("several or late")
        asked = asked.groupBy(F.col("id").alias("aid")).agg(F.collect_list(F.struct("h", "around", "c", "late", "several")).alias("asked"))
        both = rows if history is None else rows.unionByName(_rows(history, id_col, text_col))
        got = both.join(asked.hint("shuffle_hash"), both["id"].eqNullSafe(asked["aid"])).select("text", "id", "k", "asked")
        got = written(got.mapInArrow(_fetch(k), f"h long, around long, c long, late boolean, id {id_type}, k long, at int, n int, x array<long>"), "windows")
        # A repeated row answers twice, hence distinct.
        sent = got.select("h", "around", "c", F.posexplode("x").alias("o", "x")).distinct()
        twice = sent.groupBy("h", "x").agg(F.sum("c").alias("m")).filter("m > 1").select("h", "x")
        partly = sent.filter("c = 1").join(twice, ["h", "x"]).groupBy("h", "around").agg(F.expr("bit_or(shiftleft(1L, o))").alias("mask"))
        # All windows of a class that occurs twice.
        wholly = classes.filter("c > 1").select("h", "around", F.lit(-1).cast("long").alias("mask"))
        masks = wholly.unionByName(partly)
        every = F.expr("shiftleft(1L, n) - 1")
        ours = found.join(masks, ["h", "around"])
        late = got.filter("late").join(masks, ["h", "around"])
        self.held = (found, classes, got)
        return reduce(DataFrame.union, [x.select("id", "k", "at", F.col("mask").bitwiseAND(every).alias("mask")) for x in (ours, late)])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.col("__k") if "__k" in docs.columns else text_key(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), key.alias("k"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, batches: int = BATCHES) -> DataFrame:
    """docs with every word gone that a repeated window of k words covers.

    The documents go through an index in ``batches`` batches by their id; its runs
    are compacted on the way. Adds n_words and n_removed; the kept words are joined
    by one space. Other columns pass through.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, k=k, id_type=docs.schema[id_col].dataType.simpleString())
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_words", "n_removed")]
    # Texts move once, into buckets by id: fetching and marking find them there.
    table = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("__k"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    where = f"{index.path}-texts"
    _bucketed(table, where, index.buckets, "id", [])
    atexit.register(_quietly, spark, where)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    texts = _open_bucketed(spark, where, columns, index.buckets, "id", [])
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(batches))
    marks = []
    for i in range(batches):
        new, old = texts.filter(part == i), texts.filter(part < i)
        marks.append(written(index.add(new, "id", "text", old if i else None, i), "marks"))
        release(*index.held)
        if i + 1 < batches and len(index.runs()) >= index.fan:
            index.compact()
    index.drop()
    per = reduce(DataFrame.unionByName, marks).groupBy(F.col("id").alias("__mid"), F.col("k").alias("__mk")).agg(F.collect_set(F.struct("at", "mask")).alias("__marks"))
    joined = texts.join(per.hint("shuffle_hash"), texts["id"].eqNullSafe(per["__mid"]) & (texts["__k"] == per["__mk"]), "left")
    none = F.array().cast("array<struct<at:int,mask:bigint>>")
    joined = joined.select("text", F.coalesce("__marks", none).alias("m"), "id", *[F.col(f"c{i}") for i in range(len(rest))])
    kept = [("id", docs.schema[id_col].dataType), *[(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]]
    kind = ", ".join(["text string, n_words long, n_removed long", *[f"c{i} {t.simpleString()}" for i, (_, t) in enumerate(kept)]])
    out = joined.mapInArrow(_cut(index.k), kind)
    by = {text_col: F.col("text"), "n_words": F.col("n_words"), "n_removed": F.col("n_removed"), id_col: F.col("c0")} | {c: F.col(f"c{i + 1}") for i, c in enumerate(rest)}
    return out.select(*[by[c].alias(c) for c in dict.fromkeys([*docs.columns, "n_words", "n_removed"])])
