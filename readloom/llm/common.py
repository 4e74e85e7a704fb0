"""Helpers that the operators share: row keys, written tables, native text functions."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"
TIDY_S = 2.0  # least seconds between two collections of the driver
_ours: dict[str, str] = {}
_tidied = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    that is unset and all run in one process, a temporary folder that is set as such."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _ours:
        _ours[app] = tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(_ours[app])
    return "file://" + _ours[app]


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_table(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder. The table
    goes when the driver ends; ``release`` drops it earlier."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/readloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    _tidy(spark)
    out = spark.read.schema(df.schema).parquet(where)
    out._readloom_path = where
    atexit.register(_quietly, spark, where)
    return out


def _tidy(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that neither side holds any more."""
    global _tidied
    if time.monotonic() - _tidied > TIDY_S:
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)  # listeners hold a plan for a moment after its end
        _tidied = time.monotonic()


def _quietly(spark: SparkSession, where: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        drop_table(spark, where)


def release(*tables: DataFrame) -> None:
    """Drops tables that ``written`` made and that no later plan reads."""
    for t in tables:
        where = getattr(t, "_readloom_path", None)
        if where:
            drop_table(t.sparkSession, where)


def together(*tables: DataFrame) -> DataFrame:
    """All rows of tables of one schema that ``written`` made, as one scan: the plan stays as small as for one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._readloom_path for t in tables])


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other code point stays."""
    return F.translate(c, UPPER, LOWER)


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank code points; null counts 0."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.trim(blank) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(blank), " +"))).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart; null and empty differ on purpose."""
    return F.xxhash64(F.lit(17), text, text.isNull())


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on the named columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that rows of one key (column 0, sorted) stay together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] else 0
        if cut or (held and held[-1].column(0)[-1].as_py() != key[0]):
            whole = [*held, b.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
