"""Hooks for models that are not part of the engine (MOD-10..16, JOI-17).

A predictor is made once a task from a factory that tasks can pickle; it gets
batches and gives arrays. Chunking before and stitching after are the engine's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.intervals import chunk_starts
from readloom.operators.signal import stitch


def predict(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a predictor over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def chunked(reads: DataFrame, size: int, overlap: int, stride: int = 1, signal: str = "signal") -> DataFrame:
    """(read_id, offset, chunk) of a signal column."""
    at = F.explode(chunk_starts(F.size(signal).cast("long"), size, overlap, stride)).alias("offset")
    rows = reads.select("read_id", signal, at)
    return rows.select("read_id", "offset", F.slice(signal, (F.col("offset") + 1).cast("int"), size).alias("chunk"))


def stitched(chunks: DataFrame, stride: int) -> DataFrame:
    """(read_id, seq, qstring, moves) of called chunks (read_id, offset, seq, qstring,
    moves). A read's chunks meet in one row, which is as long as the read."""
    parts = chunks.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("offset", "seq", "qstring", "moves"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [stitch([(int(p["offset"]), p["seq"], p["qstring"], list(p["moves"])) for p in x], stride) for x in b["parts"]]
            yield pd.DataFrame({"read_id": b["read_id"], "seq": [o[0] for o in out], "qstring": [o[1] for o in out], "moves": [o[2] for o in out]})

    return parts.mapInPandas(run, "read_id string, seq string, qstring string, moves array<int>")


def align(reads: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Alignment records of an external aligner."""
    return predict(reads, factory, "qname string, flag int, rname string, pos long, mapq int, cigar string, nm int, score int")
