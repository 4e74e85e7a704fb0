"""Streaming: pairing, sibling barriers and parent tags with keyed state (STM-*).

State is kept by key with arbitrary state in pandas; eviction is by processing-time
timeout or by event time behind the watermark. Evicted rows are emitted, not lost.
The batch operators of ``readloom.operators.reads`` are their oracle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "template_id string, complement_id string, gap_ms long"
HELD = 16  # reads that one key keeps


def pair_stream(reads: DataFrame, max_gap_ms: int = 10_000, delay: str = "10 seconds") -> DataFrame:
    """Pairs of time neighbours of one channel, run and flow cell as reads arrive.

    ``reads``: read_id, channel, run_id, flowcell_id, ts (event time), start_time_ms,
    end_ms. Reads wait until the watermark has passed them by the pair gap, so that
    late neighbours are still seen; then they meet their predecessor.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        if state.hasTimedOut:
            new = []
        else:
            new = [tuple(r) for p in parts for r in p[["start_time_ms", "read_id", "end_ms"]].itertuples(index=False)]
        waiting = sorted([tuple(x) for x in waiting] + new)
        ripe_until = state.getCurrentWatermarkMs() - max_gap_ms
        out, k = [], 0
        for k, (start, read_id, end) in enumerate(waiting, 1):
            if start > ripe_until and len(waiting) - k < HELD:
                k -= 1
                break
            if last is not None and 0 <= start - last[1] < max_gap_ms:
                out.append((last[0], read_id, start - last[1]))
            last = (read_id, end)
        waiting = waiting[k:]
        if waiting:
            state.update((last, [list(x) for x in waiting]))
            state.setTimeoutTimestamp(max(waiting[0][0] + max_gap_ms, state.getCurrentWatermarkMs()) + 1)
        elif last is not None and not state.hasTimedOut:
            state.update((last, []))
            state.setTimeoutTimestamp(max(last[1] + max_gap_ms, state.getCurrentWatermarkMs()) + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["template_id", "complement_id", "gap_ms"])

    keyed = reads.withWatermark("ts", delay).groupBy("channel", "run_id", "flowcell_id")
    held = "last struct<_1:string,_2:long>, waiting array<struct<_1:long,_2:string,_3:long>>"
    return keyed.applyInPandasWithState(step, PAIR, held, "append", GroupStateTimeout.EventTimeTimeout)


def barrier_stream(subreads: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """Sub-reads (read_tag, subread_id, split_count) once all of their read have come;
    a group that stays incomplete for the timeout is emitted as such."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (have,) = state.get if state.exists else ([],)
        have, expected = list(have), None
        if not state.hasTimedOut:
            for p in parts:
                have += p["subread_id"].tolist()
                expected = int(p["split_count"].max())
        whole = expected is not None and len(have) >= expected
        if whole or state.hasTimedOut:
            state.remove()
            have.sort()
            yield pd.DataFrame({"read_tag": [key[0]] * len(have), "subread_id": have, "subread_number": range(len(have)), "complete": [whole] * len(have)})
        else:
            state.update((have,))
            state.setTimeoutDuration(timeout_ms)
            yield pd.DataFrame({"read_tag": pd.Series(dtype=str), "subread_id": pd.Series(dtype="int64"), "subread_number": pd.Series(dtype="int64"), "complete": pd.Series(dtype=bool)})

    return subreads.groupBy("read_tag").applyInPandasWithState(step, "read_tag string, subread_id long, subread_number long, complete boolean", "have array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tag_stream(reads: DataFrame, duplex: DataFrame, delay: str = "10 minutes", within: str = "10 minutes") -> DataFrame:
    """Simplex reads with whether a duplex read was made of them, as a stream-stream
    left join with watermarks: a read without one is emitted when none can come any more."""
    left = reads.withWatermark("ts", delay)
    right = duplex.select(F.explode(F.split("read_id", ";")).alias("parent"), F.col("ts").alias("d_ts")).withWatermark("d_ts", delay)
    on = (left["read_id"] == right["parent"]) & (right["d_ts"] >= left["ts"]) & (right["d_ts"] <= left["ts"] + F.expr(f"interval {within}"))
    return left.join(right, on, "leftOuter").select(*[left[c] for c in reads.columns], right["parent"].isNotNull().alias("is_duplex_parent"))


def write_fan_out(stream: DataFrame, writers: list, checkpoint: str):
    """Every batch to several writers, each a function of (batch, id)."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        for w in writers:
            w(batch, n)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
