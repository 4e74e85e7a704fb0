"""Batches of items of different sizes (MAT-09)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def batch_numbers(sizes: np.ndarray, limit: int) -> np.ndarray:
    """A batch ends with the item that brings its sum to ``limit``, the next one starts at 0."""
    total = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    at, base = 0, 0
    while at < len(sizes):
        at = max(at, int(np.searchsorted(total, base + limit, "left"))) + 1
        if at < len(sizes):
            out[at] = 1
            base = total[at - 1]
    return np.cumsum(out)


def size_batches(items: DataFrame, key: list[str], order: str, size: str, limit: int) -> DataFrame:
    """items with the number of their batch: consecutive items (by ``order``) of one key.
    Sequential by nature; a task holds the items of one key."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return part.assign(batch=batch_numbers(part[size].to_numpy(), limit))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.groupBy(*key).applyInPandas(run, f"{schema}, batch long")
