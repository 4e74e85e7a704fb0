"""Tags of single-cell reads behind a primer (KRN-04)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from readloom.operators.kernels import ADAPTER_WILD, infix_distance

# What follows the tag, the bases that are searched, the least score.
TSO, POLY_T = "TTTCTTATATGGG", "TTTTTTTTTTTTT"
REACH = 56
LEAST = 0.8

_BACK = str.maketrans("ACGTacgt", "TGCAtgca")


def tag_windows(seqs: list[str], ways: list[str], begins: list[int], ends: list[int]) -> list[str]:
    """Bases behind the primer, as of a forward read; empty where no primer was trimmed."""
    out = []
    for s, way, a, b in zip(seqs, ways, begins, ends, strict=True):
        if way == "+" and a:
            out.append(s[a : min(b, a + REACH)])
        elif way == "-" and b != len(s):
            out.append(s[max(a, b - REACH) : b].translate(_BACK)[::-1])
        else:
            out.append("")
    return out


def single_cell_tags(reads: DataFrame) -> DataFrame:
    """reads (read_id, seq, orientation ``+`` or ``-``, trim_begin, trim_end) with the tag
    between the primer and the better of template switch and poly-T (ties: the switch),
    and with the trim moved up to the poly-T or behind the switch. Null where neither
    scores above ``LEAST``, or where nothing is trimmed off. A batch is matched at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ways = b["orientation"].tolist()
            texts = tag_windows(b["seq"].tolist(), ways, b["trim_begin"].tolist(), b["trim_end"].tolist())
            begin, end, tags = b["trim_begin"].tolist(), b["trim_end"].tolist(), [None] * len(b)
            switch, poly = (infix_distance(texts, p, ADAPTER_WILD) for p in (TSO, POLY_T))
            for i, text in enumerate(texts):
                scores = 1 - switch[0][i] / len(TSO), 1 - poly[0][i] / len(POLY_T)
                is_poly = scores[1] > scores[0]
                if not text or max(scores) <= LEAST:
                    continue
                start = int((poly if is_poly else switch)[1][i])
                cut = start if is_poly else int(switch[2][i])
                if ways[i] == "+":
                    begin[i] += cut
                else:
                    end[i] -= cut
                tags[i] = text[:start] if cut else None
            yield pd.DataFrame({"read_id": b["read_id"], "trim_begin": begin, "trim_end": end, "tag": tags})

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq", "orientation", "trim_begin", "trim_end").mapInPandas(run, f"read_id {kind}, trim_begin int, trim_end int, tag string")
