"""Column functions that put texts together (STR-07, STR-25, SNK-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import cigar as C


def join_items(items: Column, sep: str) -> Column:
    """Items with separators; empty (and null) ones in front vanish with theirs."""
    filled = F.transform(items, lambda x: F.coalesce(x, F.lit("")))
    first = F.array_position(F.transform(filled, lambda x: x != ""), F.lit(True)).cast("int")
    return F.when(first == 0, F.lit("")).otherwise(F.array_join(F.slice(filled, F.greatest(first, F.lit(1)), F.greatest(F.size(filled), F.lit(1))), sep))


def alignment_text(query: Column, target: Column, cigar: Column, start: Column) -> Column:
    """Three lines: the query with gaps, ``|`` for equal and ``*`` for different bases, and
    the target from ``start`` on with gaps. The CIGAR has ``=``, ``X``, ``I`` and ``D``."""
    def step(acc: Column, o: Column) -> Column:
        op, n = o["op"], o["n"]
        piece = lambda text, at, gap: F.when(op == gap, F.repeat(F.lit("-"), n)).otherwise(F.substr(text, at + 1, n))
        mark = F.repeat(F.when(op == "=", F.lit("|")).when(op == "X", F.lit("*")).otherwise(F.lit(" ")), n)
        return F.struct(
            (acc["q"] + F.when(op == "D", 0).otherwise(n)).alias("q"), (acc["t"] + F.when(op == "I", 0).otherwise(n)).alias("t"),
            F.concat(acc["upper"], piece(query, acc["q"], "D")).alias("upper"), F.concat(acc["middle"], mark).alias("middle"), F.concat(acc["lower"], piece(target, acc["t"], "I")).alias("lower"),
        )

    zero = F.struct(F.lit(0).alias("q"), start.cast("int").alias("t"), *[F.lit("").alias(x) for x in ("upper", "middle", "lower")])
    return F.aggregate(C.parse(cigar), zero, step, lambda acc: F.concat_ws("\n", acc["upper"], acc["middle"], acc["lower"]))


def single_file_name(ms: Column, kind: str = "bam") -> Column:
    """``calls_<UTC date>_T<time>.<kind>``."""
    return F.concat(F.lit("calls_"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'_T'HH-mm-ss"), F.lit(f".{kind}"))
