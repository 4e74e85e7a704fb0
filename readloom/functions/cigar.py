"""Column functions on CIGAR texts (CIG-*, AGG-19, AGG-20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY, REFERENCE = ["M", "I", "S", "=", "X"], ["M", "D", "N", "=", "X"]


def parse(cigar: Column) -> Column:
    """Array of (n, op)."""
    found = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))


def text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["n"].cast("string"), o["op"])), "")


def total(ops: Column, kinds: list[str]) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin(kinds), o["n"]).otherwise(0))


def op_counts(cigar: Column, nm: Column) -> Column:
    """Bases by kind; substitutions are the edit distance less gaps."""
    ops = parse(cigar)
    match, ins, dele, clip = total(ops, ["M", "=", "X"]), total(ops, ["I"]), total(ops, ["D"]), total(ops, ["S", "H"])
    return F.struct(match.alias("matches"), ins.alias("insertions"), dele.alias("deletions"), clip.alias("clips"), (nm - ins - dele).alias("substitutions"))


def accuracy(cigar: Column, nm: Column) -> Column:
    """Total and substitution accuracy, each in 0..1."""
    c = op_counts(cigar, nm)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    span = c["matches"] + c["insertions"] + c["deletions"]
    return F.struct(
        F.when(span > 0, clamp(1 - nm / span)).otherwise(0.0).alias("total"),
        F.when(c["matches"] > 0, clamp(1 - c["substitutions"] / c["matches"])).otherwise(0.0).alias("snp"),
    )


def _with_offsets(ops: Column, kinds: list[str]) -> Column:
    """ops with the query or reference place before each."""
    step = lambda acc, o: F.struct((acc["at"] + F.when(o["op"].isin(kinds), o["n"]).otherwise(0)).alias("at"), F.concat(acc["out"], F.array(F.struct(o["n"].alias("n"), o["op"].alias("op"), acc["at"].alias("at")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<n:int,op:string,at:int>>").alias("out"))
    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


def trim(cigar: Column, begin: Column, end: Column) -> Column:
    """The CIGAR of the query bases begin..end; it begins and ends with ops that use the query."""
    placed = _with_offsets(parse(cigar), QUERY)
    uses = lambda o: o["op"].isin(QUERY)
    lo, hi = lambda o: F.greatest(o["at"], begin), lambda o: F.least(o["at"] + o["n"], end)
    inside = F.filter(placed, lambda o: F.when(uses(o), hi(o) > lo(o)).otherwise((o["at"] > begin) & (o["at"] < end)))
    return text(F.transform(inside, lambda o: F.struct(F.when(uses(o), hi(o) - lo(o)).otherwise(o["n"]).alias("n"), o["op"].alias("op"))))


def reference_at(cigar: Column, query_pos: Column) -> Column:
    """Reference bases before a query position."""
    step = lambda acc, o: F.struct(
        (acc["q"] + F.when(o["op"].isin(QUERY), o["n"]).otherwise(0)).alias("q"),
        (acc["r"] + F.when(acc["q"] >= query_pos, 0).when(o["op"].isin(["M", "=", "X"]), F.least(o["n"], (query_pos - acc["q"]).cast("int"))).when(o["op"].isin(["D", "N"]), o["n"]).otherwise(0)).alias("r"),
    )
    return F.aggregate(parse(cigar), F.struct(F.lit(0).alias("q"), F.lit(0).alias("r")), step, lambda acc: acc["r"])
