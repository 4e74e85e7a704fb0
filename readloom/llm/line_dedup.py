"""Removal of lines that many documents share (DataFrame functions only).

Lines are hashed inside each row, where repeats within a document fall away, so
that one (document, key) pair is exploded once and counting documents is a sum
with map-side combining: a line that a third of all documents hold costs each
map task one row. The frequent keys then meet the exploded pairs in an equi-join
(a hot key is a skewed join partition, which AQE splits) and only positions of
dropped lines return to the documents; the texts move once.

Defined cases: null or empty text is one empty line; a repeated row counts as a
document of its own; among holders a null doc_id counts as smaller than any
other; rows that tie as largest holder all keep their lines. Other columns pass
through; ``n_lines``, ``n_dropped`` and the text column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import ascii_lower, strip_blanks, text_key


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs with dropped lines gone from the text, plus n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points in at least ``min_docs`` documents lose all
    lines but those of the largest ``id_col`` that holds them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = docs.select(F.col(id_col).alias("__id"), text_key(F.col(text_col)).alias("__k"), text.alias("__text"))
    key = lambda line: strip_blanks(ascii_lower(line))
    hashed = F.transform(
        F.filter(F.transform(F.split("__text", "\n", -1), lambda x, i: F.struct(i.alias("at"), key(x).alias("key"))), lambda x: F.length(x["key"]) >= min_chars),
        lambda x: F.struct(x["at"].alias("at"), F.xxhash64(F.lit(1), x["key"]).alias("h1"), F.xxhash64(F.lit(2), x["key"]).alias("h2")),
    )
    # The pairs carry 128 bits of the key instead of the line itself.
    lines = ident.select("__id", "__k", F.explode(hashed).alias("x")).select("__id", "__k", "x.*")
    keys = F.array_distinct(F.transform(hashed, lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    held = ident.select("__id", F.explode(keys).alias("x")).select("__id", "x.*")
    frequent = held.groupBy("h1", "h2").agg(F.count("*").alias("__n"), F.max("__id").alias("__keep")).filter(F.col("__n") >= min_docs).drop("__n")
    gone = (
        lines.join(frequent, ["h1", "h2"])
        .filter(~F.col("__id").eqNullSafe(F.col("__keep")))
        .select(F.col("__id").alias("__gid"), F.col("__k").alias("__gk"), "at")
        .groupBy("__gid", "__gk")
        .agg(F.collect_set("at").alias("__at"))
    )
    full = docs.withColumn("__k", text_key(F.col(text_col)))
    joined = full.join(gone, full[id_col].eqNullSafe(gone["__gid"]) & (full["__k"] == gone["__gk"]), "left")
    split = F.split(text, "\n", -1)
    at = F.coalesce("__at", F.array().cast("array<int>"))
    kept = F.when(F.size(at) == 0, text).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(at, i)), "\n"))
    out = joined.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.size(at).cast("long"), text_col: kept})
    names = list(dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]))
    return out.select(*names)


