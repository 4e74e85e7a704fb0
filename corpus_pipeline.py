"""The corpus pipeline: documents to packed token sequences.

Every stage takes (spark, docs, sf_dir), docs being its predecessor's output, and
all but the last return the columns of docs. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import langid, line_dedup, minhash, mixing, packing
from readloom.llm.common import text_key, written
from readloom.llm.queries import quality_weights


OWN = ("doc_id", "text", "lang", "source", "n_chars")  # columns that stages know by name


def aside(docs: DataFrame) -> DataFrame:
    """Further columns under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"__x{i}") for i, c in enumerate(docs.columns)])


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order and by their names."""
    return out.select(*[F.col(c if c in OWN else f"__x{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them) and those whose
    language is ambiguous go, as do ties of two languages. Repeated rows share their
    fate; without any labelled document no language is known and all go."""
    mine = aside(docs)
    out = langid.predict(mine, langid.fit(mine), keep=tuple(c for c in mine.columns if c != "doc_id"))
    out = out.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).withColumnRenamed("id", "doc_id")
    return back(out, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one of largest doc_id (of ties in
    all of them). Null and empty texts become empty; no document goes."""
    out = line_dedup.dedup_lines(aside(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return back(out, docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id. Texts
    without words are copies of nothing and stay; of repeated rows (equal id and
    text) one stays; a null id stays only where its whole group has none."""
    mine = aside(docs)
    found = minhash.near_duplicates(mine, percent=80)
    kept = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__kid"), F.col("k").alias("__kk")).distinct()
    keyed = mine.withColumn("__k", text_key(F.col("text")))
    out = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__kid"]) & (keyed["__k"] == kept["__kk"]))
    return back(out.dropDuplicates(["doc_id", "__k"]), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: whole epochs, and a last share
    by key. Null sources are one source; texts without words come with whole epochs
    only; repeated rows are taken alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mine = aside(docs)
    taken = mixing.mix_sources(mine, quality=quality_weights(labels)).filter("epochs > 0")
    taken = taken.groupBy(F.col("id").alias("__mid"), F.col("k").alias("__mk")).agg(F.max("epochs").alias("__times"))
    keyed = mine.withColumn("__k", text_key(F.col("text")))
    out = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken["__mid"]) & (keyed["__k"] == taken["__mk"]))
    return back(out.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null or empty text is its end token;
    each of repeated rows has pieces of its own; no rows give no pieces."""
    import public_tokenizers

    out = packing.pack(aside(docs), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)
    return out.withColumnRenamed("id", "doc_id").drop("k")


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

# Classifier, sampling by hashes and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
