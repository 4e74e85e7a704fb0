"""Queries that run kernels over whole tables (rows only: SQL can't express them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import kernels as K
from readloom.plans.mapping import relation
from readloom.plans.registry import query

FRONT = [K.Query("P1_FWD", "ACGTTGCANNACGT"), K.Query("P2_FWD", "GGTTAACCGGTACA")]
REAR = [K.Query("P1_REV", "TGCATTGCACGA"), K.Query("P2_REV", "CCATGGTTAACG")]
CODES = (("BC01", "ACGTTGCATG"), ("BC02", "GGATCCATTA"), ("BC03", "TTGACCAGTC"))


@query("krn01_adapter_detect")
def adapters(spark, d):
    out = K.detect(relation(spark, d, "reads"), FRONT, REAR, 75)
    return out.select("read_id", F.col("front.name").alias("front"), F.round("front.score", 6).alias("front_score"), F.col("rear.name").alias("rear"), F.round("rear.score", 6).alias("rear_score"))


@query("krn02_primer_orientation")
def primers(spark, d):
    return K.primer_orientation(K.detect(relation(spark, d, "reads"), FRONT, REAR, 150), 0.6).select("read_id", "primer", "orientation")


@query("krn05_barcode_classify")
def classify(spark, d):
    kit = K.Kit("KIT", "ACGTTG", "CATGCA", CODES, double_ends=True)
    return K.classify_barcodes(relation(spark, d, "reads"), kit).select("read_id", "barcode", "penalty", F.round("flank_score", 6).alias("flank_score"))
