"""Queries on pile-ups and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import variants as V
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

VARS = cte("variants")


@query("flt11_valid_variants", f"WITH {VARS} SELECT var FROM variants WHERE NOT (alt1 = ref AND alt2 = ref)")
def valid(spark, d):
    return relation(spark, d, "variants").filter(V.is_valid(F.col("ref"), F.array("alt1", "alt2"))).select("var")


@query("prj27_genotype_normalise", f"WITH {VARS}, a AS (SELECT var, ref, qual, list_sort(list_distinct(list_filter([alt1, alt2], lambda a: a <> ref))) AS alts, alt1, alt2 FROM variants), n AS (SELECT *, CASE WHEN alt1 = ref THEN 0 ELSE list_position(alts, alt1) END AS x, CASE WHEN alt2 = ref THEN 0 ELSE list_position(alts, alt2) END AS y FROM a) SELECT var, array_to_string(alts, ',') AS alts, least(x, y) || '/' || greatest(x, y) AS gt, CAST(round(qual) AS INTEGER) AS gq, CASE WHEN qual >= 15 THEN 'PASS' ELSE 'LowQual' END AS filter FROM n")
def genotype(spark, d):
    g = V.normalise_genotype(F.col("ref"), F.array("alt1", "alt2"), F.col("qual"), 15)
    return relation(spark, d, "variants").select("var", g.alias("g")).select("var", F.array_join("g.alts", ",").alias("alts"), "g.gt", "g.gq", "g.filter")


@query("var01_variant_end", f"WITH {VARS} SELECT var, CASE WHEN var % 5 = 0 THEN pos + 50 WHEN var % 5 = 1 THEN pos + 7 ELSE pos + greatest(1, length(ref)) END AS \"end\" FROM variants")
def ends(spark, d):
    info, size = F.when(F.col("var") % 5 == 0, F.col("pos") + 50), F.when(F.col("var") % 5 == 1, F.lit(7))
    return relation(spark, d, "variants").select("var", V.variant_end(F.col("pos"), F.col("ref"), info, size).cast("long").alias("end"))


@query("var02_variant_columns", "WITH c AS (SELECT l_suppkey AS seq_id, l_partkey AS major, l_linenumber - 1 AS minor, min(l_returnflag) AS ref, max(l_returnflag) AS call FROM lineitem GROUP BY ALL), m AS (SELECT *, max(minor) OVER w AS mm, max(CASE WHEN ref <> call THEN 1 ELSE 0 END) OVER w AS any_ FROM c WINDOW w AS (PARTITION BY seq_id, major)) SELECT seq_id, major, minor, CASE WHEN mm > 0 THEN any_ = 1 ELSE ref <> call END AS varies FROM m")
def columns(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("seq_id"), F.col("l_partkey").alias("major"), (F.col("l_linenumber") - 1).alias("minor")).agg(F.min("l_returnflag").alias("ref"), F.max("l_returnflag").alias("call"))
    return V.variant_columns(c).select("seq_id", "major", "minor", "varies")


@query("flt10_hemizygous", f"WITH {VARS}, v AS (SELECT var, seq_id, pos, pos + length(ref) AS e, CASE WHEN alt1 = alt2 THEN '1/1' ELSE '1/2' END AS gt FROM variants), h AS (SELECT 'chr1' AS seq_id, 3000 AS s, 9000 AS e UNION ALL SELECT 'chr3', 0, 5001) SELECT var, gt FROM v WHERE gt = '1/1' OR NOT EXISTS (SELECT 1 FROM h WHERE h.seq_id = v.seq_id AND v.pos >= h.s AND v.e <= h.e)")
def hemizygous(spark, d):
    v = relation(spark, d, "variants").select("var", "seq_id", F.col("pos").alias("start"), (F.col("pos") + F.length("ref")).alias("end"), F.when(F.col("alt1") == F.col("alt2"), "1/1").otherwise("1/2").alias("gt"))
    h = spark.createDataFrame([("chr1", 3000, 9000), ("chr3", 0, 5001)], "seq_id string, start long, end long")
    return V.hemizygous_filter(v, h).select("var", "gt")


@query("krn16_merge_variants", f"WITH {VARS}, v AS (SELECT var, seq_id, pos, pos + length(ref) AS e FROM variants), b AS (SELECT *, max(e) OVER (PARTITION BY seq_id ORDER BY pos, e, var ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT * FROM v)), n AS (SELECT *, CASE WHEN before IS NULL OR pos > before THEN 1 ELSE 0 END AS new FROM b) SELECT var, seq_id, CAST(sum(new) OVER (PARTITION BY seq_id ORDER BY pos, e, var ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"group\" FROM n")
def merge(spark, d):
    v = relation(spark, d, "variants").select("var", "seq_id", "pos", (F.col("pos") + F.length("ref")).alias("end")).distinct()
    return V.merge_variants(v).select("var", "seq_id", "group")


@query("srt02_variant_rank", f"WITH {VARS} SELECT var, ref, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY pos, ref, alt1, alt2, qual, var) AS INTEGER) AS rank FROM (SELECT DISTINCT * FROM variants)")
def rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("pos", "ref", "alt1", "alt2", "qual", "var")
    return relation(spark, d, "variants").distinct().select("var", "ref", F.row_number().over(w).alias("rank"))


@query("agg21_majority_vote", "WITH n AS (SELECT l_partkey AS pos, l_linestatus AS target, l_returnflag AS base, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY pos, target) AS top FROM n), b AS (SELECT pos, target, top, count(*) AS tied, min(base) AS b FROM t WHERE n = top GROUP BY ALL) SELECT pos, target AS target_base, CASE WHEN top >= 2 AND tied = 1 THEN b ELSE target END AS base FROM b")
def vote(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("target_base"), F.col("l_linestatus").alias("t"), F.col("l_returnflag").alias("base"))
    return V.majority_vote(c, ["pos", "t"]).select("pos", F.col("t").alias("target_base"), "base")


def _pile(spark, d):
    r = relation(spark, d, "records")
    return r.withColumn("seq", F.expr("repeat('ACGT', cast(floor(len_q / 4) as int) + 1)"))


@query("agg08_pileup_counts", f"""WITH {cte('records')}, o AS (SELECT uid, rname, flag, pos, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS op, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) AS k FROM (SELECT *, row_number() OVER () AS uid FROM records)),
c AS (SELECT uid, rname, flag, pos, k, right(op, 1) AS op, CAST(left(op, length(op) - 1) AS BIGINT) AS n FROM o),
p AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS q, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS r FROM c WINDOW w AS (PARTITION BY uid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT rname, flag, pos, op, q, r, unnest(generate_series(1, n)) AS i FROM p WHERE op IN ('M', 'I', 'D', '=', 'X')),
b AS (SELECT rname, flag & 16 <> 0 AS rev, CAST(CASE WHEN op = 'I' THEN pos + r - 1 ELSE pos + r + i - 1 END AS BIGINT) AS major, CAST(CASE WHEN op = 'I' THEN i ELSE 0 END AS INTEGER) AS minor, CASE WHEN op = 'D' THEN '-' ELSE substring('ACGT', CAST((q + i - 1) % 4 + 1 AS INTEGER), 1) END AS b FROM e)
SELECT rname, major, minor, count(*) FILTER (b = 'A' AND NOT rev) AS a_fwd, count(*) FILTER (b = 'A' AND rev) AS a_rev, count(*) FILTER (b = '-') AS dels, count(*) AS n FROM b GROUP BY rname, major, minor""")
def pileup(spark, d):
    c = V.pileup_counts(_pile(spark, d))
    total = sum((F.col(x) for x in c.columns if x.endswith(("_fwd", "_rev"))), F.lit(0))
    return c.select("rname", "major", "minor", "a_fwd", "a_rev", (F.col("del_fwd") + F.col("del_rev")).alias("dels"), total.alias("n"))


@query("agg13_normalised_counts", "WITH c AS (SELECT l_partkey AS pos, count(*) AS depth, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey) SELECT pos, round(r / CAST(depth AS DOUBLE), 6) AS share FROM c")
def shares(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("pos")).agg(F.count("*").alias("depth"), F.count_if(F.col("l_returnflag") == "R").alias("r_fwd"))
    return V.normalised_counts(c).select("pos", F.round("r_fwd", 6).alias("share"))


@query("agg10_gvcf_compaction")
def compaction(spark, d):
    r = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("chr"), (F.col("user_id") % 7).cast("string")).alias("seq_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", "0/1").otherwise("0/0").alias("gt"), (F.col("event_id") * 31 % 60).cast("int").alias("gq"))
    return V.gvcf_compact(r, [10, 20, 40], [2, 5, 10])


@query("prj26_reference_records", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(60 AS DOUBLE) END AS qual, l_orderkey + l_linenumber AS \"end\" FROM lineitem")
def reference(spark, d):
    base = F.when(F.col("l_linenumber") % 3 == 0, "N").otherwise("A")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(base.rlike("^[ACGTacgt]$"), F.lit(60.0)).alias("qual"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"))


@query("snk12_vcf_lines", f"WITH {VARS} SELECT var, concat_ws(chr(9), seq_id, CAST(pos + 1 AS VARCHAR), '.', ref, alt1 || ',<*>', CAST(round(qual, 1) AS VARCHAR), 'PASS', '.', 'GT:GQ', '0/1:' || CAST(round(qual) AS INTEGER)) AS line FROM variants")
def vcf(spark, d):
    from readloom.sources.sinks import vcf_line

    v = relation(spark, d, "variants")
    return v.select("var", vcf_line(F.col("seq_id"), F.col("pos"), F.col("ref"), F.array("alt1"), F.round("qual", 1), F.lit("PASS"), F.lit(None).cast("string"), [("GT", F.lit("0/1")), ("GQ", F.round("qual").cast("int").cast("string"))], gvcf=True).alias("line"))
