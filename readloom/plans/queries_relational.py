"""Queries on intervals, windows, aggregates, top-k and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.operators import intervals as I
from readloom.operators import reads as R
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

READS, RECORDS, BED, HITS = cte("reads"), cte("records"), cte("bed"), cte("hits")


def _islands_sql(gap: int) -> str:
    return f"""WITH {BED}, b AS (SELECT genome, start, "end", max("end") OVER (PARTITION BY genome ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT genome, start, "end" FROM bed)),
m AS (SELECT *, CASE WHEN before IS NULL OR start > before + {gap} THEN 1 ELSE 0 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY genome ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT genome, min(start) AS start, max("end") AS "end" FROM g GROUP BY genome, island"""


def _merge(gap: int):
    return lambda spark, d: I.merge_intervals(relation(spark, d, "bed"), ["genome"], gap=gap, bin_size=1 << 12)


for _name, _gap in (("agg09_interval_merge_touching", 0), ("agg09_interval_merge_inclusive", 1), ("agg09_interval_merge_distance", 25)):
    query(_name, _islands_sql(_gap))(_merge(_gap))


@query("agg11_interval_gap_fill", f"""WITH {BED}, r AS (SELECT genome, i * 5000 AS rs, i * 5000 + 3000 AS re FROM (SELECT DISTINCT genome FROM bed), (SELECT unnest(generate_series(0, 3)) AS i)),
p AS (SELECT genome, rs, re, unnest(generate_series(rs, re - 1)) AS pos FROM r),
free AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE b.genome = p.genome AND b.start <= p.pos AND b."end" > p.pos)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY genome, rs ORDER BY pos) AS k FROM free)
SELECT genome, min(pos) AS start, max(pos) + 1 AS "end" FROM g GROUP BY genome, rs, k""")  # fmt: skip
def gap_fill(spark, d):
    bed = relation(spark, d, "bed")
    r = bed.select("genome").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("genome", (F.col("i") * 5000).cast("long").alias("start"), (F.col("i") * 5000 + 3000).cast("long").alias("end"))
    return I.complement(r, bed, ["genome"])


@query("joi05_bed_hits_halfopen", f'WITH {BED}, {HITS} SELECT hit, count(region) AS hits FROM hits h LEFT JOIN bed b ON h.genome = b.genome AND NOT (h.start >= b."end" OR h."end" <= b.start) GROUP BY hit')
def bed_hits(spark, d):
    return I.overlap_counts(relation(spark, d, "hits"), relation(spark, d, "bed"), ["genome"], "hit").select("hit", "hits")


@query("joi05_bed_hits_inclusive", f'WITH {BED}, {HITS} SELECT hit, count(region) AS hits FROM hits h LEFT JOIN bed b ON h.genome = b.genome AND NOT (h.start > b."end" OR h."end" < b.start) GROUP BY hit')
def bed_hits_inclusive(spark, d):
    return I.overlap_counts(relation(spark, d, "hits"), relation(spark, d, "bed"), ["genome"], "hit", inclusive=True).select("hit", "hits")


@query("joi05_bed_hits_stranded", f"WITH {BED}, {HITS} SELECT hit, count(*) AS hits FROM hits h JOIN bed b ON h.genome = b.genome AND h.start < b.\"end\" AND h.\"end\" > b.start AND (b.bed_strand = '.' OR b.bed_strand = h.hit_strand) GROUP BY hit")
def bed_hits_stranded(spark, d):
    j = I.overlap_join(relation(spark, d, "hits"), relation(spark, d, "bed"), ["genome"])
    return j.filter("r_bed_strand = '.' or r_bed_strand = hit_strand").groupBy("hit").agg(F.count("*").alias("hits"))


@query("joi06_keep_regions_semi", f'WITH {BED}, {HITS} SELECT hit FROM hits h WHERE EXISTS (SELECT 1 FROM bed b WHERE h.genome = b.genome AND h.start < b."end" AND h."end" > b.start)')
def keep_regions(spark, d):
    return I.overlap_join(relation(spark, d, "hits"), relation(spark, d, "bed"), ["genome"], "left_semi").select("hit")


@query("joi06_keep_regions_anti", f'WITH {BED}, {HITS} SELECT hit FROM hits h WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE h.genome = b.genome AND h.start < b."end" AND h."end" > b.start)')
def drop_regions(spark, d):
    return I.overlap_join(relation(spark, d, "hits"), relation(spark, d, "bed"), ["genome"], "left_anti").select("hit")


@query("joi08_candidates_in_samples", f'WITH {BED}, {HITS} SELECT region, hit FROM bed b JOIN hits h ON h.genome = b.genome AND h.start >= b.start AND h.start < b."end"')
def candidates(spark, d):
    points = relation(spark, d, "hits").withColumn("end", F.col("start") + 1)
    return I.overlap_join(relation(spark, d, "bed"), points, ["genome"]).select("region", F.col("r_hit").alias("hit"))


@query("flt12_regions_disjoint", f'WITH {BED}, s AS (SELECT genome, start, "end", max("end") OVER (PARTITION BY genome ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bed) SELECT genome, CAST(sum(CASE WHEN before > start THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM s GROUP BY genome')
def disjoint(spark, d):
    w = Window.partitionBy("genome").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return relation(spark, d, "bed").withColumn("before", F.max("end").over(w)).groupBy("genome").agg(F.sum(F.when(F.col("before") > F.col("start"), 1).otherwise(0)).cast("long").alias("overlapping"))


@query("flt06_depth_islands", f"WITH {BED}, p AS (SELECT genome, unnest(generate_series(start, \"end\" - 1)) AS pos FROM bed), c AS (SELECT genome, pos, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT genome, pos, pos - row_number() OVER (PARTITION BY genome ORDER BY pos) AS k FROM c) SELECT genome, min(pos) AS start, max(pos) + 1 AS \"end\" FROM g GROUP BY genome, k")
def depth_islands(spark, d):
    p = relation(spark, d, "bed").select("genome", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return I.depth_islands(p.groupBy("genome", "pos").agg(F.count("*").alias("n")), ["genome"], "pos", "n", 2)


@query("agg12_depth", f'WITH {BED}, e AS (SELECT genome, start AS pos, 1 AS d FROM bed UNION ALL SELECT genome, "end", -1 FROM bed), s AS (SELECT genome, pos, sum(d) AS d FROM e GROUP BY ALL) SELECT genome, pos, CAST(sum(d) OVER (PARTITION BY genome ORDER BY pos) AS BIGINT) AS depth FROM s')
def depth(spark, d):
    b = relation(spark, d, "bed")
    e = b.select("genome", F.col("start").alias("pos"), F.lit(1).alias("d")).union(b.select("genome", "end", F.lit(-1)))
    return e.groupBy("genome", "pos").agg(F.sum("d").alias("d")).select("genome", "pos", F.sum("d").over(Window.partitionBy("genome").orderBy("pos")).cast("long").alias("depth"))


@query("win03_genome_windows", """WITH s AS (SELECT p_partkey AS seq_id, CAST(p_size * 100 AS BIGINT) AS n FROM part), t AS (SELECT *, greatest(CAST(ceil((n - 100) / 900.0) AS BIGINT), 1) AS tiles FROM s), w AS (SELECT seq_id, n, tiles, unnest(generate_series(0, tiles - 1)) AS i FROM t)
SELECT seq_id, i * 900 AS start, least(i * 900 + 1000, n) AS "end", CASE WHEN i = 0 THEN 0 ELSE i * 900 + 50 END AS start_no_overlap, CASE WHEN i = tiles - 1 THEN n ELSE i * 900 + 950 END AS end_no_overlap FROM w""")
def windows(spark, d):
    s = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("seq_id"), (F.col("p_size") * 100).cast("long").alias("n"))
    return I.genome_windows(s, "seq_id", "n", 1000, 100)


@query("win04_chunk_offsets", "SELECT doc_id, CASE WHEN n_chars <= 1000 THEN [0] ELSE list_append(list_filter(generate_series(0, n_chars, 900), lambda x: x + 1000 < n_chars), CAST(ceil((n_chars - 1000) / 6.0) * 6 AS BIGINT)) END AS starts FROM documents")
def chunk_offsets(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", I.chunk_starts(F.col("n_chars"), 1000, 100, 6).alias("starts"))


@query("win05_even_chunks", "WITH c AS (SELECT doc_id, n_chars AS n, greatest(CAST(ceil((n_chars - 100) / 900.0) AS BIGINT), 1) AS k FROM documents), s AS (SELECT *, CASE WHEN k = 1 THEN n ELSE least(CAST(ceil((n + (k - 1) * 100) / CAST(k AS DOUBLE) / 6) * 6 AS BIGINT), 1000) END AS size FROM c), i AS (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM s) SELECT doc_id, i * (size - 100) AS start, least(size, n - i * (size - 100)) AS size FROM i")
def even_chunks(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(I.even_chunks(F.col("n_chars"), 1000, 100, 6)).alias("c")).select("doc_id", "c.*")


@query("win06_stepped_chunks", "WITH c AS (SELECT doc_id, n_chars AS n, unnest(generate_series(0, greatest(CAST(ceil(n_chars / 1000.0) AS BIGINT), 1) - 1)) AS i FROM documents) SELECT doc_id, i * 1000 AS start, least(1000, n - i * 1000) AS size FROM c")
def stepped(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(I.stepped_chunks(F.col("n_chars"), 1000)).alias("c")).select("doc_id", "c.*")


@query("win07_split_samples", "WITH c AS (SELECT doc_id, n_chars AS n, unnest(CASE WHEN n_chars <= 500 THEN [0] ELSE list_append(list_filter(generate_series(0, n_chars, 450), lambda x: x + 500 < n_chars), n_chars - 500) END) AS start FROM documents) SELECT doc_id, start, least(start + 500, n) AS \"end\" FROM c")
def split_samples(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", F.explode(I.chunk_starts(F.col("n_chars"), 500, 50)).alias("start"))
    return t.select("doc_id", "start", F.least(F.col("start") + 500, "n_chars").alias("end"))


@query("win09_cut_overlaps", f"""WITH {BED}, s AS (SELECT genome, region, start, "end", max("end") OVER (PARTITION BY genome ORDER BY start, "end" DESC, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM (SELECT genome, max(region) AS region, start, "end" + start % 4 AS "end" FROM bed GROUP BY genome, start, "end")),
k AS (SELECT * FROM s WHERE c IS NULL OR "end" > c), n AS (SELECT *, lag("end") OVER w AS b, lead(start) OVER w AS a FROM k WINDOW w AS (PARTITION BY genome ORDER BY start, "end" DESC))
SELECT genome, region, CASE WHEN b > start THEN CAST(floor((b + start) / 2) AS BIGINT) ELSE start END AS trim_start, CASE WHEN a < "end" THEN CAST(floor((a + "end") / 2) AS BIGINT) ELSE "end" END AS trim_end FROM n""")
def cut(spark, d):
    s = relation(spark, d, "bed").groupBy("genome", "start", "end").agg(F.max("region").alias("region")).withColumn("end", F.col("end") + F.col("start") % 4)
    return I.cut_overlaps(s.groupBy("genome", "start", "end").agg(F.max("region").alias("region")), ["genome"]).select("genome", "region", "trim_start", "trim_end")


@query("win12_rle_runs", "WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events) SELECT user_id, event_type, min(i) - 1 AS run_start, max(i) AS run_end FROM m GROUP BY user_id, event_type, i - j")
def rle(spark, d):
    return I.runs(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], ["ts", "event_id"], "event_type")


@query("win13_relabel_minor", "SELECT l_partkey AS major, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 + min(l_linenumber) OVER (PARTITION BY l_partkey) AS BIGINT) AS minor FROM lineitem WHERE l_quantity > 10")
def relabel(spark, d):
    w = Window.partitionBy("l_partkey")
    t = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity > 10")
    return t.select(F.col("l_partkey").alias("major"), "l_orderkey", "l_linenumber", (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber")) - 1 + F.min("l_linenumber").over(w)).cast("long").alias("minor"))


@query("agg02_column_groups", f"WITH {RECORDS}, {READS} SELECT (SELECT bool_or(rname <> '*') FROM records) AS aligned, (SELECT bool_or(barcode <> 'unclassified') FROM reads) AS barcoded, (SELECT bool_or(end_reason LIKE '%poly%') FROM reads) AS polya")
def groups(spark, d):
    a = relation(spark, d, "records").agg(F.bool_or(F.col("rname") != "*").alias("aligned"))
    b = relation(spark, d, "reads").agg(F.bool_or(F.col("barcode") != "unclassified").alias("barcoded"), F.bool_or(F.col("end_reason").contains("poly")).alias("polya"))
    return a.join(b)


@query("agg03_writer_counters", f"WITH {RECORDS} SELECT count(*) AS total, CAST(sum(CASE WHEN flag & 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS unmapped, CAST(sum(CASE WHEN flag & 256 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS secondary, CAST(sum(CASE WHEN flag & 2048 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS supplementary, CAST(sum(CASE WHEN flag & 2308 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS \"primary\" FROM records")
def counters(spark, d):
    c = lambda bits: F.count_if(R.has_flag(F.col("flag"), bits))
    return relation(spark, d, "records").agg(F.count("*").alias("total"), c(4).alias("unmapped"), c(256).alias("secondary"), c(2048).alias("supplementary"), F.count_if(~R.has_flag(F.col("flag"), 2308)).alias("primary"))


@query("agg04_barcode_histogram", f"WITH {READS}, t AS (SELECT count(*) AS all_n, sum(CASE WHEN barcode = 'unclassified' THEN 1 ELSE 0 END) AS u FROM reads) SELECT barcode, count(*) AS reads, round(1 - max(u) / CAST(max(all_n) AS DOUBLE), 6) AS classified FROM reads, t GROUP BY barcode")
def barcodes(spark, d):
    h = relation(spark, d, "reads").groupBy("barcode").agg(F.count("*").alias("reads"))
    w = Window.partitionBy()
    return h.withColumn("classified", F.round(1 - F.sum(F.when(F.col("barcode") == "unclassified", F.col("reads")).otherwise(0)).over(w) / F.sum("reads").over(w), 6))


@query("agg05_polya_stats", f"WITH {READS}, p AS (SELECT run_id, CAST(n % 97 AS INTEGER) - 20 AS tail FROM reads), m AS (SELECT run_id, tail, count(*) AS c FROM p WHERE tail >= 0 GROUP BY ALL), md AS (SELECT run_id, tail AS mode FROM m QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY c DESC, tail) = 1) SELECT p.run_id, CAST(sum(CASE WHEN tail >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS called, CAST(sum(CASE WHEN tail < 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_called, CAST(floor(sum(CASE WHEN tail >= 0 THEN tail ELSE 0 END) / CAST(sum(CASE WHEN tail >= 0 THEN 1 ELSE 0 END) AS DOUBLE)) AS BIGINT) AS mean_tail, max(md.mode) AS mode_tail FROM p JOIN md ON p.run_id = md.run_id GROUP BY p.run_id")
def polya(spark, d):
    p = relation(spark, d, "reads").select("run_id", ((F.col("n") % 97).cast("int") - 20).alias("tail"))
    ok = F.when(F.col("tail") >= 0, F.col("tail"))
    return p.groupBy("run_id").agg(F.count(ok).alias("called"), F.count_if(F.col("tail") < 0).alias("not_called"), F.floor(F.sum(ok) / F.count(ok)).cast("long").alias("mean_tail"), F.mode(ok, True).alias("mode_tail"))


@query("agg06_throughput", f"WITH {READS} SELECT run_id, CAST(sum(num_samples) AS BIGINT) AS samples, CAST(sum(seq_len) AS BIGINT) AS bases, round(sum(num_samples) * 1000.0 / (max(start_time_ms) - min(start_time_ms)), 6) AS samples_per_s, round(2.0 * sum(CASE WHEN n % 11 = 0 THEN seq_len ELSE 0 END) / sum(seq_len) * 100, 6) AS duplex_rate FROM reads GROUP BY run_id")
def throughput(spark, d):
    span = F.max("start_time_ms") - F.min("start_time_ms")
    return relation(spark, d, "reads").groupBy("run_id").agg(F.sum("num_samples").cast("long").alias("samples"), F.sum("seq_len").cast("long").alias("bases"), F.round(F.sum("num_samples") * 1000.0 / span, 6).alias("samples_per_s"), F.round(2.0 * F.sum(F.when(F.col("n") % 11 == 0, F.col("seq_len")).otherwise(0)) / F.sum("seq_len") * 100, 6).alias("duplex_rate"))


@query("agg07_filtered_counters", f"WITH {READS} SELECT CAST(sum(CASE WHEN seq_len < 20 THEN 1 ELSE 0 END) AS BIGINT) AS reads, CAST(sum(CASE WHEN seq_len < 20 THEN seq_len ELSE 0 END) AS BIGINT) AS bases FROM reads")
def filtered(spark, d):
    short = F.col("seq_len") < 20
    return relation(spark, d, "reads").agg(F.count_if(short).alias("reads"), F.sum(F.when(short, F.col("seq_len")).otherwise(0)).cast("long").alias("bases"))


@query("agg15_quantiles", "SELECT event_type, round(quantile_cont(value, 0.2), 6) AS q20, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def quantiles(spark, d):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(q(0.2).alias("q20"), q(0.5).alias("q50"), q(0.9).alias("q90"))


@query("agg18_linear_regression", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY l_suppkey")
def regression(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"))


@query("agg22_supported_positions", "WITH c AS (SELECT l_partkey AS pos, l_returnflag AS base, count(*) AS n FROM lineitem GROUP BY ALL) SELECT pos FROM c WHERE n >= 3 GROUP BY pos HAVING count(*) >= 2")
def supported(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("pos"), "l_returnflag").agg(F.count("*").alias("n"))
    return c.filter("n >= 3").groupBy("pos").agg(F.count("*").alias("k")).filter("k >= 2").select("pos")


@query("agg24_window_concatenation", "WITH w AS (SELECT l_orderkey AS name, l_linenumber AS i, CASE WHEN max(l_quantity) < 10 THEN '' ELSE strftime(max(l_shipdate), '%d') END AS part FROM lineitem GROUP BY l_orderkey, l_linenumber), k AS (SELECT *, sum(CASE WHEN part = '' THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY i) AS g FROM w), p AS (SELECT name, g, string_agg(part, '' ORDER BY i) AS seq, row_number() OVER (PARTITION BY name ORDER BY g) - 1 AS n, count(*) OVER (PARTITION BY name) AS parts FROM k WHERE part <> '' GROUP BY name, g) SELECT CASE WHEN parts = 1 THEN CAST(name AS VARCHAR) ELSE name || ':' || n END AS name, seq FROM p")
def concatenation(spark, d):
    from readloom.operators.consensus import join_windows

    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate"))
    w = t.select(F.col("l_orderkey").cast("string").alias("name"), F.col("l_linenumber").alias("i"), F.when(F.col("l_quantity") < 10, "").otherwise(F.date_format("l_shipdate", "dd")).alias("part"))
    return join_windows(w)


@query("agg26_consensus_stitch", "WITH p AS (SELECT l_orderkey AS name, l_linenumber * 10 AS s, l_linenumber * 10 + 6 + l_partkey % 5 AS e, l_returnflag AS q FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)), n AS (SELECT *, lag(e) OVER (PARTITION BY name ORDER BY s) AS b FROM p) SELECT CAST(name AS VARCHAR) AS name, string_agg(CASE WHEN b IS NULL OR b >= s THEN '' ELSE repeat('N', CAST(s - b AS INTEGER)) END || repeat(q, CAST(e - greatest(s, coalesce(b, s)) AS INTEGER)), '' ORDER BY s) AS seq FROM n GROUP BY name")
def stitch(spark, d):
    from readloom.operators.consensus import stitch_consensus

    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("l_returnflag"))
    n = (F.lit(6) + F.col("l_partkey") % 5).cast("int")
    s = (F.col("l_linenumber") * 10).cast("long")
    return stitch_consensus(t.select(F.col("l_orderkey").cast("string").alias("name"), s.alias("start"), (s + n).alias("end"), F.repeat("l_returnflag", n).alias("seq")), fill="N").select("name", "seq")


@query("agg27_merge_adjacent", f"WITH {BED} SELECT genome, min(start) AS start, max(\"end\") AS \"end\" FROM (SELECT *, sum(new) OVER (PARTITION BY genome ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN start > max(\"end\") OVER (PARTITION BY genome ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT genome, start, start + 3 AS \"end\" FROM bed))) GROUP BY genome, k")
def adjacent(spark, d):
    return I.merge_adjacent(relation(spark, d, "bed").withColumn("end", F.col("start") + 3), ["genome"], "start", "end")


@query("agg29_batch_size", "WITH m AS (SELECT l_suppkey, l_linenumber AS batch, avg(l_quantity) AS speed, avg(l_tax) AS mem FROM lineitem GROUP BY ALL), f AS (SELECT *, max(speed) OVER (PARTITION BY l_suppkey) AS best FROM m WHERE mem <= 0.05) SELECT l_suppkey, min(batch) AS batch FROM f WHERE speed >= best / 1.1 GROUP BY l_suppkey")
def batch_size(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey", F.col("l_linenumber").alias("batch")).agg(F.avg("l_quantity").alias("speed"), F.avg("l_tax").alias("mem")).filter("mem <= 0.05")
    best = m.withColumn("best", F.max("speed").over(Window.partitionBy("l_suppkey")))
    return best.filter("speed >= best / 1.1").groupBy("l_suppkey").agg(F.min("batch").alias("batch"))


@query("top01_topk_overlaps", f"WITH {RECORDS} SELECT rname, rec, CAST(rk AS INTEGER) AS rank FROM (SELECT rname, rec, row_number() OVER (PARTITION BY rname ORDER BY mapq DESC, qname, rec) AS rk FROM records) WHERE rk <= 30")
def topk(spark, d):
    w = Window.partitionBy("rname").orderBy(F.desc("mapq"), "qname", "rec")
    return relation(spark, d, "records").withColumn("rank", F.row_number().over(w)).filter("rank <= 30").select("rname", "rec", "rank")


@query("top02_best_and_second_barcode", "WITH b AS (SELECT item_id, substring(md5(text), 1, 24) AS code FROM benchmark), s AS (SELECT doc_id, item_id, levenshtein(substring(md5(text), 1, 24), code) AS penalty FROM documents, b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY penalty, item_id) AS rk FROM s) SELECT doc_id, max(CASE WHEN rk = 1 THEN item_id END) AS best, max(CASE WHEN rk = 1 THEN penalty END) AS penalty, max(CASE WHEN rk = 2 THEN penalty END) - max(CASE WHEN rk = 1 THEN penalty END) AS separation FROM r WHERE rk <= 2 GROUP BY doc_id")
def best_barcode(spark, d):
    # A kit is a dimension of at most some dozen codes, held as one array.
    kit = spark.read.parquet(f"{d}/benchmark.parquet").agg(F.array_sort(F.collect_list(F.struct("item_id", F.substring(F.md5("text"), 1, 24).alias("code")))).alias("kit"))
    head = F.substring(F.md5("text"), 1, 24)
    t = spark.read.parquet(f"{d}/documents.parquet").join(F.broadcast(kit), F.lit(True))
    scored = t.select("doc_id", F.array_sort(F.transform("kit", lambda b: F.struct(F.levenshtein(head, b["code"]).alias("p"), b["item_id"].alias("i")))).alias("s"))
    return scored.select("doc_id", F.col("s")[0]["i"].alias("best"), F.col("s")[0]["p"].cast("long").alias("penalty"), (F.col("s")[1]["p"] - F.col("s")[0]["p"]).cast("long").alias("separation"))


@query("top04_best_primary_block", f"WITH {RECORDS} SELECT qname, arg_max(rec, CAST(mapq AS BIGINT) * 100000000 - rec) AS best FROM records GROUP BY qname")
def best_block(spark, d):
    return relation(spark, d, "records").groupBy("qname").agg(F.max_by("rec", F.struct("mapq", -F.col("rec"))).alias("best"))


@query("top05_longest_interval", f'WITH {BED} SELECT genome, region FROM (SELECT genome, region, row_number() OVER (PARTITION BY genome ORDER BY "end" - start DESC, abs(start - 5000) DESC, region) AS rk FROM bed) WHERE rk = 1')
def longest(spark, d):
    w = Window.partitionBy("genome").orderBy(F.desc(F.col("end") - F.col("start")), F.desc(F.abs(F.col("start") - 5000)), "region")
    return relation(spark, d, "bed").withColumn("r", F.row_number().over(w)).filter("r = 1").select("genome", "region")


@query("lim01_global_limit", "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 100)")
def limit(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").limit(100).agg(F.count("*").alias("n"))


@query("set01_union_inputs", "SELECT event_type AS k, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY event_type")
def union(spark, d):
    a = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("k"))
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@query("set02_intersect_except", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only' AS kind, count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def intersect(spark, d):
    c, s = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey"), spark.read.parquet(f"{d}/supplier.parquet").select("s_nationkey")
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(c.intersect(s), "both").union(n(c.exceptAll(s), "only"))


@query("set03_dedupe", f'WITH {BED} SELECT DISTINCT genome, start - start % 100 AS start FROM bed')
def dedupe(spark, d):
    return relation(spark, d, "bed").select("genome", (F.col("start") - F.col("start") % 100).alias("start")).dropDuplicates()


@query("agg30_cube_rollup_extra", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("stm_tumbling_windows_extra", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    g = spark.read.parquet(f"{d}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("stm_session_windows_extra", "WITH e AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    g = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
