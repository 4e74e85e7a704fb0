"""Queries on alignments, overlaps, single-cell tags and run files."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.functions import texts as T
from readloom.operators import alignments as A
from readloom.operators import single_cell, statistics
from readloom.operators import reads as R
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

READS, RECORDS = cte("reads"), cte("records")


def _sum(kinds: str) -> str:
    return f"CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[{kinds}]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT)"


COUNTS = f"s AS (SELECT *, {_sum('M=X')} AS m, {_sum('I')} AS i, {_sum('D')} AS d FROM records)"


@query("flt05_pileup_read_filter", f"WITH {RECORDS}, {COUNTS} SELECT rec FROM s WHERE flag & 3844 = 0 AND mapq >= 10 AND 1 - (nm - i - d) / CAST(m AS DOUBLE) >= 0.965 AND (hp IS NULL OR (hp = 1 AND rg_id = 'rg3'))")
def pileup_filter(spark, d):
    rec = relation(spark, d, "records").withColumn("snp_accuracy", cigar.accuracy(F.col("cigar"), F.col("nm"))["snp"])
    return R.pileup_filter(rec, 10, 0.965, "hp", 1, True, "rg3").select("rec")


@query("prj03_alignment_metrics", f"WITH {RECORDS}, {COUNTS} SELECT rec, pos + 1 AS genome_start, pos + m + d + 1 AS genome_end, m AS aligned, m - (nm - i - d) AS correct, round((m - (nm - i - d)) / CAST(m AS DOUBLE), 6) AS identity, round((m - (nm - i - d)) / CAST(m + i + d AS DOUBLE), 6) AS accuracy, round(m / CAST(least(len_q, 90) AS DOUBLE), 6) AS coverage FROM s")
def metrics(spark, d):
    r = relation(spark, d, "records")
    end = F.col("pos") + cigar.total(cigar.parse(F.col("cigar")), cigar.REFERENCE) + 1
    m = r.select("rec", (F.col("pos") + 1).alias("genome_start"), end.alias("genome_end"), A.metrics(F.col("cigar"), F.col("nm"), F.col("len_q"), F.lit(90).cast("long")).alias("m"))
    return m.select("rec", "genome_start", "genome_end", "m.aligned", "m.correct", *[F.round(f"m.{c}", 6).alias(c) for c in ("identity", "accuracy", "coverage")])


@query("prj15_strip_alignment", f"WITH {RECORDS}, t AS (SELECT rec, flag, translate(substring(md5(CAST(rec AS VARCHAR)), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM records) SELECT rec, 4 AS flag, '*' AS rname, -1 AS pos, 0 AS mapq, '*' AS cigar, CASE WHEN flag & 16 <> 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq, 'RG,xx' AS tags FROM t")
def strip_alignment(spark, d):
    tags = F.create_map(*[x for k in ("NM", "RG", "SA", "tp", "xx", "bh") for x in (F.lit(k), F.col("rg_id"))])
    seq = F.translate(F.substring(F.md5(F.col("rec").cast("string")), 1, 12), "0123456789abcdef", "ACGTACGTACGTACGT")
    out = A.strip_alignment(relation(spark, d, "records").withColumns({"seq": seq, "tags": tags}))
    return out.select("rec", "flag", "rname", F.col("pos").cast("int").alias("pos"), "mapq", "cigar", "seq", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tags"))


@query("agg23_max_insertion", f"""WITH {RECORDS}, o AS (SELECT uid, rname, pos, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS op, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) AS k FROM (SELECT *, row_number() OVER () AS uid FROM records)),
c AS (SELECT uid, rname, pos, k, right(op, 1) AS op, CAST(left(op, length(op) - 1) AS BIGINT) AS n FROM o),
p AS (SELECT *, sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY uid ORDER BY k) AS r FROM c)
SELECT rname, CAST(pos + r - 1 AS BIGINT) AS major, CAST(max(n) AS INTEGER) AS max_ins FROM p WHERE op = 'I' GROUP BY ALL""")
def max_insertion(spark, d):
    return A.max_insertions(relation(spark, d, "records"))


_OVERLAPS = "o AS (SELECT 'r' || (l_partkey % 97) AS qname, 'r' || (l_suppkey % 89) AS tname, l_orderkey * 8 + l_linenumber AS line, 100 AS qlen, CAST(l_linenumber * 5 AS INTEGER) AS qstart, CAST(l_linenumber * 5 + floor(l_quantity) AS INTEGER) AS qend, 90 AS tlen, CAST(l_linenumber * 3 AS INTEGER) AS tstart, CAST(l_linenumber * 3 + 2 * floor(l_quantity) AS INTEGER) AS tend FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY qname, tname ORDER BY line, qlen, qstart, qend, tlen, tstart, tend) AS k FROM o WHERE qname <> tname)"


def _overlaps(spark, d):
    whole = F.floor("l_quantity")
    to = lambda c: c.cast("int")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("r"), F.col("l_partkey") % 97).alias("qname"), F.concat(F.lit("r"), F.col("l_suppkey") % 89).alias("tname"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"),
        F.lit(100).alias("qlen"), to(F.col("l_linenumber") * 5).alias("qstart"), to(F.col("l_linenumber") * 5 + whole).alias("qend"),
        F.lit(90).alias("tlen"), to(F.col("l_linenumber") * 3).alias("tstart"), to(F.col("l_linenumber") * 3 + 2 * whole).alias("tend"),
    )


@query("flt09_first_pair", f"WITH {_OVERLAPS} SELECT qname, tname, line, qstart, qend, tstart, tend FROM f WHERE k = 1")
def first_pair(spark, d):
    return A.first_overlaps(_overlaps(spark, d), ["line"]).select("qname", "tname", "line", "qstart", "qend", "tstart", "tend")


@query("joi15_overlap_piles", f"WITH {_OVERLAPS} SELECT tname, count(*) AS overlaps, CAST(sum(tend - tstart) AS BIGINT) AS bases, min(qname) AS first_query FROM f WHERE k = 1 AND qlen >= qstart AND qlen >= qend AND tlen >= tstart AND tlen >= tend GROUP BY tname")
def piles(spark, d):
    p = A.overlap_piles(_overlaps(spark, d), ["line"])
    return p.groupBy("tname").agg(F.count("*").alias("overlaps"), F.sum(F.col("tend") - F.col("tstart")).alias("bases"), F.min("qname").alias("first_query"))


@query("prj24_gapped_draft", "SELECT o_orderkey, array_to_string(list_transform(generate_series(0, CAST(5 + o_orderkey % 20 AS BIGINT)), lambda x: CASE WHEN x % 3 = 0 THEN substring(md5(CAST(o_orderkey AS VARCHAR)), CAST(x // 3 + 1 AS INTEGER), 1) ELSE '*' END), '') AS draft FROM orders")
def draft(spark, d):
    places = F.sequence(F.lit(0).cast("long"), (5 + F.col("o_orderkey") % 20).cast("long"))
    majors, minors = F.transform(places, lambda x: F.floor(x / 3)), F.transform(places, lambda x: x % 3)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", A.gapped_draft(F.md5(F.col("o_orderkey").cast("string")), majors, minors).alias("draft"))


@query("win08_candidate_samples")
def candidate_samples(spark, d):
    """Tiles of 1,000 positions, every seventh with an insertion column."""
    h = relation(spark, d, "hits").select(F.col("genome").alias("seq_id"), F.col("start").alias("pos"))
    tile = F.floor(F.col("pos") / 1000)
    tiles = h.select("seq_id", tile.alias("t")).distinct()
    places = F.sequence(F.col("t") * 1000, F.col("t") * 1000 + 999)
    majors = F.flatten(F.transform(places, lambda p: F.array_repeat(p, F.when(p % 7 == 0, 2).otherwise(1))))
    samples = tiles.select("seq_id", F.concat_ws(":", "seq_id", "t").alias("sample"), (F.col("t") * 1000).alias("start"), (F.col("t") * 1000 + 1000).alias("end"), majors.alias("majors"))
    return A.samples_around(samples, h, 100, 30)


@query("str07_join", "SELECT n_nationkey, ltrim(concat_ws('|', CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'x' END), '|') AS joined FROM nation")
def join(spark, d):
    some = lambda k, c: F.when(F.col("n_nationkey") % k == 0, "").otherwise(c)
    items = F.array(some(3, F.col("n_name")), some(2, F.col("n_regionkey").cast("string")), some(4, F.lit("x")))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", T.join_items(items, "|").alias("joined"))


@query("str25_alignment_text", "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, md5(CAST(l_orderkey AS VARCHAR)) AS q, md5(CAST(l_partkey AS VARCHAR)) AS t, CAST(l_linenumber % 3 AS INTEGER) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, substring(q, 1, 11 + 2 * k) || repeat('-', 1 + k) || substring(q, 12 + 2 * k, 3) || chr(10) || '|||||' || repeat('*', 1 + k) || repeat(' ', 1 + k) || '||||' || repeat(' ', 1 + k) || '|||' || chr(10) || substring(t, 3, 6 + k) || repeat('-', 1 + k) || substring(t, 9 + k, 8 + k) AS lines FROM t")
def alignment_lines(spark, d):
    n = (F.col("l_linenumber") % 3 + 1).cast("string")
    ops = F.concat(F.lit("5="), n, F.lit("X"), n, F.lit("I4="), n, F.lit("D3="))
    text = T.alignment_text(F.md5(F.col("l_orderkey").cast("string")), F.md5(F.col("l_partkey").cast("string")), ops, F.lit(2))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("lines"))


@query("snk05_single_file_name", f"WITH {READS} SELECT read_id, 'calls_' || strftime(make_timestamp(start_time_ms * 1000), '%Y-%m-%d_T%H-%M-%S') || '.bam' AS name FROM reads")
def single_file(spark, d):
    return relation(spark, d, "reads").select("read_id", T.single_file_name(F.col("start_time_ms")).alias("name"))


@query("snk19_stats_lines", "WITH r AS (SELECT event_id % 50 * 100 AS t, event_type || '_' || (user_id % 3) AS name, count(*) AS v FROM events GROUP BY ALL), n AS (SELECT DISTINCT name FROM r WHERE regexp_full_match(name, '[a-p].*_[01]')), e AS (SELECT DISTINCT t FROM r) SELECT e.t AS elapsed_ms, CAST(e.t AS VARCHAR) || string_agg(',' || coalesce(CAST(r.v AS VARCHAR), ''), '' ORDER BY n.name) AS line FROM e CROSS JOIN n LEFT JOIN r ON r.t = e.t AND r.name = n.name GROUP BY e.t UNION ALL SELECT NULL, 'elapsed_ms' || string_agg(',' || name, '' ORDER BY name) FROM n")
def stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("event_id") % 50 * 100).alias("elapsed_ms"), F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")).alias("name")).agg(F.count("*").alias("value"))
    return statistics.stats_lines(e, "[a-p].*_[01]")


@query("krn04_single_cell_tags")
def tags(spark, d):
    """Reads with a switch or a poly-T behind their first bases, on either strand."""
    n = F.col("n")
    tail = F.when(n % 3 == 0, F.lit(single_cell.TSO)).when(n % 3 == 1, F.lit(single_cell.POLY_T)).otherwise(F.lit(""))
    forward = F.concat(F.col("seq"), tail, F.lit("ACGGACTACCA"))
    way = F.when(n % 2 == 0, "+").otherwise("-")
    seq = F.when(n % 2 == 0, forward).otherwise(F.translate(F.reverse(forward), "ACGT", "TGCA"))
    r = relation(spark, d, "reads").filter("seq_len > 8").select("read_id", seq.alias("seq"), way.alias("orientation"))
    begin, end = F.when(F.col("orientation") == "+", 5).otherwise(0), F.when(F.col("orientation") == "+", F.length("seq")).otherwise(F.length("seq") - 5)
    return single_cell.single_cell_tags(r.withColumns({"trim_begin": begin, "trim_end": end}))
