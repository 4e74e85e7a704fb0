"""Queries on reads and records: sources, filters, projections, joins, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import cigar, numeric, seq
from readloom.operators import reads as R
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

MEAN_Q_SQL = "CASE WHEN length(qstring) = 0 THEN 0.0 ELSE greatest(1.0, least(50.0, -10 * log10(list_sum(list_transform(string_split(qstring, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) / length(qstring)))) END"
READS, RECORDS, GROUPS, SHEET = cte("reads"), cte("records"), cte("groups"), cte("sheet")


@query(
    "summary_flagship",
    f"""WITH {READS}, {GROUPS}, {RECORDS},
counts AS (SELECT rg_id, count(*) AS num_alignments, CAST(sum(CASE WHEN flag & 256 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_secondary, CAST(sum(CASE WHEN flag & 2048 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_supplementary FROM records GROUP BY rg_id),
q AS (SELECT *, {MEAN_Q_SQL} AS mean_q FROM reads)
SELECT read_id, channel, mux, rg_flowcell, rg_model, round(start_time_ms / 1000.0 + num_trimmed_samples / (num_samples / (num_samples / 4000.0)), 6) AS template_start,
 round((num_samples - num_trimmed_samples) / 4000.0, 6) AS template_duration, CAST(floor((num_samples - num_trimmed_samples) / 6) AS BIGINT) AS num_events_template,
 seq_len AS sequence_length_template, round(mean_q, 6) AS mean_qscore_template, CASE WHEN mean_q >= 8 THEN 'TRUE' ELSE 'FALSE' END AS passes_filtering,
 coalesce(c.num_alignments, 0) AS num_alignments, coalesce(c.num_secondary, 0) AS num_secondary, coalesce(c.num_supplementary, 0) AS num_supplementary, end_reason
FROM q LEFT JOIN groups g ON q.rg_id = g.rg_id LEFT JOIN counts c ON q.rg_id = c.rg_id""",
)
def summary_flagship(spark, d):
    reads = R.template_times(R.mean_q(relation(spark, d, "reads")))
    counts = R.alignment_counts(relation(spark, d, "records"), "rg_id")
    full = R.with_read_groups(reads, relation(spark, d, "groups")).join(counts, "rg_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select(
        "read_id", "channel", "mux", "rg_flowcell", "rg_model", F.round("template_start", 6).alias("template_start"), F.round("template_duration", 6).alias("template_duration"), "num_events_template",
        F.col("seq_len").alias("sequence_length_template"), F.round("mean_q", 6).alias("mean_qscore_template"), F.when(F.col("mean_q") >= 8, "TRUE").otherwise("FALSE").alias("passes_filtering"),
        n("num_alignments"), n("num_secondary"), n("num_supplementary"), "end_reason",
    )


@query("flt01_read_filter_qscore_len", f"WITH {READS}, q AS (SELECT *, {MEAN_Q_SQL} AS mean_q FROM reads) SELECT read_id, seq_len, round(mean_q, 6) AS mean_q FROM q WHERE NOT (mean_q < 7.5) AND seq_len >= 5 AND n NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def read_filter(spark, d):
    bad = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").selectExpr("md5(cast(doc_id as string)) as read_id")
    return R.filter_reads(R.mean_q(relation(spark, d, "reads")), 7.5, 5, bad).select("read_id", "seq_len", F.round("mean_q", 6).alias("mean_q"))


@query("flt02_pass_fail", f"WITH {READS}, q AS (SELECT *, {MEAN_Q_SQL} AS mean_q FROM reads) SELECT run_id, mean_q >= 8 AS is_pass, count(*) AS reads, CAST(sum(seq_len) AS BIGINT) AS bases FROM q GROUP BY ALL")
def pass_fail(spark, d):
    q = R.mean_q(relation(spark, d, "reads")).withColumn("is_pass", F.col("mean_q") >= 8)
    return q.groupBy("run_id", "is_pass").agg(F.count("*").alias("reads"), F.sum("seq_len").cast("long").alias("bases"))


@query("flt03_min_qscore_from_command", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS INTEGER) END AS min_qscore FROM orders")
def min_qscore(spark, d):
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("tool basecaller hac 'in dir'")).otherwise(F.concat(F.lit("tool basecaller hac --min-qscore \""), (F.col("o_orderkey") % 20).cast("string"), F.lit("\" -r")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", seq.cli_token(line, "--min-qscore").cast("int").alias("min_qscore"))


@query("flt04_skip_sec_supp", f"WITH {RECORDS} SELECT rec, qname, flag FROM records WHERE flag & 2304 = 0")
def skip_sec_supp(spark, d):
    return R.primary_only(relation(spark, d, "records")).select("rec", "qname", "flag")


@query("flt07_barcode_permitted", f"WITH {READS}, {SHEET} SELECT read_id, barcode FROM reads WHERE CASE WHEN barcode = 'unclassified' THEN barcode ELSE 'barcode' || regexp_extract(barcode, '(\\d+)\\D*$', 1) END IN (SELECT 'barcode' || regexp_extract(barcode, '(\\d+)\\D*$', 1) FROM sheet WHERE row % 2 = 0)")
def barcode_permitted(spark, d):
    allowed = relation(spark, d, "sheet").filter("row % 2 = 0").select(seq.normalize_barcode(F.col("barcode")).alias("norm")).distinct()
    r = relation(spark, d, "reads").withColumn("norm", seq.normalize_barcode(F.col("barcode")))
    return r.join(allowed, "norm", "left_semi").select("read_id", "barcode")


@query("flt14_canonical_reference", f"WITH {READS} SELECT read_id FROM reads WHERE regexp_matches(CASE WHEN n % 7 = 0 THEN seq || 'N' ELSE lower(seq) END, '^[ACGTacgt]+$')")
def canonical(spark, d):
    s = F.when(F.col("n") % 7 == 0, F.concat("seq", F.lit("N"))).otherwise(F.lower("seq"))
    return relation(spark, d, "reads").filter(seq.is_canonical(s)).select("read_id")


@query("src01_file_tag", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'lineitem.parquet' ELSE 'given.bam' END AS fn FROM lineitem")
def file_tag(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    given = F.when(F.col("l_linenumber") % 2 == 1, F.lit("given.bam"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(lineitem\.parquet)", 1)
    return t.select("l_orderkey", "l_linenumber", F.coalesce(given, name).alias("fn"))


@query("src02_read_list_semi", f"WITH {RECORDS} SELECT rec, qname FROM records WHERE flag & 2304 = 0 AND qname IN (SELECT md5(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderstatus = 'F')")
def read_list(spark, d):
    wanted = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").selectExpr("md5(cast(o_orderkey as string)) as qname")
    return R.primary_only(relation(spark, d, "records")).join(wanted, "qname", "left_semi").select("rec", "qname")


@query("src05_start_time_projection", f"WITH {READS} SELECT read_id, CAST(floor(num_samples * 1000 / sample_rate) AS BIGINT) AS start_ms, CASE WHEN n % 4 = 0 THEN 'grp' || run_id ELSE run_id END AS experiment_id FROM reads")
def start_time(spark, d):
    given = F.when(F.col("n") % 4 == 0, F.lit("")).otherwise(F.col("run_id"))
    tracking = F.create_map(F.lit("protocol_group_id"), F.concat(F.lit("grp"), "run_id"))
    r = relation(spark, d, "reads")
    return r.select("read_id", F.expr("num_samples * 1000 div sample_rate").alias("start_ms"), F.coalesce(F.nullif(given, F.lit("")), tracking["protocol_group_id"]).alias("experiment_id"))


@query("src06_allow_ignore_lists", f"WITH {READS} SELECT read_id FROM reads WHERE n IN (SELECT doc_id FROM labels WHERE quality = 1) AND n NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def allow_ignore(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumn("read_id", F.md5(F.col("doc_id").cast("string")))
    return R.select_reads(relation(spark, d, "reads"), labels.filter("quality = 1"), labels.filter("toxic = 1")).select("read_id")


@query("src07_prev_next_read", f"WITH {READS} SELECT read_id, channel, lag(read_id) OVER w AS prev_read, lead(read_id) OVER w AS next_read FROM reads WINDOW w AS (PARTITION BY channel ORDER BY mux, read_number, read_id)")
def prev_next(spark, d):
    return R.neighbours(relation(spark, d, "reads")).select("read_id", "channel", "prev_read", "next_read")


@query("src10_length_index", f"WITH {READS} SELECT read_id AS name, CAST(length(seq) AS INTEGER) AS length FROM reads")
def length_index(spark, d):
    return relation(spark, d, "reads").select(F.col("read_id").alias("name"), F.length("seq").alias("length"))


@query("src09_keyed_fetch", f"WITH {READS} SELECT l_orderkey, l_linenumber, seq, qstring FROM lineitem JOIN reads ON read_id = md5(CAST(l_orderkey AS VARCHAR))")
def keyed_fetch(spark, d):
    asked = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.md5(F.col("l_orderkey").cast("string")).alias("read_id"))
    return asked.join(relation(spark, d, "reads"), "read_id").select("l_orderkey", "l_linenumber", "seq", "qstring")


@query("src11_bed_parse", f"WITH {cte('bed')} SELECT genome, start, \"end\", CASE WHEN region % 3 = 0 THEN '.' ELSE bed_strand END AS strand FROM bed")
def bed_parse(spark, d):
    from readloom.sources.text import parse_bed

    b = relation(spark, d, "bed")
    long = F.concat_ws("\t", "genome", "start", "end", F.lit("x"), F.lit("0"), "bed_strand")
    line = F.when(F.col("region") % 3 == 0, F.concat_ws("\t", "genome", "start", "end")).otherwise(long)
    head = spark.createDataFrame([("track name=x",), ("browser position",), ("# note",), ("",)], "value string")
    return parse_bed(b.select(line.alias("value")).union(head)).select("genome", "start", "end", "strand")


@query("src12_paf_parse", f"WITH {RECORDS} SELECT qname, CAST(len_q AS INTEGER) AS qlen, strand, rname AS tname, CAST(len_r AS INTEGER) AS matches, mapq, cigar AS cg FROM records")
def paf_parse(spark, d):
    from readloom.sources.text import parse_paf

    r = relation(spark, d, "records")
    line = F.concat_ws("\t", "qname", "len_q", F.lit(0), "len_q", "strand", "rname", F.lit(100000), "pos", F.col("pos") + F.col("len_r"), "len_r", "len_r", "mapq", F.lit("tp:A:P"), F.concat(F.lit("cg:Z:"), "cigar"), F.lit("xx:i:1"))
    return parse_paf(r.select(line.alias("value"))).select("qname", "qlen", "strand", "tname", "matches", "mapq", "cg")


@query("src13_paf_piles", f"WITH {RECORDS} SELECT rname, count(*) AS overlaps, min(qname) AS first_query, CAST(sum(len_q) AS BIGINT) AS bases FROM records WHERE qname NOT IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels) GROUP BY rname")
def paf_piles(spark, d):
    skip = spark.read.parquet(f"{d}/labels.parquet").select(F.md5(F.col("doc_id").cast("string")).alias("qname"))
    piles = relation(spark, d, "records").join(skip, "qname", "left_anti")
    return piles.groupBy("rname").agg(F.count("*").alias("overlaps"), F.min("qname").alias("first_query"), F.sum("len_q").cast("long").alias("bases"))


@query("src14_sample_sheet_valid", f"WITH {SHEET} SELECT row, regexp_matches(alias, '^[A-Za-z0-9_-]{{1,40}}$') AND NOT regexp_matches(alias, '^barcode[0-9]+$') AND alias <> 'unclassified' AS alias_ok FROM sheet")
def sheet_valid(spark, d):
    from readloom.sources.text import alias_ok

    return relation(spark, d, "sheet").select("row", alias_ok(F.col("alias")).alias("alias_ok"))


@query("src16_pairs_last_wins", f"WITH {READS} SELECT channel AS template_id, arg_max(read_id, n) AS complement_id FROM reads GROUP BY channel")
def pairs_last(spark, d):
    return R.last_pairs(relation(spark, d, "reads").select(F.col("channel").alias("template_id"), F.col("read_id").alias("complement_id"), F.col("n").alias("line")))


@query("src18_read_group_from_tags", f"WITH {READS} SELECT read_id, run_id AS rg_run, 'hac' AS rg_model FROM reads")
def rg_from_tags(spark, d):
    from readloom.sources.text import read_group_of_tags

    tags = F.concat_ws("\t", F.lit("st:Z:2024"), F.concat(F.lit("RG:Z:"), "run_id", F.lit("_hac@v1_"), "barcode"))
    return relation(spark, d, "reads").select("read_id", read_group_of_tags(tags).alias("g")).select("read_id", F.col("g.run_id").alias("rg_run"), F.col("g.model").alias("rg_model"))


@query("src19_region_scan", f"WITH {RECORDS} SELECT rec, pos FROM records WHERE rname = 'chr2' AND pos < 9000 AND pos + len_r > 3000")
def region_scan(spark, d):
    return relation(spark, d, "records").filter("rname = 'chr2' and pos < 9000 and pos + len_r > 3000").select("rec", "pos")


@query("src21_dataset_facts", f"WITH {READS} SELECT count(*) AS reads, count(DISTINCT run_id) AS runs, max(sample_rate) AS sample_rate, count(DISTINCT sample_rate) = 1 AS one_rate FROM reads")
def dataset_facts(spark, d):
    return relation(spark, d, "reads").agg(F.count("*").alias("reads"), F.countDistinct("run_id").alias("runs"), F.max("sample_rate").alias("sample_rate"), (F.countDistinct("sample_rate") == 1).alias("one_rate"))


@query("src23_resume", f"WITH {READS} SELECT read_id FROM reads WHERE n NOT IN (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END FROM labels)")
def resume(spark, d):
    done = spark.read.parquet(f"{d}/labels.parquet").select(F.when(F.col("doc_id") % 2 == 1, F.md5((F.col("doc_id") + 1).cast("string"))).alias("pi"), F.md5(F.col("doc_id").cast("string")).alias("qname"))
    return R.resume(done, relation(spark, d, "reads").select("read_id"))


@query("src24_processed_headers", "SELECT l_orderkey, l_linenumber, 'read' || l_orderkey AS name FROM lineitem")
def processed(spark, d):
    head = F.concat(F.lit("read"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(":0")).otherwise(F.lit(" len=5")))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.regexp_extract(head, "^[^: \\t]+", 0).alias("name"))


@query("prj02_template_times", f"WITH {READS} SELECT read_id, round(start_time_ms / 1000.0 + num_trimmed_samples / (num_samples / (num_samples / 4000.0)), 6) AS template_start, round((num_samples - num_trimmed_samples) / 4000.0, 6) AS template_duration, CAST(floor((num_samples - num_trimmed_samples) / 6) AS BIGINT) AS num_events_template FROM reads")
def times(spark, d):
    return R.template_times(relation(spark, d, "reads")).select("read_id", F.round("template_start", 6).alias("template_start"), F.round("template_duration", 6).alias("template_duration"), "num_events_template")


@query("prj04_duplex_parents", f"WITH {READS} SELECT read_id, n % 3 = 0 AS is_duplex, CASE WHEN n % 3 = 0 THEN read_id END AS template_id, CASE WHEN n % 3 = 0 THEN run_id END AS complement_id FROM reads")
def parents(spark, d):
    name = F.when(F.col("n") % 3 == 0, F.concat_ws(";", "read_id", "run_id")).otherwise(F.col("read_id"))
    p = F.split(name, ";")
    two = F.size(p) == 2
    return relation(spark, d, "reads").select("read_id", two.alias("is_duplex"), F.when(two, F.get(p, F.lit(0))).alias("template_id"), F.when(two, F.get(p, F.lit(1))).alias("complement_id"))


@query("prj05_read_attributes", f"WITH {READS}, {GROUPS} SELECT read_id, rg_flowcell, rg_run, rg_model, string_split(string_split(ds, ' ')[1], '=')[2] AS ds_runid FROM reads r LEFT JOIN groups g ON r.rg_id = g.rg_id")
def attributes(spark, d):
    g = relation(spark, d, "groups").withColumn("ds_runid", seq.description_field(F.col("ds"), "runid"))
    return R.with_read_groups(relation(spark, d, "reads"), g).select("read_id", "rg_flowcell", "rg_run", "rg_model", "ds_runid")


@query("prj07_undemux_read_group", f"WITH {READS} SELECT read_id, run_id || '_hac' AS rg FROM reads")
def undemux(spark, d):
    return relation(spark, d, "reads").select("read_id", seq.undemux_read_group(F.concat_ws("_", "run_id", F.lit("hac"), "barcode"), F.col("barcode")).alias("rg"))


@query("prj08_read_group_id", f"WITH {GROUPS} SELECT rg_id, CASE WHEN rg_model = '' THEN 'unknown' ELSE rg_run || '_' || rg_model || CASE WHEN rg_barcode = 'unclassified' THEN '' ELSE '_' || rg_barcode END END AS made FROM groups")
def rg_id(spark, d):
    return relation(spark, d, "groups").select("rg_id", seq.read_group_id(F.col("rg_run"), F.col("rg_model"), F.col("rg_barcode")).alias("made"))


@query("prj09_trim_apply", f"WITH {READS} SELECT read_id, substring(seq, 3 + 1, greatest(seq_len - 5, 0)) AS seq, substring(qstring, 3 + 1, greatest(seq_len - 5, 0)) AS qstring FROM reads WHERE seq_len > 10")
def trim_apply(spark, d):
    r = relation(spark, d, "reads").filter("seq_len > 10").withColumns({"trim_begin": F.lit(3), "trim_end": F.col("seq_len") - 2})
    return R.apply_trim(r).select("read_id", "seq", "qstring")


@query("prj10_trim_combine", f"WITH {READS}, t AS (SELECT read_id, seq_len, n % 20 AS a, seq_len - n % 7 AS b, n % 31 AS c, seq_len - n % 11 AS e FROM reads), u AS (SELECT *, greatest(a, c) AS lo, least(b, e) AS hi FROM t) SELECT read_id, CAST(CASE WHEN lo >= hi THEN 0 ELSE lo END AS INTEGER) AS trim_begin, CAST(CASE WHEN lo >= hi THEN seq_len ELSE hi END AS INTEGER) AS trim_end FROM u")
def trim_combine(spark, d):
    n = F.col("n")
    t = R.combine_trims(n % 20, F.col("seq_len") - n % 7, n % 31, F.col("seq_len") - n % 11, F.col("seq_len"))
    return relation(spark, d, "reads").select("read_id", t.alias("t")).select("read_id", F.col("t.begin").alias("trim_begin"), F.col("t.end").alias("trim_end"))


@query("prj11_barcode_trim", f"WITH {READS}, t AS (SELECT read_id, seq_len, (n % 10) / 10.0 AS ts, n % 40 AS te, (n % 7) / 7.0 AS bs, seq_len - n % 40 AS be, n % 2 = 0 AS top FROM reads), u AS (SELECT *, CASE WHEN ts > 0.6 THEN te + 1 ELSE 0 END AS lo, CASE WHEN bs > 0.6 THEN be ELSE seq_len END AS hi FROM t) SELECT read_id, CAST(CASE WHEN lo > hi AND NOT top THEN 0 ELSE lo END AS INTEGER) AS trim_begin, CAST(CASE WHEN lo > hi AND top THEN seq_len ELSE hi END AS INTEGER) AS trim_end FROM u")
def barcode_trim(spark, d):
    n = F.col("n")
    t = R.barcode_trim(F.col("seq_len"), (n % 10) / 10.0, n % 40, (n % 7) / 7.0, F.col("seq_len") - n % 40, n % 2 == 0)
    return relation(spark, d, "reads").select("read_id", t.alias("t")).select("read_id", F.col("t.begin").alias("trim_begin"), F.col("t.end").alias("trim_end"))


@query("prj12_adapter_trim", f"WITH {READS} SELECT read_id, CAST(CASE WHEN (n % 10) / 10.0 >= 0.8 THEN n % 5 + 1 ELSE 0 END AS INTEGER) AS trim_begin, CAST(CASE WHEN (n % 9) / 9.0 >= 0.8 THEN seq_len - 1 ELSE seq_len END AS INTEGER) AS trim_end FROM reads")
def adapter_trim(spark, d):
    n = F.col("n")
    t = R.adapter_trim(F.col("seq_len"), (n % 10) / 10.0, n % 5, (n % 9) / 9.0, F.col("seq_len") - 1)
    return relation(spark, d, "reads").select("read_id", t.alias("t")).select("read_id", F.col("t.begin").alias("trim_begin"), F.col("t.end").alias("trim_end"))


@query("prj13_barcode_shift", f"WITH {READS} SELECT read_id, CASE WHEN n % 50 - 5 < 0 THEN n % 50 - 5 ELSE greatest(0, least(n % 50 - 5 - n % 13, seq_len)) END AS pos FROM reads")
def barcode_shift(spark, d):
    n = F.col("n")
    return relation(spark, d, "reads").select("read_id", R.shift_barcode(n % 50 - 5, n % 13, F.col("seq_len").cast("long")).alias("pos"))


@query("prj14_header_tid_remap", f"WITH {RECORDS}, sq AS (SELECT DISTINCT rname AS name, 100000 AS length, CASE WHEN rec % 2 = 0 THEN 'a' ELSE 'b' END AS file FROM records), num AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY name DESC) - 1 AS BIGINT) AS tid FROM sq), firsts AS (SELECT name, min(file || '#' || lpad(CAST(tid AS VARCHAR), 5, '0')) AS at FROM num GROUP BY name) SELECT n.file, n.tid AS old_tid, CAST(dense_rank() OVER (ORDER BY f.at, n.name) - 1 AS BIGINT) AS new_tid FROM num n JOIN firsts f ON n.name = f.name")
def tid_remap(spark, d):
    from pyspark.sql import Window

    sq = relation(spark, d, "records").select(F.col("rname").alias("name"), F.lit(100000).alias("length"), F.when(F.col("rec") % 2 == 0, "a").otherwise("b").alias("file")).distinct()
    num = sq.withColumn("tid", (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("name"))) - 1).cast("long"))
    return num.join(R.merge_headers(num), ["name", "length"]).select("file", F.col("tid").alias("old_tid"), "new_tid")


@query("prj17_sub_reads", f"WITH {READS}, p AS (SELECT read_id, seq, unnest([0, 1]) AS i, seq_len FROM reads WHERE seq_len >= 4) SELECT read_id AS parent_read_id, CAST(i AS INTEGER) AS subread_id, CASE i WHEN 0 THEN substring(seq, 1, seq_len // 2) ELSE substring(seq, seq_len // 2 + 1, seq_len) END AS seq FROM p")
def sub_reads(spark, d):
    half = F.floor(F.col("seq_len") / 2).cast("int")
    r = relation(spark, d, "reads").filter("seq_len >= 4").withColumn("pieces", F.array(F.struct(F.lit(0).alias("begin"), half.alias("end")), F.struct(half.alias("begin"), F.col("seq_len").alias("end"))))
    return R.sub_reads(r).select("parent_read_id", F.col("subread_id").cast("int").alias("subread_id"), "seq")


@query("joi02_read_alignment_counts", f"WITH {READS}, {RECORDS}, c AS (SELECT qname, count(*) AS num_alignments, CAST(sum(CASE WHEN flag & 256 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_secondary, CAST(sum(CASE WHEN flag & 2048 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_supplementary FROM records GROUP BY qname) SELECT read_id, num_alignments, num_secondary, num_supplementary FROM reads LEFT JOIN c ON read_id = qname")
def read_counts(spark, d):
    c = R.alignment_counts(relation(spark, d, "records")).withColumnRenamed("qname", "read_id")
    return relation(spark, d, "reads").select("read_id").join(c, "read_id", "left")


@query("joi03_sample_sheet_alias", f"WITH {READS}, {SHEET}, f AS (SELECT flowcell_id, barcode, arg_min(alias, row) AS alias FROM sheet GROUP BY ALL) SELECT read_id, alias FROM reads r LEFT JOIN f ON r.flowcell_id = f.flowcell_id AND r.barcode = f.barcode")
def sheet_alias(spark, d):
    return R.sample_sheet_row(relation(spark, d, "reads"), relation(spark, d, "sheet"), ["flowcell_id"]).select("read_id", "alias")


@query("joi09_pair_candidates", f"WITH {READS}, q AS (SELECT *, {MEAN_Q_SQL} AS mean_q, start_time_ms + CAST(floor(num_samples * 1000 / sample_rate) AS BIGINT) AS end_ms FROM reads), p AS (SELECT *, lead(read_id) OVER w AS c_id, lead(start_time_ms) OVER w AS c_start, lead(seq_len) OVER w AS c_len, lead(mean_q) OVER w AS c_q FROM q WINDOW w AS (PARTITION BY channel, run_id, flowcell_id ORDER BY start_time_ms, read_id)) SELECT read_id AS template_id, c_id AS complement_id, c_start - end_ms AS gap_ms, (c_start - end_ms <= 100 AND least(seq_len, c_len) / greatest(seq_len, c_len) >= 0.98 AND least(seq_len, c_len) >= 5000) AS early_accept FROM p WHERE c_start - end_ms >= 0 AND c_start - end_ms < 10000000 AND least(seq_len, c_len) >= 10 AND least(mean_q, c_q) >= 5")
def pair_candidates(spark, d):
    return R.pair_candidates(R.mean_q(relation(spark, d, "reads")), 10_000_000, 10, 5)


@query("joi12_explicit_pairs", f"WITH {READS}, p AS (SELECT md5(CAST(l_orderkey AS VARCHAR)) AS template_id, arg_max(md5(CAST(l_partkey AS VARCHAR)), l_linenumber * 10000000 + l_partkey) AS complement_id FROM lineitem GROUP BY l_orderkey) SELECT template_id, complement_id, t.seq_len AS template_len, c.seq_len AS complement_len FROM p JOIN reads t ON t.read_id = template_id JOIN reads c ON c.read_id = complement_id")
def explicit_pairs(spark, d):
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.md5(F.col("l_orderkey").cast("string")).alias("template_id"), F.md5(F.col("l_partkey").cast("string")).alias("complement_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("line"))
    out = R.pairs_from_list(relation(spark, d, "reads").select("read_id", "seq_len"), pairs)
    return out.select("template_id", "complement_id", F.col("template_seq_len").alias("template_len"), F.col("complement_seq_len").alias("complement_len"))


@query("joi13_duplex_parent_tag", f"WITH {READS}, dup AS (SELECT unnest([read_id, md5(CAST(n + 1 AS VARCHAR))]) AS id FROM reads WHERE n % 5 = 0) SELECT read_id, read_id IN (SELECT id FROM dup) AS is_duplex_parent FROM reads")
def parent_tag(spark, d):
    r = relation(spark, d, "reads")
    duplex = r.filter("n % 5 = 0").select(F.concat_ws(";", "read_id", F.md5((F.col("n") + 1).cast("string"))).alias("read_id"))
    return R.tag_duplex_parents(r, duplex).select("read_id", "is_duplex_parent")


@query("joi14_subread_barrier", "WITH s AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey AS read_tag, l_linenumber AS subread_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS subread_number FROM s WHERE n = 2 + l_orderkey % 5")
def barrier(spark, d):
    s = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("read_tag"), F.col("l_linenumber").alias("subread_id"), (2 + F.col("l_orderkey") % 5).alias("split_count"))
    return R.complete_groups(s).select("read_tag", "subread_id", "subread_number")


@query("joi18_header_conflicts", f"WITH {RECORDS} SELECT rname AS name FROM records GROUP BY rname HAVING count(DISTINCT CASE WHEN rname = 'chr1' THEN mapq % 2 ELSE 0 END) > 1")
def conflicts(spark, d):
    sq = relation(spark, d, "records").select(F.col("rname").alias("name"), F.when(F.col("rname") == "chr1", F.col("mapq") % 2).otherwise(0).alias("length"))
    return R.header_conflicts(sq).select("name")


@query("joi19_header_per_barcode", f"WITH {GROUPS}, {SHEET}, k AS (SELECT DISTINCT barcode FROM sheet) SELECT rg_id, k.barcode, rg_id || '_' || k.barcode AS new_rg FROM groups JOIN k ON 1 = 1")
def per_barcode(spark, d):
    kit = relation(spark, d, "sheet").agg(F.collect_set("barcode").alias("kit"))
    # The kit is a dimension of some dozen barcodes: one row, exploded beside each header.
    return relation(spark, d, "groups").join(F.broadcast(kit), F.lit(True)).select("rg_id", F.explode("kit").alias("barcode")).withColumn("new_rg", F.concat_ws("_", "rg_id", "barcode"))


@query("joi20_model_resolution", f"WITH {GROUPS}, m AS (SELECT rg_run, arg_max(rg_model, [CAST(x AS INTEGER) for x in string_split(regexp_replace(string_split(rg_model, '@')[2], '^v', ''), '.')]) AS model FROM groups WHERE rg_model <> '' GROUP BY rg_run) SELECT rg_id, model, string_split(model, '@')[1] AS variant, string_split(model, '@')[2] AS version FROM groups JOIN m USING (rg_run)")
def models(spark, d):
    g = relation(spark, d, "groups")
    parts = seq.model_parts(F.col("rg_model"))
    newest = g.filter("rg_model != ''").withColumn("p", parts).groupBy("rg_run").agg(F.max_by("rg_model", seq.version_parts(F.col("p.version"))).alias("model"))
    return g.select("rg_id", "rg_run").join(newest, "rg_run").withColumn("p", seq.model_parts(F.col("model"))).select("rg_id", "model", F.col("p.variant").alias("variant"), F.col("p.version").alias("version"))


@query("snk01_fan_out_counts", f"WITH {RECORDS} SELECT count(*) AS written, CAST(sum(CASE WHEN mapq >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS to_pass FROM records")
def fan_out(spark, d):
    return relation(spark, d, "records").agg(F.count("*").alias("written"), F.count_if(F.col("mapq") >= 30).alias("to_pass"))


@query("snk04_nested_output_path", f"WITH {READS}, {SHEET}, f AS (SELECT flowcell_id, barcode, arg_min(alias, row) AS alias FROM sheet GROUP BY ALL) SELECT read_id, 'exp/smp/20240101_0000_pos_' || r.flowcell_id || '_' || substring(read_id, 1, 8) || '/' || CASE WHEN n % 2 = 0 THEN 'bam_pass' ELSE 'bam_fail' END || '/' || coalesce(f.alias, CASE WHEN r.barcode = 'unclassified' THEN 'unclassified' ELSE 'barcode' || regexp_extract(r.barcode, '(\\d+)\\D*$', 1) END) AS path FROM reads r LEFT JOIN f ON r.flowcell_id = f.flowcell_id AND r.barcode = f.barcode")
def nested(spark, d):
    r = R.sample_sheet_row(relation(spark, d, "reads"), relation(spark, d, "sheet"), ["flowcell_id"])
    alias = R.output_alias(F.col("alias"), F.col("barcode"), [], F.lit("KIT"))
    return r.select("read_id", R.nested_path(F.lit("exp"), F.lit("smp"), F.lit("20240101_0000"), F.lit("pos"), F.col("flowcell_id"), F.col("read_id"), F.col("n") % 2 == 0, alias).alias("path"))


@query("snk11_paf_lines", f"WITH {RECORDS} SELECT rec, concat_ws(chr(9), qname, CAST(len_q AS VARCHAR), '0', CAST(len_q AS VARCHAR), strand, rname, '100000', CAST(pos AS VARCHAR), CAST(pos + len_r AS VARCHAR), CAST(len_r AS VARCHAR), CAST(len_r AS VARCHAR), CAST(mapq AS VARCHAR), 'cg:Z:' || cigar) AS line FROM records")
def paf_lines(spark, d):
    from readloom.sources.text import paf_line

    r = relation(spark, d, "records")
    return r.select("rec", paf_line(qname=F.col("qname"), qlen=F.col("len_q"), qstart=F.lit(0), qend=F.col("len_q"), strand=F.col("strand"), tname=F.col("rname"), tlen=F.lit(100000), tstart=F.col("pos"), tend=F.col("pos") + F.col("len_r"), matches=F.col("len_r"), block_len=F.col("len_r"), mapq=F.col("mapq"), cigar=F.col("cigar")).alias("line"))


@query("snk15_record_tags", f"WITH {READS}, q AS (SELECT *, {MEAN_Q_SQL} AS mean_q FROM reads) SELECT read_id, 'qs:f:' || CAST(round(mean_q, 3) AS VARCHAR) || chr(9) || 'ns:i:' || num_samples || chr(9) || 'ts:i:' || num_trimmed_samples || chr(9) || 'ch:i:' || channel || chr(9) || 'mx:i:' || mux || chr(9) || 'RG:Z:' || rg_id AS tags FROM q")
def record_tags(spark, d):
    from readloom.sources.text import sam_tags

    q = R.mean_q(relation(spark, d, "reads")).withColumn("qs", F.round("mean_q", 3))
    return q.select("read_id", sam_tags({"qs": ("f", F.col("qs")), "ns": ("i", F.col("num_samples")), "ts": ("i", F.col("num_trimmed_samples")), "ch": ("i", F.col("channel")), "mx": ("i", F.col("mux")), "RG": ("Z", F.col("rg_id"))}).alias("tags"))


@query("srt01_coordinate_rank", f"WITH {RECORDS} SELECT rec, CAST(row_number() OVER (PARTITION BY rname ORDER BY pos, rec) AS INTEGER) AS rank FROM records")
def coordinate_rank(spark, d):
    from pyspark.sql import Window

    return relation(spark, d, "records").select("rec", F.row_number().over(Window.partitionBy("rname").orderBy("pos", "rec")).alias("rank"))


@query("srt03_channel_mux_rank", f"WITH {READS} SELECT read_id, CAST(row_number() OVER (PARTITION BY channel ORDER BY mux, read_number) AS INTEGER) AS rank FROM reads")
def mux_rank(spark, d):
    from pyspark.sql import Window

    return relation(spark, d, "reads").select("read_id", F.row_number().over(Window.partitionBy("channel").orderBy("mux", "read_number")).alias("rank"))


@query("agg19_cigar_op_counts", f"WITH {RECORDS}, o AS (SELECT rec, nm, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') AS ops FROM records), s AS (SELECT rec, nm, CAST(list_sum(list_transform(ops, lambda x: CASE WHEN right(x, 1) IN ('M', '=', 'X') THEN CAST(left(x, length(x) - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS matches, CAST(list_sum(list_transform(ops, lambda x: CASE WHEN right(x, 1) = 'I' THEN CAST(left(x, length(x) - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS insertions, CAST(list_sum(list_transform(ops, lambda x: CASE WHEN right(x, 1) = 'D' THEN CAST(left(x, length(x) - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS deletions, CAST(list_sum(list_transform(ops, lambda x: CASE WHEN right(x, 1) IN ('S', 'H') THEN CAST(left(x, length(x) - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS clips FROM o) SELECT rec, matches, insertions, deletions, clips, nm - insertions - deletions AS substitutions, round(greatest(0, least(1, 1 - nm / CAST(matches + insertions + deletions AS DOUBLE))), 6) AS accuracy, round(greatest(0, least(1, 1 - (nm - insertions - deletions) / CAST(matches AS DOUBLE))), 6) AS snp_accuracy FROM s")
def cigar_counts(spark, d):
    r = relation(spark, d, "records").withColumns({"c": cigar.op_counts(F.col("cigar"), F.col("nm")), "a": cigar.accuracy(F.col("cigar"), F.col("nm"))})
    return r.select("rec", "c.*", F.round("a.total", 6).alias("accuracy"), F.round("a.snp", 6).alias("snp_accuracy"))


@query("cig03_trim_cigar", f"WITH {RECORDS} SELECT rec, (10 + CAST(regexp_extract(cigar, 'S(\\d+)M', 1) AS INTEGER) - 10 - l + l) || 'M' AS head, reference_at FROM (SELECT rec, cigar, CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS INTEGER) AS l, CAST(regexp_extract(cigar, 'S(\\d+)M', 1) AS INTEGER) AS reference_at FROM records)")
def trim_cigar(spark, d):
    r = relation(spark, d, "records").withColumns({"l": F.regexp_extract("cigar", r"^(\d+)S", 1).cast("int"), "m": F.regexp_extract("cigar", r"S(\d+)M", 1).cast("int")})
    return r.select("rec", cigar.trim(F.col("cigar"), F.col("l"), F.col("l") + F.col("m")).alias("head"), cigar.reference_at(F.col("cigar"), F.col("l") + F.col("m")).alias("reference_at"))


@query("cig02_round_trip", f"WITH {RECORDS} SELECT rec, cigar FROM records")
def cigar_text(spark, d):
    return relation(spark, d, "records").select("rec", cigar.text(cigar.parse(F.col("cigar"))).alias("cigar"))


@query("agg14_mean_qscore", f"WITH {READS} SELECT read_id, round({MEAN_Q_SQL}, 6) AS mean_q FROM reads")
def mean_q(spark, d):
    return relation(spark, d, "reads").select("read_id", F.round(numeric.mean_qscore(F.col("qstring")), 6).alias("mean_q"))
