"""Queries on scalar functions: sequences, names, times, numbers, moves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.functions import numeric as N
from readloom.functions import seq as S
from readloom.operators import batching
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

READS = cte("reads")


def _reads(spark, d):
    return relation(spark, d, "reads")


@query("str01_reverse_complement", f"WITH {READS} SELECT read_id, translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') AS rc FROM reads")
def revcomp(spark, d):
    return _reads(spark, d).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("str03_base_codes", f"WITH {READS} SELECT read_id, CAST(list_sum(list_transform(string_split(seq, ''), lambda b: instr('ACGT', b) - 1)) AS BIGINT) AS total FROM reads")
def codes(spark, d):
    return _reads(spark, d).select("read_id", F.aggregate(S.base_codes(F.col("seq")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("str04_runs_at_ends", f"WITH {READS} SELECT read_id, CAST(length(seq) - length(ltrim(seq, 'A')) AS INTEGER) AS lead_a, CAST(length(seq) - length(rtrim(seq, 'A')) AS INTEGER) AS trail_a FROM reads")
def runs_at_ends(spark, d):
    return _reads(spark, d).select("read_id", S.leading_run(F.col("seq"), "A").alias("lead_a"), S.trailing_run(F.col("seq"), "A").alias("trail_a"))


@query("str05_polya_start", "WITH t AS (SELECT o_orderkey, repeat('CG', CAST(o_orderkey % 9 AS INTEGER)) || repeat('A', CAST(o_orderkey % 12 AS INTEGER)) || repeat('C', CAST(o_orderkey % 5 AS INTEGER)) AS s FROM orders) SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 12 >= 5 THEN 2 * (o_orderkey % 9) ELSE length(s) END AS INTEGER) AS start FROM t")
def polya_start(spark, d):
    k = F.col("o_orderkey")
    s = F.concat(F.expr("repeat('CG', cast(o_orderkey % 9 as int))"), F.expr("repeat('A', cast(o_orderkey % 12 as int))"), F.expr("repeat('C', cast(o_orderkey % 5 as int))"))
    return spark.read.parquet(f"{d}/orders.parquet").select(k, S.rna_polya_start(s).alias("start"))


@query("str06_split", "SELECT event_id, len(string_split(props, ',')) AS parts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE len(string_split(props, ',')) END AS view_parts FROM events")
def split(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select("event_id", F.size(S.split_all(F.col("props"), ",")).cast("long").alias("parts"), F.size(S.split_view(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")), ",")).cast("long").alias("view_parts"))


@query("str08_text_predicates", "SELECT p_partkey, starts_with(p_name, 'a') AS sw, suffix(p_name, 'e') AS ew, contains(p_name, 'o') AS c, upper(p_name) AS u, rtrim(p_name || '  ') AS r FROM part")
def predicates(spark, d):
    n = F.col("p_name")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", n.startswith("a").alias("sw"), n.endswith("e").alias("ew"), n.contains("o").alias("c"), F.upper(n).alias("u"), F.rtrim(F.concat(n, F.lit("  "))).alias("r"))


@query("str09_number_prefix", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS n FROM orders")
def prefix(spark, d):
    t = F.when(F.col("o_orderkey") % 4 == 0, F.lit("x1")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("kb")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.number_prefix(t).alias("n"))


@query("str11_normalize_barcode", f"WITH {READS} SELECT read_id, CASE WHEN barcode = 'unclassified' THEN barcode ELSE 'barcode' || regexp_extract(barcode, '(\\d+)\\D*$', 1) END AS name, concat_ws('_', 'KIT', CASE WHEN barcode = 'unclassified' THEN barcode ELSE 'barcode' || regexp_extract(barcode, '(\\d+)\\D*$', 1) END) AS std FROM reads")
def barcode(spark, d):
    return _reads(spark, d).select("read_id", S.normalize_barcode(F.col("barcode")).alias("name"), S.standard_barcode(F.lit("KIT"), F.col("barcode")).alias("std"))


@query("str13_derive_uuid", "WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '1') AS h FROM documents) SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM documents JOIN h USING (doc_id)")
def uuid(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.derive_uuid(F.col("doc_id").cast("string"), F.lit("1")).alias("id"))


@query("str14_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def sha(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("h"))


@query("str15_sequence_md5", f"WITH {READS} SELECT read_id, md5(upper(seq)) AS m5 FROM reads")
def m5(spark, d):
    return _reads(spark, d).select("read_id", S.sequence_md5(F.lower(F.concat("seq", F.lit("\n ")))).alias("m5"))


@query("str16_motif_hits", f"WITH {READS} SELECT read_id, list_transform(list_filter(generate_series(1, greatest(length(seq) - 2, 1)), lambda i: regexp_full_match(substring(seq, i, 3), '[AG]A[CT]')), lambda i: CAST(i AS INTEGER)) AS hits FROM reads")
def motifs(spark, d):
    return _reads(spark, d).select("read_id", S.motif_hits(F.col("seq"), "RAY", 1).alias("hits"))


@query("str17_motif_context", "SELECT n_nationkey, 'CCG' AS motif, 1 AS \"offset\" FROM nation")
def context(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.get(S.motif_context(F.lit("_:CXG:_:_")), F.lit(1)).alias("m"))
    return t.select("n_nationkey", F.col("m.motif").alias("motif"), F.col("m.offset").alias("offset"))


@query("str18_mod_code", "SELECT o_orderkey, o_orderkey % 4 < 2 AS ok FROM orders")
def mod_code(spark, d):
    code = F.when(F.col("o_orderkey") % 4 == 0, F.lit("m")).when(F.col("o_orderkey") % 4 == 1, F.lit("17596")).when(F.col("o_orderkey") % 4 == 2, F.lit("")).otherwise(F.lit("m1"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.valid_mod_code(code).alias("ok"))


@query("str21_parse_region", "SELECT o_orderkey, 'chr' || o_orderkey % 9 AS name, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey - 1 END AS start, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey + 50 END AS \"end\" FROM orders")
def region(spark, d):
    k, name = F.col("o_orderkey"), F.concat(F.lit("chr"), (F.col("o_orderkey") % 9).cast("string"))
    text = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, F.lit(":"), k.cast("string"), F.lit("-"))).otherwise(F.concat(name, F.lit(":"), k.cast("string"), F.lit("-"), (k + 50).cast("string")))
    return spark.read.parquet(f"{d}/orders.parquet").select(k, S.parse_region(text).alias("r")).select("o_orderkey", "r.name", "r.start", "r.end")


@query("str22_cli_token", "SELECT o_orderkey, 'my dir' AS out_dir FROM orders")
def token(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.cli_token(F.concat(F.lit("tool run --out 'my dir' -x "), F.col("o_orderkey").cast("string")), "--out").alias("out_dir"))


@query("str23_trim_flags", "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'none' ELSE concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 'adapter' END, CASE WHEN (o_orderkey // 2) % 2 = 1 THEN 'primer' END, CASE WHEN (o_orderkey // 4) % 2 = 1 THEN 'barcode' END) END AS flags FROM orders) SELECT o_orderkey, flags, CAST(o_orderkey % 8 AS INTEGER) AS mask FROM t")
def trim_flags(spark, d):
    bit = lambda b: F.col("o_orderkey").bitwiseAND(F.lit(b)) != 0
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.trim_flags(bit(1), bit(2), bit(4)).alias("flags"))
    return t.withColumn("mask", S.trim_mask(F.col("flags")))


@query("str24_model_names", "SELECT n_nationkey, 'hac' AS variant, 'v' || n_regionkey AS version, 2 AS mods FROM nation")
def model_names(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.model_parts(F.concat(F.lit("hac@v"), F.col("n_regionkey").cast("string"), F.lit(",5mCG@v2,6mA"))).alias("m"))
    return t.select("n_nationkey", "m.variant", "m.version", F.size("m.mods").cast("long").alias("mods"))


@query("str26_edit_distance", f"WITH {READS} SELECT read_id, levenshtein(qstring, reverse(qstring)) AS d FROM reads")
def edit(spark, d):
    return _reads(spark, d).select("read_id", F.levenshtein("qstring", F.reverse("qstring")).cast("long").alias("d"))


@query("tim01_run_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M') AS stamp FROM events")
def stamp(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", N.run_stamp(F.unix_millis(F.col("ts").cast("timestamp"))).alias("stamp"))


@query("tim02_iso_ms", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || '000+00:00' AS iso FROM events")
def iso(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", N.iso_utc(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("tim03_iso_seconds", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso_s(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", N.iso_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("iso"))


@query("tim04_iso_parse", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def iso_parse(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no time")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", N.iso_to_ms(text).alias("ms"))


@query("mat01_integer_division", "SELECT o_orderkey, CAST(ceil(o_orderkey / 7.0) AS BIGINT) AS up, CAST(floor((o_orderkey + 3) / 7.0) AS BIGINT) AS closest, CAST(ceil(o_orderkey / 7.0) AS BIGINT) * 7 AS padded FROM orders")
def division(spark, d):
    k, s = F.col("o_orderkey"), F.lit(7)
    return spark.read.parquet(f"{d}/orders.parquet").select(k, N.div_round_up(k, s).alias("up"), N.div_round_closest(k, s).alias("closest"), N.pad_to(k, s).alias("padded"))


@query("mat03_phred", "WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN p <= 0 THEN 60 WHEN p >= 1 THEN 0 ELSE -10 * log10(p) END, 6) AS q, round(-10 * log10(least(greatest(p, pow(10, -7)), 1)), 3) + 0.0 AS capped FROM p")
def phred(spark, d):
    p = F.col("l_discount") * 12 - 0.1
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(N.quality_of(p), 6).alias("q"), N.capped_phred(p, 70).alias("capped"))


@query("mat05_sequence_quality", "WITH v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: ln(greatest(1e-10, 1 - abs(CAST(x AS DOUBLE)) / 10)))) AS t FROM embeddings) SELECT vec_id, round(least(60, CASE WHEN 1 - exp(t) <= 0 THEN 60 WHEN 1 - exp(t) >= 1 THEN 0 ELSE -10 * log10(1 - exp(t)) END), 6) AS q FROM v")
def seq_quality(spark, d):
    p = F.transform("embedding", lambda x: 1 - F.abs(x.cast("double")) / 10)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(N.sequence_quality(p), 6).alias("q"))


@query("mat06_mapq_of_places", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 60 ELSE CAST(round(-10 * log10(1 - 1.0 / l_linenumber)) AS INTEGER) END AS mapq FROM lineitem")
def mapq(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.mapq_of(F.col("l_linenumber")).alias("mapq"))


@query("mat07_gq_margin", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 10 WHEN l_quantity >= 20 THEN 5 ELSE 2 END AS margin FROM lineitem")
def margin(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.gq_margin(F.col("l_quantity"), [10, 20, 40], [2, 5, 10]).alias("margin"))


@query("mat08_even_partitions", "SELECT p_partkey, CAST(ntile(7) OVER (ORDER BY p_partkey) AS INTEGER) AS part FROM part")
def even(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.ntile(7).over(Window.orderBy("p_partkey")).alias("part"))


@query("mat09_size_batches", "WITH RECURSIVE r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), s AS (SELECT p_partkey, p_brand, p_size, k, CAST(p_size AS BIGINT) AS total, 0 AS batch FROM r WHERE k = 1 UNION ALL SELECT r.p_partkey, r.p_brand, r.p_size, r.k, CASE WHEN s.total >= 100 THEN 0 ELSE s.total END + r.p_size, s.batch + CASE WHEN s.total >= 100 THEN 1 ELSE 0 END FROM s JOIN r ON r.p_brand = s.p_brand AND r.k = s.k + 1) SELECT p_partkey, p_size, CAST(batch AS BIGINT) AS batch FROM s")
def batches(spark, d):
    return batching.size_batches(spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", "p_size", 100).select("p_partkey", "p_size", "batch")


MOVES = "list_transform(string_split(md5(CAST(event_id AS VARCHAR)), ''), lambda c: CASE WHEN c < '8' THEN 1 ELSE 0 END)"


def _moves(spark, d):
    letters = F.filter(F.split(F.md5(F.col("event_id").cast("string")), ""), lambda c: c != "")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.transform(letters, lambda c: F.when(c < "8", 1).otherwise(0)).alias("m"))


@query("mov01_moves_to_map", f"WITH m AS (SELECT event_id, {MOVES} AS m FROM events) SELECT event_id, list_append(list_transform(list_filter(generate_series(1, 32), lambda i: m[i] = 1), lambda i: CAST((i - 1) * 6 AS INTEGER)), 192) AS map FROM m")
def moves_map(spark, d):
    return _moves(spark, d).select("event_id", N.moves_to_map(F.col("m"), F.lit(6), F.lit(192)).alias("map"))


@query("mov02_base_to_move", f"WITH m AS (SELECT event_id, {MOVES} AS m FROM events), a AS (SELECT event_id, list_filter(generate_series(1, 32), lambda i: m[i] = 1) AS places FROM m) SELECT event_id, CAST(coalesce(places[event_id % 20 + 1] - 1, -1) AS INTEGER) AS move FROM a")
def base_move(spark, d):
    return _moves(spark, d).select("event_id", N.base_to_move(F.col("m"), F.col("event_id") % 20).alias("move"))


@query("mov03_trim_moves", f"WITH m AS (SELECT event_id, {MOVES} AS m FROM events), a AS (SELECT event_id, m, list_filter(generate_series(1, 32), lambda i: m[i] = 1) AS places FROM m) SELECT event_id, CAST(places[3] - 1 AS INTEGER) AS front, CAST(coalesce(places[8] - 1, 32) - (places[3] - 1) AS INTEGER) AS kept FROM a WHERE len(places) >= 3")
def trim_moves(spark, d):
    t = _moves(spark, d).filter(F.aggregate("m", F.lit(0), lambda a, x: a + x) >= 3).select("event_id", N.trim_moves(F.col("m"), F.lit(2), F.lit(7)).alias("t"))
    return t.select("event_id", "t.front", F.size("t.moves").alias("kept"))


@query("prj25_argmax_consensus", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", N.argmax_index(F.col("embedding")).alias("best"))


@query("agg16_med_mad", "WITH s AS (SELECT vec_id, embedding AS e, list_sort(embedding)[32] AS m FROM embeddings) SELECT vec_id, round(CAST(m AS DOUBLE), 6) AS shift, round(CAST(list_sort(list_transform(e, lambda x: abs(CAST(x AS DOUBLE) - CAST(m AS DOUBLE))))[32] AS DOUBLE) * 1.4826 + 1e-9, 6) AS scale FROM s")
def med_mad(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", N.med_mad(F.col("embedding").cast("array<double>")).alias("s"))
    return t.select("vec_id", F.round("s.shift", 6).alias("shift"), F.round("s.scale", 6).alias("scale"))


@query("agg17_counting_quantile", "SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER)))[CAST(floor(0.2 * 63) AS INTEGER) + 1] AS q20 FROM embeddings")
def counting(spark, d):
    xs = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", N.counting_quantile(xs, 0.2).alias("q20"))


@query("prj18_quantile_scaling", "WITH s AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS e FROM embeddings), q AS (SELECT vec_id, e, e[13] + (e[14] - e[13]) * 0.6 AS a, e[57] + (e[58] - e[57]) * 0.7 AS b FROM s) SELECT vec_id, round(a, 6) AS q20, round(b, 6) AS q90, round((e[1] - a) / (b - a), 4) AS lowest FROM q")
def scaling(spark, d):
    xs = F.col("embedding").cast("array<double>")
    q = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", N.quantile(xs, 0.2).alias("a"), N.quantile(xs, 0.9).alias("b"), F.array_min(xs).alias("low"))
    return q.select("vec_id", F.round("a", 6).alias("q20"), F.round("b", 6).alias("q90"), F.round((F.col("low") - F.col("a")) / (F.col("b") - F.col("a")), 4).alias("lowest"))


@query("jsn01_json_extra", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
