"""Further queries: formats, routing, predicates, windows, signal kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.functions import numeric as N
from readloom.functions import seq as S
from readloom.operators import kernels as K
from readloom.operators import predict as P
from readloom.operators import reads as R
from readloom.operators import signal as G
from readloom.plans.mapping import cte, relation
from readloom.plans.registry import query

READS, RECORDS, GROUPS, BED = cte("reads"), cte("records"), cte("groups"), cte("bed")


@query("src03_selected_records", f"WITH {RECORDS} SELECT qname, count(*) AS n, min(pos) AS first_pos FROM records WHERE qname IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels) GROUP BY qname")
def selected(spark, d):
    ids = spark.read.parquet(f"{d}/labels.parquet").select(F.md5(F.col("doc_id").cast("string")).alias("qname"))
    return relation(spark, d, "records").join(ids, "qname", "left_semi").groupBy("qname").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("src04_by_channel_order", f"WITH {READS} SELECT channel, read_id, CAST(row_number() OVER (PARTITION BY channel ORDER BY mux, read_number) AS INTEGER) AS place FROM reads")
def by_channel(spark, d):
    w = Window.partitionBy("channel").orderBy("mux", "read_number")
    return relation(spark, d, "reads").select("channel", "read_id", F.row_number().over(w).alias("place"))


@query("src15_read_list", "SELECT DISTINCT md5(CAST(doc_id AS VARCHAR)) AS read_id FROM labels")
def read_list(spark, d):
    from readloom.sources.text import parse_list

    t = spark.read.parquet(f"{d}/labels.parquet")
    line = F.concat(F.lit(" "), F.md5(F.col("doc_id").cast("string")), F.lit("  "))
    return parse_list(t.select(F.explode(F.array(line, F.lit("  "), F.trim(line))).alias("value")))


@query("src17_sam_lines", f"WITH {RECORDS} SELECT qname, flag, rname, pos, mapq, cigar, CAST(nm AS VARCHAR) AS nm, len_r AS ref_span FROM records")
def sam_lines(spark, d):
    from readloom.sources.text import parse_sam

    r = relation(spark, d, "records")
    line = F.concat_ws("\t", "qname", "flag", "rname", F.col("pos") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), "nm"))
    head = spark.createDataFrame([("@SQ\tSN:chr1\tLN:9",)], "value string")
    out = parse_sam(r.select(line.alias("value")).union(head))
    return out.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.col("tags")["NM"].alias("nm"), cigar.total(cigar.parse(F.col("cigar")), cigar.REFERENCE).alias("ref_span"))


@query("src20_header_facts", f"WITH {GROUPS} SELECT count(*) AS read_groups, count(DISTINCT rg_model) AS models, bool_or(rg_id = 'rg3') AS has_selected FROM groups")
def header_facts(spark, d):
    return relation(spark, d, "groups").agg(F.count("*").alias("read_groups"), F.countDistinct("rg_model").alias("models"), F.bool_or(F.col("rg_id") == "rg3").alias("has_selected"))


@query("snk06_alias_routing", f"WITH {READS} SELECT read_id, CASE WHEN n % 4 = 0 THEN 'mine' WHEN n % 4 = 1 AND barcode <> 'unclassified' THEN 'barcode' || regexp_extract(barcode, '(\\d+)\\D*$', 1) WHEN n % 4 = 1 THEN 'unclassified' WHEN n % 4 = 2 THEN 'b7' ELSE 'unclassified' END AS alias FROM reads")
def routing(spark, d):
    n = F.col("n") % 4
    return relation(spark, d, "reads").select("read_id", R.output_alias(F.when(n == 0, "mine").otherwise(""), F.when(n == 1, F.col("barcode")), [F.when(n == 2, F.lit("KIT_b7")), F.lit("")], F.lit("KIT")).alias("alias"))


@query("snk10_summary_tsv", f"WITH {READS} SELECT read_id, format('{{:.6f}}', start_time_ms / 1000.0) AS start_time, CASE WHEN n % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS passes_filtering, '' AS pore_type, channel FROM reads")
def summary_tsv(spark, d):
    from readloom.sources.sinks import summary_rows

    r = relation(spark, d, "reads").withColumns({"start_time": F.col("start_time_ms") / 1000.0, "passes_filtering": F.col("n") % 2 == 0})
    return summary_rows(r).select("read_id", "start_time", "passes_filtering", "pore_type", "channel")


@query("snk16_fastq_lines", f"WITH {READS} SELECT '@' || read_id || chr(9) || 'RG:Z:' || rg_id || chr(10) || seq || chr(10) || '+' || chr(10) || qstring AS line FROM reads")
def fastq(spark, d):
    from readloom.sources.sinks import fastq_line

    return relation(spark, d, "reads").select(fastq_line(F.col("read_id"), F.col("seq"), F.col("qstring"), F.concat(F.lit("RG:Z:"), "rg_id")).alias("line"))


@query("snk17_fasta_lines", f"WITH {READS} SELECT '>' || read_id || chr(10) || seq AS line FROM reads")
def fasta(spark, d):
    from readloom.sources.sinks import fasta_line

    return relation(spark, d, "reads").select(fasta_line(F.col("read_id"), F.col("seq")).alias("line"))


@query("snk18_processed_regions", f"""WITH {BED}, iv AS (SELECT DISTINCT genome, start, start + ("end" - start) * 2 - 5 AS stop FROM bed WHERE start <= start + ("end" - start) * 2 - 5),
n AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY genome ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS opens FROM iv),
g AS (SELECT *, sum(opens) OVER (PARTITION BY genome ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT false AS merged, genome || chr(9) || start || chr(9) || (stop + 1) AS line FROM iv UNION ALL SELECT true, genome || chr(9) || min(start) || chr(9) || (max(stop) + 1) FROM g GROUP BY genome, island""")
def regions(spark, d):
    from readloom.operators.intervals import processed_regions

    samples = relation(spark, d, "bed").select("genome", "start", (F.col("start") + (F.col("end") - F.col("start")) * 2 - 4).alias("end"))
    both = [processed_regions(samples, ["genome"], m).select(F.lit(m).alias("merged"), F.concat_ws("\t", "genome", "start", "end").alias("line")) for m in (False, True)]
    return both[0].union(both[1])


@query("flt08_long_indels", f"WITH {RECORDS} SELECT rec FROM records WHERE CAST(regexp_extract(cigar, '(\\d+)I', 1) AS INTEGER) <= 2 AND CAST(regexp_extract(cigar, '(\\d+)D', 1) AS INTEGER) <= 2")
def long_indels(spark, d):
    ops = cigar.parse(F.col("cigar"))
    return relation(spark, d, "records").filter(~F.exists(ops, lambda o: o["op"].isin("I", "D") & (o["n"] > 2))).select("rec")


@query("flt13_motif_mask", f"WITH {READS} SELECT read_id, len(list_filter(generate_series(1, length(seq)), lambda i: substring(seq, i, 2) = 'CG' OR (ascii(substring(qstring, i, 1)) - 33) >= 38)) AS kept FROM reads")
def motif_mask(spark, d):
    return relation(spark, d, "reads").select("read_id", S.motif_mask(F.col("seq"), "CG", N.phred_scores(F.col("qstring")), 38).alias("kept"))


@query("prj06_barcoding_fields", f"WITH {READS}, {GROUPS} SELECT read_id, coalesce(rg_barcode, 'unclassified') AS name FROM reads r LEFT JOIN groups g ON r.rg_id = g.rg_id")
def barcoding(spark, d):
    return R.with_read_groups(relation(spark, d, "reads"), relation(spark, d, "groups")).select("read_id", F.coalesce("rg_barcode", F.lit(S.UNCLASSIFIED)).alias("name"))


@query("joi11_pair_alignment_filter", f"WITH {RECORDS} SELECT rec FROM records WHERE mapq >= 50 AND len_r / CAST(len_q AS DOUBLE) > 0.8 AND flag & 16 <> 0 AND pos % 1000 <= 500 AND len_r > 50")
def pair_alignment(spark, d):
    ok = R.pair_alignment_ok(F.col("mapq"), F.col("len_r") / F.col("len_q"), R.has_flag(F.col("flag"), 16), F.col("pos") % 1000, F.col("len_r"))
    return relation(spark, d, "records").filter(ok).select("rec")


@query("joi16_pile_sequences", f"WITH {READS}, {RECORDS} SELECT rec, length(seq) AS seq_len FROM records JOIN reads ON qname = read_id WHERE length(seq) = length(qstring)")
def pile_sequences(spark, d):
    r = relation(spark, d, "reads").select(F.col("read_id").alias("qname"), "seq", "qstring")
    return relation(spark, d, "records").join(r, "qname").filter(F.length("seq") == F.length("qstring")).select("rec", F.length("seq").cast("long").alias("seq_len"))


@query("win02_time_neighbours", f"WITH {READS} SELECT read_id, lag(read_id) OVER w AS earlier, lead(read_id) OVER w AS later FROM reads WINDOW w AS (PARTITION BY channel, run_id, flowcell_id ORDER BY start_time_ms, read_id)")
def time_neighbours(spark, d):
    w = Window.partitionBy("channel", "run_id", "flowcell_id").orderBy("start_time_ms", "read_id")
    return relation(spark, d, "reads").select("read_id", F.lag("read_id").over(w).alias("earlier"), F.lead("read_id").over(w).alias("later"))


@query("win11_sliding_stats", "WITH w AS (SELECT vec_id, unnest(generate_series(0, 54, 3)) AS i, embedding AS e FROM embeddings), s AS (SELECT vec_id, i, list_transform(e[i + 1:i + 10], lambda x: CAST(x AS DOUBLE)) AS p FROM w) SELECT vec_id, i AS start, round(list_sum(p) / 10, 6) AS mean FROM s")
def sliding(spark, d):
    at = F.explode(F.sequence(F.lit(0), F.lit(54), F.lit(3))).alias("start")
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", at)
    part = F.transform(F.slice("embedding", F.col("start") + 1, 10), lambda x: x.cast("double"))
    return t.select("vec_id", F.col("start").cast("long").alias("start"), F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / 10, 6).alias("mean"))


@query("srt04_sample_order", f'WITH {BED} SELECT genome, start, "end", CAST(row_number() OVER (PARTITION BY genome ORDER BY start, "end" DESC) AS INTEGER) AS place FROM (SELECT DISTINCT genome, start, "end" FROM bed)')
def sample_order(spark, d):
    w = Window.partitionBy("genome").orderBy("start", F.desc("end"))
    return relation(spark, d, "bed").select("genome", "start", "end").distinct().withColumn("place", F.row_number().over(w))


@query("str10_number_text", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS t FROM lineitem")
def number_text(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("t"))


@query("agg20_alignment_accuracy", f"WITH {RECORDS} SELECT rec, round(greatest(0, least(1, 1 - nm / CAST(len_r - (1 + 0) + 1 + CAST(regexp_extract(cigar, '(\\d+)I', 1) AS BIGINT) AS DOUBLE))), 6) AS total FROM records")
def accuracy(spark, d):
    return relation(spark, d, "records").select("rec", F.round(cigar.accuracy(F.col("cigar"), F.col("nm"))["total"], 6).alias("total"))


# Kernels: rows only


def _signals(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("read_id"), F.transform("embedding", lambda x: (x * 10).cast("float")).alias("signal"))


def _each(df, column, kinds, f):
    """One row a row: f of a column's arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [f(np.asarray(x)) for x in b[column]]
            yield pd.DataFrame([(i, *o) for i, o in zip(b["read_id"], out, strict=True)], columns=["read_id", *[k.split()[0] for k in kinds]])

    return df.select("read_id", column).mapInPandas(run, ", ".join(["read_id string", *kinds]))


@query("prj16_mux_change_trim", f"""WITH {READS}, b AS (SELECT n, length(qstring) AS len, unnest(generate_series(1, length(qstring))) AS j, reverse(qstring) AS q FROM reads),
t AS (SELECT n, len, j, sum(CASE WHEN j <= n % 61 THEN -1 WHEN ascii(substring(q, j, 1)) - 33 <= 7 THEN -1 WHEN ascii(substring(q, j, 1)) - 33 <= 12 THEN 1 ELSE 10 END) OVER (PARTITION BY n ORDER BY j) AS total FROM b),
k AS (SELECT n, len, total, len - 1 - max(j) AS keep FROM t GROUP BY n, len, total QUALIFY total = min(total) OVER (PARTITION BY n))
SELECT read_id, CAST(CASE WHEN len >= 20 AND total <= -1 AND keep >= floor(CAST(len AS FLOAT) * CAST(0.3 AS FLOAT)) AND keep < len - 5 THEN keep ELSE len END AS INTEGER) AS keep FROM k JOIN reads USING (n)""")
def mux_trim(spark, d):
    """The test reads are good to their ends: the last n % 61 bases are taken as bad."""
    bad = lambda i: F.length("qstring") - i <= F.col("n") % 61
    q = relation(spark, d, "reads").select("read_id", F.transform(F.split("qstring", ""), lambda c, i: F.when(bad(i), 2).otherwise(F.ascii(c) - 33)).alias("q"))
    return _each(q, "q", ["keep int"], lambda x: (G.mux_change_trim(x, least_len=20),))


SAMPLES = "samples AS (SELECT vec_id, least(len(embedding), 8000) AS n, unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) * 10 AS FLOAT) AS x FROM embeddings)"


@query("prj19_signal_trim", f"""WITH {SAMPLES}, w AS (SELECT vec_id, n, (i - 4) // 8 AS k, count(*) FILTER (4 * x > CAST(2.4 AS FLOAT)) AS above, arg_max(4 * x, i) AS last_x FROM samples WHERE i >= 4 AND i < 4 + (n - 4) // 8 * 8 GROUP BY ALL),
p AS (SELECT *, max(above) OVER (PARTITION BY vec_id ORDER BY k) > 3 AS peak FROM w),
f AS (SELECT vec_id, n, 12 + 8 * min(k) FILTER (peak AND last_x <= CAST(2.4 AS FLOAT)) AS cut FROM p GROUP BY vec_id, n)
SELECT CAST(e.vec_id AS VARCHAR) AS read_id, CAST(CASE WHEN cut < n - 4 THEN cut ELSE 4 END AS INTEGER) AS cut FROM embeddings e LEFT JOIN f USING (vec_id)""")
def signal_trim(spark, d):
    high = _signals(spark, d).withColumn("signal", F.transform("signal", lambda x: (x * 4).cast("float")))
    return _each(high, "signal", ["cut int"], lambda x: (G.trim_start(x, window=8, least=4),))


@query("prj20_rna_adapter_end")
def rna_end(spark, d):
    return _each(_signals(spark, d), "signal", ["at int"], lambda x: (G.rna_adapter_end(x, 10, 2, 4, 100, 0.5, 1.0),))


@query("krn09_poly_tail")
def tails(spark, d):
    return _each(_signals(spark, d), "signal", ["bases int"], lambda x: (G.poly_tail(x, 32, 2.0, 3, 2, 0.8),))


@query("krn13_pore_regions", f"""WITH {SAMPLES}, t AS (SELECT vec_id, x, CASE WHEN i - lag(i) OVER (PARTITION BY vec_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS opens FROM samples WHERE x > 2)
SELECT CAST(e.vec_id AS VARCHAR) AS read_id, CAST(coalesce(sum(opens), 0) AS INTEGER) AS regions, CAST(coalesce(max(x), 0) AS DOUBLE) AS peak FROM embeddings e LEFT JOIN t USING (vec_id) GROUP BY e.vec_id""")
def pores(spark, d):
    return _each(_signals(spark, d), "signal", ["regions int", "peak double"], lambda x: (len(r := G.pore_regions(x, 2.0, 3)), max((p[3] for p in r), default=0.0)))


@query("prj21_modbase_tags", f"""WITH {READS}, b AS (SELECT n, seq, qstring, unnest(generate_series(1, length(seq))) AS i FROM reads),
c AS (SELECT n, i, ascii(substring(qstring, i, 1)) - 33 AS p, row_number() OVER (PARTITION BY n ORDER BY i) AS r FROM b WHERE substring(seq, i, 1) = 'C'),
m AS (SELECT n, i, p, r - coalesce(lag(r) OVER (PARTITION BY n ORDER BY i), 0) - 1 AS skip FROM c WHERE p > 20),
g AS (SELECT n, string_agg(',' || skip, '' ORDER BY i) AS skips, string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) AS ml FROM m GROUP BY n)
SELECT read_id, 'C+m?' || coalesce(skips, '') || ';' AS mm, coalesce(ml, '') AS ml FROM reads LEFT JOIN g USING (n)""")
def mod_tags(spark, d):
    probs = F.transform(F.split("qstring", ""), lambda c: F.ascii(c) - 33)
    tags = S.mod_tags(F.col("seq"), probs, "C", "m", 20)
    return relation(spark, d, "reads").select("read_id", tags.alias("t")).select("read_id", "t.mm", F.array_join(F.transform("t.ml", lambda p: p.cast("string")), ",").alias("ml"))


@query("str20_infix_distance")
def infix(spark, d):
    return K.detect(relation(spark, d, "reads"), [K.Query("q", "ACGTNNACGT")], [], 96).select("read_id", F.round("front.score", 6).alias("score"), "front.begin", "front.end")


@query("krn03_umi")
def umis(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"read_id": b["read_id"], "umi": [K.umi(s, "TTVVVVTT", 40, 0.7) for s in b["seq"]]})

    return relation(spark, d, "reads").select("read_id", "seq").mapInPandas(run, "read_id string, umi string")


@query("agg25_chunk_stitch", "SELECT CAST(vec_id AS VARCHAR) AS read_id, array_to_string(list_transform(list_filter(generate_series(1, len(embedding)), lambda i: embedding[i] > 0), lambda i: substring('ACGT', CAST((i - 1) % 4 + 1 AS INTEGER), 1)), '') AS seq FROM embeddings")
def chunk_stitch(spark, d):
    """A model that calls a base, by its place, at each sample above 0: stitched chunks
    must give what one call of the whole signal gives."""

    def model():
        def call(b: pd.DataFrame) -> pd.DataFrame:
            moves = [(np.asarray(x) > 0).astype(int) for x in b["chunk"]]
            seqs = ["".join("ACGT"[i % 4] for i in (np.flatnonzero(m) + o).tolist()) for m, o in zip(moves, b["offset"], strict=True)]
            return pd.DataFrame({"read_id": b["read_id"], "offset": b["offset"], "seq": seqs, "qstring": ["I" * len(s) for s in seqs], "moves": [m.tolist() for m in moves]})

        return call

    called = P.predict(P.chunked(_signals(spark, d), 20, 6), model, "read_id string, offset long, seq string, qstring string, moves array<int>")
    return P.stitched(called, 1).select("read_id", "seq")
