"""Queries over whole tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Good documents are twice as likely, bad ones half as likely to be drawn first."""
    return labels.select("doc_id", F.expr("case quality when 1 then 2.0D when 0 then 0.5D else 1.0D end").alias("weight"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents of quality 1; background: all others."""
    from readloom.llm.lm_score import cross_entropy_difference

    out = cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").filter("quality = 1"))
    return out.withColumnRenamed("id", "doc_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.mixing import mix_sources

    out = mix_sources(_read(spark, sf_dir, "documents"), quality=quality_weights(_read(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "epochs")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from readloom.llm.packing import pack

    out = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.simhash import fingerprint_edits

    return fingerprint_edits(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.minhash import near_duplicates

    out = near_duplicates(_read(spark, sf_dir, "documents"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.langid import fit, held_out, predict

    docs = _read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0, k=10)


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.quotes import link_quotes

    out = link_quotes(_read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "root", "depth", "position", "reply_to", "n_quoted", "n_linked", "max_level", F.sha2("text", 256).alias("text_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.substring import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OPERATORS = (
    op1_lm_score,
    op2_mix_sources,
    op3_line_dedup,
    op4_pack,
    op5_simhash,
    op6_minhash,
    op7_language_id,
    op8_nn_descent,
    op9_quotation_linking,
    op10_substring_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim({_LOWER.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

REPEATS_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM docs WHERE len(w) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 34)) AS i FROM win WHERE h IN (SELECT h FROM again)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
left_over AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.i) AS t
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN left_over k ON d.doc_id = k.doc_id"""

NEAR_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM both_ JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.v FROM reach r JOIN link l ON r.b = l.u),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d JOIN low l ON d.doc_id = l.doc_id LEFT JOIN size z ON z.doc_id = d.doc_id"""


QUOTES_SQL = rf"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) AS line,
         generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS pos
  FROM conversations),
parsed AS (
  SELECT conv_id, turn, pos, line,
         CAST(length(translate(regexp_extract(line, '^([ \t]*>)+'), ' ' || chr(9), '')) AS INTEGER) AS level,
         {_LOWER.format("array_to_string(regexp_extract_all(regexp_replace(line, '^([ " + chr(92) + "t]*>)+', ''), '[^" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D]+'), ' ')")} AS norm
  FROM lines),
kinds AS (SELECT *, CASE WHEN level = 0 AND norm = '' THEN -1 ELSE level END AS kind FROM parsed),
cut AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY pos) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM kinds),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM cut),
runs AS (SELECT conv_id, turn, run, kind AS level, string_agg(norm, ' ' ORDER BY pos) AS norm FROM numbered WHERE kind >= 0 AND norm <> '' GROUP BY ALL),
passages AS (SELECT *, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS m FROM runs WHERE level > 0),
bodies AS (SELECT conv_id, turn, string_agg(norm, ' ' ORDER BY run) AS norm FROM runs WHERE level = 0 GROUP BY ALL),
blocks AS (SELECT conv_id, norm, min(turn) AS origin FROM runs WHERE level = 0 GROUP BY ALL),
whole AS (
  SELECT p.*, b.origin FROM passages p LEFT JOIN blocks b ON p.conv_id = b.conv_id AND p.norm = b.norm AND b.origin < p.turn),
asked AS (
  SELECT conv_id, turn, run, least(m, 5) AS l, unnest(list_distinct([array_to_string(w[i:i + least(m, 5) - 1], ' ') for i in range(1, m - least(m, 5) + 2)])) AS g
  FROM whole WHERE origin IS NULL),
held AS (
  SELECT conv_id, turn, l, unnest([array_to_string(w[i:i + l - 1], ' ') for i in range(1, len(w) - l + 2)]) AS g
  FROM (SELECT conv_id, turn, string_split(norm, ' ') AS w FROM bodies) b, (SELECT unnest([1, 2, 3, 4, 5]) AS l) s),
first_held AS (SELECT conv_id, l, g, min(turn) AS origin FROM held GROUP BY ALL),
votes AS (
  SELECT a.conv_id, a.turn, a.run, f.origin, count(*) AS n
  FROM asked a JOIN first_held f ON a.conv_id = f.conv_id AND a.l = f.l AND a.g = f.g WHERE f.origin < a.turn GROUP BY ALL),
named AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY n DESC, origin DESC) = 1),
inside AS (
  SELECT n.conv_id, n.turn, n.run, n.origin
  FROM named n JOIN passages p ON n.conv_id = p.conv_id AND n.turn = p.turn AND n.run = p.run
  JOIN bodies b ON b.conv_id = n.conv_id AND b.turn = n.origin WHERE contains(' ' || b.norm || ' ', ' ' || p.norm || ' ')),
through AS (SELECT conv_id, norm, level, min(turn) AS via FROM passages GROUP BY ALL),
linked AS (
  SELECT w.conv_id, w.turn, w.level, w.m,
         CASE WHEN coalesce(w.origin, i.origin) IS NOT NULL THEN coalesce(t.via, w.origin, i.origin) END AS target
  FROM whole w LEFT JOIN inside i ON w.conv_id = i.conv_id AND w.turn = i.turn AND w.run = i.run
  LEFT JOIN through t ON t.conv_id = w.conv_id AND t.norm = w.norm AND t.level = w.level - 1 AND t.via < w.turn),
by_target AS (SELECT conv_id, turn, target, count(*) AS n, sum(m) AS words, min(level) AS low, max(level) AS high FROM linked GROUP BY ALL),
per AS (
  SELECT conv_id, turn, sum(n) AS n_quoted, sum(CASE WHEN target IS NULL THEN 0 ELSE n END) AS n_linked, max(high) AS max_level FROM by_target GROUP BY ALL),
parent AS (
  SELECT conv_id, turn, target AS reply_to FROM by_target WHERE target IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY low, words DESC, target DESC) = 1),
tree AS (
  SELECT DISTINCT conv_id, reply_to AS turn, reply_to AS root, 0 AS depth, [reply_to] AS path FROM parent
  WHERE NOT EXISTS (SELECT 1 FROM parent q WHERE q.conv_id = parent.conv_id AND q.turn = parent.reply_to)
  UNION ALL
  SELECT p.conv_id, p.turn, t.root, t.depth + 1, list_append(t.path, p.turn)
  FROM tree t JOIN parent p ON p.conv_id = t.conv_id AND p.reply_to = t.turn),
place AS (SELECT conv_id, turn, root, depth, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS position FROM tree),
body AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS t FROM parsed WHERE level = 0 GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, coalesce(t.root, c.turn) AS root, CAST(coalesce(t.depth, 0) AS INTEGER) AS depth,
       CAST(coalesce(t.position, 0) AS BIGINT) AS position, p.reply_to,
       CAST(coalesce(q.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(q.n_linked, 0) AS BIGINT) AS n_linked,
       CAST(coalesce(q.max_level, 0) AS INTEGER) AS max_level, sha256(coalesce(b.t, '')) AS text_sha256
FROM conversations c LEFT JOIN place t ON c.conv_id = t.conv_id AND c.turn = t.turn
LEFT JOIN parent p ON c.conv_id = p.conv_id AND c.turn = p.turn LEFT JOIN per q ON c.conv_id = q.conv_id AND c.turn = q.turn
LEFT JOIN body b ON c.conv_id = b.conv_id AND c.turn = b.turn"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES_SQL, "op6_minhash": NEAR_SQL, "op9_quotation_linking": QUOTES_SQL, "op10_substring_dedup": REPEATS_SQL}
