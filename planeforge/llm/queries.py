"""The operators' queries over whole tables, and their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, language, lines, media, packing, secrets, sharding, simhash, toxicity
from .common import id_crc, table


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(language.training_rows(docs))
    held = F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out")
    return language.predict_languages(docs, model).select("doc_id", held, "lang_pred", "score")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("lines_dropped").cast("long"), F.col("lines_kept").cast("long"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_vector_packing, op2_signature_sniffing, op3_language_id, op4_prefix_bpe, op5_toxicity, op6_line_templates, op7_secret_scan, op8_simhash, op9_exact_dedup, op10_hilbert_shards, pipeline)
    return {f.__name__: f for f in found}


_OP9 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, (d.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, 1 + len(string_split(t, chr(10))))) AS pos FROM d),
w AS (SELECT doc_id, pos, line, list_transform(string_split(trim(translate(line, chr(9) || chr(13), '  ')), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ws FROM l),
m AS MATERIALIZED (SELECT doc_id, pos, line, array_to_string(ws, ' ') AS masked, len(ws) AS width, ws[1:3] AS lead3 FROM w),
e AS MATERIALIZED (SELECT DISTINCT doc_id, masked, width, lead3 FROM m WHERE masked <> ''),
leaf AS MATERIALIZED (SELECT width, lead3, list(DISTINCT masked) AS members FROM e WHERE width >= 5 GROUP BY width, lead3 HAVING count(DISTINCT masked) > 1),
sorted AS (SELECT width, list_transform(list_sort(list_transform(members, lambda x: md5(x) || x)), lambda x: [string_split(x[33:], ' ')]) AS rows FROM leaf),
leads AS MATERIALIZED (SELECT rows, list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: list_sum(list_transform(list_zip(y, x[1]), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) >= ceil(width * 0.8))) > 0 THEN acc ELSE list_concat(acc, x) END) AS leads, width FROM sorted),
under AS MATERIALIZED (SELECT array_to_string(r[1], ' ') AS masked, array_to_string(list_filter(leads, lambda y: list_sum(list_transform(list_zip(y, r[1]), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) >= ceil(width * 0.8))[1], ' ') AS template
      FROM (SELECT unnest(rows) AS r, leads, width FROM leads)),
t AS MATERIALIZED (SELECT e.doc_id, e.masked, coalesce(under.template, e.masked) AS template FROM e LEFT JOIN under USING (masked)),
r AS (SELECT template, min(doc_id) AS first_doc FROM t GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT DISTINCT t.doc_id, t.masked FROM t JOIN r USING (template) WHERE t.doc_id <> r.first_doc)
SELECT m.doc_id, coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE g.masked IS NULL), '') AS text,
       count(g.masked)::BIGINT AS lines_dropped, (count(*) - count(g.masked))::BIGINT AS lines_kept
FROM m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.masked = g.masked
GROUP BY m.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_templates": _OP6, "op9_exact_dedup": _OP9}
