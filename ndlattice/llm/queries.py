"""One query for each training-data operator, over its whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html_extraction, language_id, licenses, ngram_join, packing, quality, secrets, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.learn(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("row")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def contract_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fingerprints: lengths and edited texts."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def contract_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every document, and that texts without a letter, and only they, have no language."""
    return op6_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"), F.col("score").between(0, 1).alias("sound"))


def contract_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base patterns, and how many base spans the whole list holds."""
    kept = F.size(F.filter(F.split("spans", ","), lambda x: ~x.startswith("crf:") & (x != ""))).cast("long")
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", kept.alias("n_base"))


def contract_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and places of the base phrases."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def contract_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every document, and that predictions follow the scores."""
    return op10_toxicity(spark, sf_dir).select("doc_id", "held_out", (F.col("predicted") == (F.col("score") >= 0.3).cast("int")).alias("sound"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontamination, op3_html_extraction, op4_fingerprints, op5_ngram_join, op6_language_id, op7_best_fit_packing, op8_secret_scan, op9_license_scan, op10_toxicity, contract_op4, contract_op6, contract_op8, contract_op9, contract_op10)}

#: Fixed reflected polynomial of crc32; the digits of an id go through it bit by bit.
_CRC = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
_HELD = f"{_CRC} % 4 = 2 AS held_out"
_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "contract_op4": "SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(coalesce(after, first), 1, length(t) // 3)) AS edited_sha256 FROM (SELECT doc_id, t, lead(t) OVER (ORDER BY doc_id DESC) AS after, first_value(t) OVER (ORDER BY doc_id DESC) AS first FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "contract_op6": f"SELECT doc_id, {_HELD}, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS und, true AS sound FROM documents",
    "contract_op8": f"SELECT doc_id, n_assign, n_access, n_hex, n_assign + n_access + n_hex AS n_base FROM (SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign, CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "contract_op9": f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
     p AS (SELECT *, list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit, list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache, list_filter(range(0, len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, list_min(list_concat(mit, apache, gpl)) AS first_word, list_max(list_concat(mit, apache, gpl)) AS last_word,
       array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p""",
    "contract_op10": f"SELECT doc_id, {_HELD}, true AS sound FROM documents",
    "op5_ngram_join": """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
     g AS (SELECT doc_id, text, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS grams FROM w),
     k AS (SELECT *, md5(array_to_string(grams, '|')) AS node FROM g),
     n AS (SELECT node, min(doc_id) AS copy_of, count(*) AS n_copies, count(DISTINCT text) AS n_texts, len(any_value(grams)) AS size, any_value(grams) AS grams FROM k GROUP BY node),
     s AS (SELECT node, size, unnest(grams) AS gram FROM n),
     p AS (SELECT a.node AS one, b.node AS two FROM s a JOIN s b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
     r(node, label) AS (SELECT node, node FROM n UNION SELECT p.two, r.label FROM r JOIN p ON p.one = r.node),
     c AS (SELECT r.node, min(n.copy_of) AS class_id FROM r JOIN n ON n.node = r.label GROUP BY r.node),
     l AS (SELECT p.one AS node, sum(n.n_texts) AS linked FROM p JOIN n ON n.node = p.two GROUP BY p.one)
SELECT k.doc_id, c.class_id, n.copy_of, CAST(n.n_copies AS BIGINT) AS n_copies, CAST(n.n_texts AS INTEGER) AS n_texts, CAST(CASE WHEN n.size = 0 THEN 0 ELSE coalesce(l.linked, 0) + n.n_texts - 1 END AS BIGINT) AS n_links, k.doc_id = c.class_id AS keep
FROM k JOIN n ON n.node = k.node JOIN c ON c.node = k.node LEFT JOIN l ON l.node = k.node""",
}
