"""The queries of the thirteen operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, exact_dedup, html_text, license_scan, line_dedup, mixing, periodic_runs, prefix_trie, simhash, tokens, toxicity

#: The tokenizer file of the token counts and of the chat budget.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(_read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(turns.unionByName(chat.probe_conversation(spark)), tokenizer_path()))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_report(periodic_runs.with_periods(_read(spark, sf_dir, "documents")))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_simhash,
            op3_html_text,
            op4_toxicity,
            op5_decontamination,
            op6_line_dedup,
            op7_mixing,
            op8_exact_dedup,
            op9_chat_format,
            op10_license_scan,
            op11_periodic_runs,
            op12_bpe_round_trip,
            op13_prefix_trie,
        )
    }


DECONTAMINATION_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) <= 10 THEN w ELSE list_slice(w, i, i + 9) END AS win
  FROM item, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), n AS (SELECT DISTINCT len(win) AS n FROM win), place AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM doc, n, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), hit AS (
  SELECT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win USING (win)
), words AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, CAST(COALESCE(len(items), 0) AS BIGINT) AS n_items,
       sha256(COALESCE(array_to_string(items, ','), '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_SQL = r"""
WITH line AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS l, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS i FROM documents)
), many AS (
  SELECT key, MAX(doc_id) AS keep FROM line WHERE length(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3
), told AS (
  SELECT line.*, many.key IS NOT NULL AND keep <> doc_id AS dropped FROM line LEFT JOIN many ON line.key = many.key
)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (dropped) AS n_dropped,
       sha256(COALESCE(string_agg(l, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": DECONTAMINATION_SQL,
        "op6_line_dedup": LINE_SQL,
        "op7_mixing": mixing.MIX_SQL.format(docs="documents"),
        "op8_exact_dedup": exact_dedup.EXACT_SQL,
        "op13_prefix_trie": prefix_trie.TRIE_SQL,
    }
