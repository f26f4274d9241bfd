"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrina.llm import chat, decontaminate, licenses, mixing, page_text, quality, simhash, token_counts, token_files, toxicity
from vitrina.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
#: Folder of the public tokenizer files; empty: the installed package's own.
TOKENIZER_DIR = ""


def tokenizer_path(name: str, folder: str | None = None) -> str:
    folder = TOKENIZER_DIR if folder is None else folder
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary).select("doc_id", "n_tokens")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(read_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files.contract(read_table(spark, sf_dir, "documents"), f.read())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.contract(read_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.contract(turns.unionByName(planted))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.contract(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_quality_rules, op2_toxicity, op3_token_counts, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_token_files, op7_mixing, op8_license_scan, op9_chat_formatting, op10_page_text, pipeline]
    return {f.__name__: f for f in found}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(text, '<(\\*)(/?turn>|part>)', '<\\\1\2', 'g')) AS n_text,
    length(role) + length(role) - length(replace(replace(role, '\', ''), chr(10), '')) AS n_role,
    lag(role) OVER o IS NOT DISTINCT FROM role AS joins, lead(role) OVER o IS NOT DISTINCT FROM role AS goes_on
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN joins THEN 6 ELSE 7 + n_role END + CASE WHEN goes_on THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle_sql(), "op4_benchmark_decontamination": OP4_SQL, "op8_license_scan": licenses.oracle_sql(), "op9_chat_formatting": OP9_SQL}
