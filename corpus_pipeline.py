"""The corpus pipeline: documents without toxic texts, near-duplicates and benchmark passages, mixed
to target weights and written as token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is a Parquet table.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vitrina.llm import decontaminate, mixing, simhash, token_files, toxicity
from vitrina.llm.common import read_table, scratch, shared_dir
from vitrina.llm.queries import tokenizer_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up at least a twentieth go; passages of more than 50 words are cut out of the others."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small languages are repeated up to the target weights; the total is chosen so that none shrinks, and every document stays."""
    labelled = mixing.language_labels(docs, read_table(spark, sf_dir, "labels"))
    rates, _, _, _ = mixing.mix(docs, labelled, power=0.7, scale_to_keep=1.05)
    return mixing.draw(docs, rates, least=1)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder; what is returned is read back from them."""
    path = f"{shared_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_files.write_token_files(docs, f.read(), path)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_languages),
    ("token_files", write_tokens),
]
#: None of the first stages can be written in SQL (nearest examples, fingerprints, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
