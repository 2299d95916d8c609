"""The corpus pipeline: documents in, cleaned and tokenised documents out.

Each stage works on everything its predecessor kept and its decisions take
effect; the runner writes each stage's result as Parquet and hands the reread
table to the next one.

1. ``toxicity``: trained on the labelled documents among its input, drops what
   reaches its language's threshold.
2. ``near_dedup``: one document of every group of near duplicates (similarity of
   the sets of five-word shingles at least ``NEAR``) stays.
3. ``decontaminate``: documents in which a benchmark window occurs go.
4. ``pii``: entities in the texts are replaced by surrogates.
5. ``tokens``: adds ``n_tokens``, ``ids`` (packed 32-bit little-endian) and
   ``round_trip`` to the columns of documents.

Stages keep rows with null texts or ids: a null text is neither toxic nor a
duplicate nor contaminated; a null id is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medlake.llm import byte_bpe, decontaminate, near_dedup, pii, toxicity
from medlake.llm.common import landed, read_table

#: Threshold of the near_dedup stage; that of the op4 query is its own.
NEAR = (80, 100)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup_keep(docs, limit=NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.drop_pii(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.with_tokens(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("tokens", tokens_stage),
]

#: A trained classifier and surrogate texts are not expressible in SQL; the
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
