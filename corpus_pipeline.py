"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of documents. Nulls, empty texts, repeated rows, extra
columns and empty tables are treated as each operator's docstring says:

* quality rules drop documents that they reject; null, empty and short texts are kept;
* SimHash near-dedup keeps one row of each group, that of the least doc_id; texts without words are kept;
* substring dedup takes out passages that stand in an earlier document; the rows stay;
* decontamination drops documents that hold a benchmark item;
* BPE encoding returns doc_id, token_ids, n_tokens, round_trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import bpe, decontaminate, quality, simhash, substring
from ravelin.llm.shared import checkpoint_dir, drop_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encode_decode", bpe_tokens),
]

#: Near-dedup and BPE can't be said in SQL; the tests hold every stage against brute force.
ORACLE_SQL: str | None = None


#: Numbers the folders of runs within one application.
_RUNS = iter(range(1 << 62))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written as Parquet to the shared folder and read again.

    A stage's rows are deleted when those of the next are written; the last ones stay, as the result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = checkpoint_dir(spark)
    before = None
    for name, stage in STAGES[:-1]:
        at = f"{folder}/pipeline-{spark.sparkContext.applicationId}-{next(_RUNS)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_folder(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
