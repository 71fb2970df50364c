"""The corpus pipeline: quality rules, near-duplicates, repeated passages,
benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.

Defined cases are those of the operators: null and empty texts fail the quality rules;
of repeated rows one stays; an empty table gives an empty result of the same columns;
columns of any other name pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, near, packing, quality, substring
from tidewell.plans.scratch import materialize

#: Words of a repeated passage; shorter repeats stay.
PASSAGE = 50
#: Chunks that a packing worker keeps; workers share their executor with what earlier stages left.
CHUNKS = 150_000


#: Rows that a Python worker gets at once; documents may be long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    """A stage whose result, which the caller writes, is made in small Arrow batches."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, "1000")
        return function(spark, docs, sf_dir)

    run.__doc__, run.__name__ = function.__doc__, function.__name__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and, on failing hosts, the soft rules."""
    return quality.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near.keep_one_of_each(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place already holds."""
    return substring.without_repeats(docs, window=PASSAGE)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=CHUNKS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("packing", packed),
]

#: XXH64 fingerprints and token ids have no DuckDB expression; tests/llm checks
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
