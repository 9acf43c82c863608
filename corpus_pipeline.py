"""The corpus pipeline: each stage reads what the one before kept and wrote.

toxicity -> exact dedup -> n-gram Jaccard join -> mixing -> packing. All stages
but the last return the columns of ``documents``; the last returns the pieces
of the packed sequences.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows and ids, an empty table and columns of any name; what each then gives is
stated in its operator's docstring (``reject_toxic``, ``dedup``, ``one_of_each``,
``mix``, ``pack``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tallyweave.llm.common import keep, owned, release

#: The mixture reads every document at least once and none of them more than this, on average of its source.
MAX_EPOCHS = 1.5


#: Tables that the stages of the last run on a folder keep; each stage's may go once its result is written, which the next stage shows.
_tables: dict[str, list[str]] = {}


def stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = f"{spark.sparkContext.applicationId} {sf_dir}"
        if f.__name__ == STAGES[0][1].__name__:
            _tables[run_of] = []  # a run of its own: what an earlier one on this folder keeps may not have been read yet
        mine = _tables.setdefault(run_of, [])
        release(spark, mine)
        with owned(mine):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the machine learns from the labels that training may see."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact_dedup.dedup(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    return jaccard_join.one_of_each(docs, shingle=5, num=80, den=100)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources again as their weights ask for."""
    return mixing.mix(docs, max_epochs=MAX_EPOCHS).select("row.*")


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a document that the mixture repeats is packed again."""
    return packing.pack(docs).select(*packing.COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = keep(apply(spark, docs, sf_dir), codec="snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
