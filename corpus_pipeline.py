"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but
the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet
into the shared folder, rereads them as the next one's input, and removes the stage's
intermediate tables. A stage that is called by itself removes those of earlier calls that
no DataFrame reads any more.

Null and empty texts are neither rejected nor scored toxic; as copies of one another one
of them stays, and it is packed as its end alone. Texts in a language without trusted
documents, and all texts where there are no labels, pass the quality stage. Rows with a
null doc_id pass the near-duplicate and passage stages unchanged; of rows that share a
doc_id one stays. Very long texts are read whole. Ties between copies go to the smallest
doc_id. Extra columns, whatever their names, are kept to the last stage. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraflux.llm import packing, quality, similar, substrings, toxicity
from terraflux.llm.common import Written, load, materialise, recorded, remove
from terraflux.session import ship


#: Intermediate tables of stages called so far, by application.
_WRITTEN: dict[str, list[Written]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the package has been sent to the executors and tables that nothing reads any more have been removed."""
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
        gone = [t for t in held if t.unread()]
        remove(spark, gone)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        held[:] = [t for t in held if t not in gone] + made
        return out

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under the trusted text's model is over their language's threshold."""
    return quality.accept(docs, load(spark, sf_dir, "labels"))


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic."""
    return toxicity.accept(docs, load(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return similar.deduplicate(docs, similarity=0.8, words_per_shingle=5)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document with a smaller id holds too."""
    return substrings.deduplicate(docs, span=50)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2,048 tokens."""
    return packing.pack(docs, capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_classifier),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packing_stage),
]

#: The trained stages and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    ship(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = materialise(stage.__wrapped__(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, made[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
