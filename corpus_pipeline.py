"""Corpus pipeline: toxic texts, exact and near copies and benchmark text go, the rest is packed.

Each stage reads what the one before it kept. ``run`` writes every stage's rows as Parquet in
the shared folder and reads them back for the next; whoever calls the stages one by one does
the same. A stage therefore deletes the working tables that the stage before it left.

Defined results: a stage keeps or drops whole rows and leaves all columns as they are, null
values, repeated rows and further columns included; an empty table stays empty. The toxicity
model is fitted on the rows of the stage's own input that have labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brickyard.llm import catalog, exact, jaccard, packing, phrases, toxicity
from brickyard.llm.common import release, scope, stage, table

_LEFT: list[list[str]] = []


def _working(spark: SparkSession, first: bool, make: Callable[[], DataFrame]) -> DataFrame:
    """Run a stage; delete the working tables of the one before it, whose rows are saved."""
    before = _LEFT.pop() if _LEFT else []
    if not first:
        release(spark, before)
    with scope() as own:
        out = make()
    _LEFT.append(own)
    return out


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of a toxic grade is at least one half."""
    return _working(spark, True, lambda: toxicity.without_toxic(
        docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, white space aside."""
    return _working(spark, False, lambda: exact.without_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of similar documents."""
    return _working(spark, False, lambda: jaccard.without_near_duplicates(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item."""
    return _working(spark, False, lambda: phrases.without_contaminated(
        docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into training sequences; one row per piece."""
    return _working(spark, False, lambda: packing.pack(docs, catalog.BYTE_VOCABULARY))


STAGES = [("toxicity", keep_civil), ("exact dedup", drop_copies),
          ("near duplicates", drop_near_copies), ("decontamination", drop_benchmark),
          ("packing", pack)]

# A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
