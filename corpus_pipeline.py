"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and
gives a DataFrame that ``run`` writes as Parquet and reads again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.  Null texts count as empty texts
throughout; an empty table passes every stage; the operators' docstrings say what becomes of
ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusweave import ship_package
from corpusweave.llm.decontaminate import decontaminate
from corpusweave.llm.packing import pack_documents
from corpusweave.llm.quality import drop_low_quality, fit_quality
from corpusweave.llm.simhash import simhash_dedup
from corpusweave.llm.toxicity import drop_toxic, fit_toxicity
from corpusweave.plans.staging import default_root, remove, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ready(spark: SparkSession) -> None:
    """The package on the executors, and on a single machine a folder for written tables."""
    default_root(spark)
    ship_package(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay."""
    _ready(spark)
    return drop_toxic(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold stay."""
    _ready(spark)
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return drop_low_quality(docs, spark.sparkContext.broadcast(model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: fingerprints of three-word shingles
    that differ in at most three bits."""
    _ready(spark)
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay."""
    _ready(spark)
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    _ready(spark)
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned models, XXH64 and tokenizer ids are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables between them only the last one stays."""
    _ready(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        before, docs = docs, stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
        remove(before)
    return docs
