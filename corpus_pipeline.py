"""The corpus pipeline: stages that each take what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontaminate, ngram_join, secrets, toxicity, unigram
from tamarack.llm.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that are broadcast at most (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``; those without an id stay."""
    ids = Workspace(spark, "dropped").save(ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.select(*COLUMNS).join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; the model is learned from ``labels``."""
    model = toxicity.learn(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Rows without an id stay, as nothing tells them apart; rows that repeat an id stay together.
    """
    return _without(spark, docs, ngram_join.link(spark, docs).where("doc_id <> component_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _without(spark, docs, decontaminate.contaminated(spark, docs, _table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' values in the texts are replaced; all documents stay and ``n_chars`` follows the text."""
    masked = secrets.redacted(spark, docs.select(*COLUMNS), secrets.learn(spark, docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text again."""
    return unigram.round_tripped(spark, docs).select("doc_id", "n_pieces", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs


#: The toxicity model and the edit budgets are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None
