"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from tickflow.llm.queries import table, tokenizer_path
from tickflow.runtime import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose score reaches the threshold of their language."""
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that they share with an earlier document they overlap; `n_chars` follows.

    Documents stay, also those that nothing is left of: the next stage keeps one of them.
    """
    found = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("__n_removed") > 0, length).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates its smallest id stays; rows without an id all stay.

    Rows that repeat the id that stays are one document: the one with the smallest text stays, so a task that runs
    again keeps the same one.
    """
    classes = near_dedup.near_duplicates(docs)
    stays = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__id"))
    kept = (docs.join(stays, F.col("doc_id").cast("long") == F.col("__id"), "left_semi").groupBy("doc_id")
            .agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
            .select("row.*"))
    return kept.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The trained classifier has no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every other one is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
