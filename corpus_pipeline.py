"""A training corpus pipeline: STAGES of (name, function), each function (spark, docs, sf_dir) -> DataFrame.

Every stage is written as Parquet and read again as the next one's docs; all stages return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, line_dedup, mixing, near_dedup, quality
from marlstone.llm.common import shared_folder, table

#: Some stages have no SQL form (fitted model, sketches); each is tested against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged.

    Null and empty texts are scored as empty; repeated rows are judged alike; other columns pass; an empty table stays
    empty, and without labels every document is accepted.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; a document that loses all its words goes.

    Documents that lose nothing are unchanged, null and empty texts included; repeated rows count as one document when
    they share an id; n_chars, if there, follows the text; other columns pass; an empty table stays empty.
    """
    got = line_dedup.dedup(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("row.text"))
    left = got.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars"))}
    return left.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id.

    Null texts and null ids are never duplicates; empty texts are copies of each other; rows that share the smallest id
    all stay; other columns pass; an empty table stays empty.
    """
    return near_dedup.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items go; so do documents that mostly consist of them.

    Null and empty texts and clean documents are unchanged; repeated rows are judged one by one; n_chars, if there,
    follows the text; other columns pass; an empty table or benchmark changes nothing.
    """
    got = decontamination.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks.

    Null is a source of its own; null and empty texts have size 0 and are drawn like others; rows that share an id are
    drawn alike; other columns pass; an empty table stays empty.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order; each is written below spark.checkpoint.dir and read again."""
    out, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
