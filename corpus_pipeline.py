"""Training corpus from the documents table: rejects, copies and leaked benchmark texts go, the rest is packed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm import decontaminate, exact, packing, quality, simhash
from tidyledger.llm.cells import cut
from tidyledger.llm.queries import GOOD, quality_model
from tidyledger.session import ensure_checkpoint_dir, tune

NUMBER = "_pipeline_row"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# No SQL can express the classifier's or the packing's stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a number per row, and its name: one that no column has.

    Numbered rows are stored, so the operator and the choice by its result see the same numbers. No hash of any length
    stands for a document, hence none is lost to one.
    """
    name = NUMBER
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def _chosen(docs: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """Rows of numbered documents whose number is among the operator's ``row_key``."""
    return docs.join(keys.select(F.col("row_key").alias(name)), name, "left_semi").drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of documents at this stage."""
    model = quality_model(spark, docs, sf_dir)
    return docs.where(quality.probability(F.col("text"), model) >= GOOD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    docs, name = _numbered(docs)
    found = exact.exact_duplicates(docs, "text", "doc_id", name)
    return _chosen(docs, name, found.where("is_canonical"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by operator 6's radius: most pairs from similarity 0.95 on."""
    docs, name = _numbered(docs)
    found = simhash.near_duplicates(docs, "text", "doc_id", name)
    return _chosen(docs, name, found.where("is_canonical"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote ten or more words in a row of a benchmark item go."""
    docs, name = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated_cells(docs, items, "text", "text", "doc_id", "item_id", name)
    return _chosen(docs, name, found.where(F.size("spans") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.packed_cells(docs, "text", path, "doc_id", added=True)
    return found.withColumnRenamed("row_index", "doc_id").drop("row_key")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("sum_of_squares_packing", packed),
]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is stored in the shared folder and read again.

    A stage's result goes once that of the next one is stored; that of the last stored stage stays, as the returned
    frame reads it. Documents without text count as empty ones: they are judged by their score, the copies among them
    are dropped, and the one that is left is packed as an end mark alone. Documents without doc_id are kept as all
    others, but have no label. Rows that repeat a document are copies of it. Other columns pass unchanged through all
    stages but the last, whatever their names. An empty table gives no rows.
    """
    tune(spark)
    ensure_checkpoint_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
