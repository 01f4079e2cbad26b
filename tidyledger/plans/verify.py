"""Integrity of stored outputs against their recorded digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def downloadable(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("approved", "rolled_back"))


def verify_outputs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, outcome, failure_reason_code) per downloadable run.

    ``files(path, sha256)`` is a listing with digests computed by Spark: ``sources.csv.manifest``, or for files of any
    size the digest of ``sources.csv.fingerprints`` under that name, if the runs recorded that one.
    """
    found = files.select(F.col("path").alias("output_file_path"), F.col("sha256").alias("_found"))
    checked = downloadable(runs).join(found, "output_file_path", "left")
    gone = F.col("output_deleted_at").isNotNull()
    missing = F.col("_found").isNull()
    broken = F.col("_found") != F.col("output_sha256")
    return checked.select(
        F.col("id").alias("run_id"),
        F.when(gone, "purged").when(missing, "file_missing").when(broken, "integrity_failed").otherwise("completed")
        .alias("outcome"),
        F.when(gone, F.lit(None).cast("string")).when(missing, "file_not_found").when(broken, "hash_mismatch")
        .alias("failure_reason_code"),
    )
