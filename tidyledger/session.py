"""Session construction and the runtime settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings only, so they can also be applied to a session that a cluster hands us.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a skewed join partition is worth an extra shuffle behind it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never JIT-compiles methods above 8000 bytes; beyond that Spark's split projections are faster
    # than one fused method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tidyledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # Checkpoints go when the frames that read them are gone.
    cleaned = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**RUNTIME_CONF, **cleaned, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; where none is set, one in the warehouse, which is shared as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
