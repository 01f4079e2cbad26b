"""Which runs may read their upstream result, and what stops the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.plans.skew import attach_group
from tidyledger.session import ensure_checkpoint_dir

# The stage each task type reads, and the stages whose result needs approval.
UPSTREAM = {"transform": "sync", "standardize": "transform", "match": "standardize", "export": "match"}


def gate_report(runs: DataFrame, data_sources: DataFrame | None = None) -> DataFrame:
    """(task_run_id, task_type, source_task_run_id, upstream_status, block_reason); null reason = may run.

    ``runs(organization_id, task_run_id, task_type, source_task_run_id, result_status)``: ``result_status`` is
    the review status of the run's own result, null while there is none. With ``data_sources(id, organization_id,
    is_active)`` a run that names a ``data_source_id`` needs an active one of its own organization; a missing, foreign
    or inactive one is ``source_inactive``, before all other reasons.
    """
    unusable = F.lit(False)
    if data_sources is not None:
        usable = data_sources.where("is_active").select(
            "organization_id", F.col("id").alias("data_source_id"), F.lit(True).alias("_usable")
        )
        runs = runs.join(usable.distinct(), ["organization_id", "data_source_id"], "left")
        unusable = F.col("data_source_id").isNotNull() & F.col("_usable").isNull()
    wants = F.lit(None).cast("string")
    for kind, source in UPSTREAM.items():
        wants = F.when(F.col("task_type") == kind, F.lit(source)).otherwise(wants)
    upstream = runs.select(
        F.col("task_run_id").alias("source_task_run_id"),
        "organization_id",
        F.col("task_type").alias("upstream_type"),
        F.col("result_status").alias("upstream_status"),
    )
    joined = runs.withColumn("wants", wants).join(upstream, ["organization_id", "source_task_run_id"], "left")
    source = F.col("source_task_run_id")
    reason = (
        F.when(unusable, "source_inactive")
        .when(F.col("wants").isNull() & source.isNotNull(), "source_not_allowed")
        .when(F.col("wants").isNull(), F.lit(None).cast("string"))
        .when(source.isNull(), "source_required")
        .when(F.col("upstream_type").isNull(), "source_not_found")
        .when(F.col("upstream_type") != F.col("wants"), "source_wrong_type")
        .when(F.col("upstream_status").isNull(), "source_has_no_result")
        .when((F.col("wants") != "sync") & (F.col("upstream_status") != "approved"), "source_not_approved")
    )
    return joined.select(
        "organization_id", "task_run_id", "task_type", "source_task_run_id", "upstream_status",
        reason.alias("block_reason"),
    )


def approved_inputs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs whose source result exists in the same tenant and is approved."""
    good = results.where("status = 'approved'").select("organization_id", F.col("task_run_id").alias("source_task_run_id"))
    return runs.join(good, ["organization_id", "source_task_run_id"], "left_semi")


def chain(runs: DataFrame, depth: int = 4) -> DataFrame:
    """Each run with the ids of its upstream runs, nearest first, as far as ``depth`` steps."""
    links = runs.select("organization_id", "task_run_id", "source_task_run_id")
    up = links.where(F.col("source_task_run_id").isNotNull())
    out, ended = links.withColumnRenamed("source_task_run_id", "up1"), None
    for step in range(1, depth):
        # Runs at their root carry a null from here on; they stay out of the shuffle, where null would be one hot key.
        done = out.where(F.col(f"up{step}").isNull()).withColumn(f"up{step + 1}", F.lit(None).cast("string"))
        ended = done if ended is None else ended.withColumn(f"up{step + 1}", F.lit(None).cast("string")).unionByName(done)
        parent = up.select(
            "organization_id",
            F.col("task_run_id").alias(f"up{step}"),
            F.col("source_task_run_id").alias(f"up{step + 1}"),
        )
        out = out.where(F.col(f"up{step}").isNotNull()).join(parent, ["organization_id", f"up{step}"], "left")
    out = out if ended is None else out.unionByName(ended)
    return out.select("organization_id", "task_run_id", *[f"up{i}" for i in range(1, depth + 1)])


def roots(runs: DataFrame) -> DataFrame:
    """(organization_id, task_run_id, root_run_id, depth) of every run, over chains of any length.

    ``depth`` is the number of steps up to the root: a run without source, or whose source is no run of its
    organization. Runs on a cycle, or behind one, have neither. Task run ids are unique within an organization.

    Pointers double: each round joins a run's furthest known ancestor with that run's own, so chains of length n take
    log2(n) rounds. Round k closes the runs between 2^(k-1) and 2^k steps from their root. Any chain beyond that has runs
    in between, so once a round closes none, all runs left are on or behind a cycle, however many runs there are. Only
    runs that have a source take part; those at their root drop out. Rounds are checkpointed; an ancestor of very many
    runs is attached by broadcast.
    """
    ensure_checkpoint_dir(runs.sparkSession)
    run = ["organization_id", "task_run_id"]
    known = runs.select(*run, "source_task_run_id")
    exists = known.select("organization_id", F.col("task_run_id").alias("source_task_run_id"))
    linked = known.where(F.col("source_task_run_id").isNotNull()).join(
        exists, ["organization_id", "source_task_run_id"], "left_semi"
    )
    steps = F.lit(1).cast("long").alias("depth")
    pointers = linked.select(*run, F.col("source_task_run_id").alias("root_run_id"), steps).checkpoint()
    open_runs, closed = pointers, None
    while True:
        sizes = open_runs.groupBy("organization_id", "root_run_id").agg(F.count(F.lit(1)).alias("_n"))
        further = pointers.select(
            "organization_id", F.col("task_run_id").alias("root_run_id"), F.col("root_run_id").alias("_root"),
            F.col("depth").alias("_depth"),
        )
        keys = ["organization_id", "root_run_id"]
        met = attach_group(open_runs, sizes.join(further, keys, "left"), keys, "_n").checkpoint()
        at_root = met.where(F.col("_root").isNull()).select(*run, "root_run_id", "depth")
        moved = met.where(F.col("_root").isNotNull())
        open_runs = moved.select(*run, F.col("_root").alias("root_run_id"), (F.col("depth") + F.col("_depth")).alias("depth"))
        closed = at_root if closed is None else closed.unionByName(at_root)
        if moved.isEmpty() or at_root.isEmpty():
            break
        pointers = open_runs.unionByName(closed)
    done = closed.unionByName(
        open_runs.select(*run, F.lit(None).cast(dict(pointers.dtypes)["root_run_id"]).alias("root_run_id"),
                         F.lit(None).cast("long").alias("depth"))
    )
    own = known.join(done.select(*run), run, "left_anti")
    return done.unionByName(own.select(*run, F.col("task_run_id").alias("root_run_id"), F.lit(0).cast("long").alias("depth")))
