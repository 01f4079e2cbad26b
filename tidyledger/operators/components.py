"""Connected components of duplicate links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.plans.skew import attach_group
from tidyledger.session import ensure_checkpoint_dir


FOREST_LINKS = 1_000_000  # links that a task holds before it passes its forest on


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links and the lowest member of the component of each."""
    nodes, position = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = position[: len(a)], position[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(after, end, low)
        after = after[after]
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def _roots(links: pd.DataFrame) -> pd.DataFrame:
    """Lowest member of each component of the links of whole blocks."""
    nodes, roots = _forest(links["rep"].to_numpy(), links["head"].to_numpy())
    # Blocks share no node, so a node's block is that of any of its links.
    ends = np.concatenate([links["rep"].to_numpy(), links["head"].to_numpy()])
    _, first = np.unique(ends, return_index=True)
    blocks = links["block_key"].to_numpy()
    return pd.DataFrame({"rep": nodes, "block_key": blocks[first % len(links)], "canonical": roots})


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links of the components within a task: at most one link per node of what it holds at a time."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch["a"].to_numpy()])
        b = np.concatenate([b, batch["b"].to_numpy()])
        if len(a) > FOREST_LINKS:
            nodes, roots = _forest(a, b)
            inner = nodes != roots
            a, b = nodes[inner], roots[inner]
            if len(a) > FOREST_LINKS // 2:  # a forest that does not shrink goes on to the rounds
                yield pd.DataFrame({"u": a, "v": b})
                a, b = a[:0], b[:0]
    nodes, roots = _forest(a, b)
    inner = nodes != roots
    yield pd.DataFrame({"u": nodes[inner], "v": roots[inner]})


def _per_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by block; the last block of a batch waits for the rest of it."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        is_last = batch["block_key"] == batch["block_key"].iloc[-1]
        if not is_last.all():
            yield _roots(pd.concat([*waiting, batch[~is_last]]))
            waiting = []
        elif waiting and waiting[-1]["block_key"].iloc[-1] != batch["block_key"].iloc[-1]:
            yield _roots(pd.concat(waiting))
            waiting = []
        waiting.append(batch[is_last])
    if waiting:
        yield _roots(pd.concat(waiting))


def components_by_block(edges: DataFrame) -> DataFrame:
    """(rep, block_key, canonical) where no component leaves its block and blocks are capped in size.

    Spark brings the links of a block together and sorts them; a task holds one Arrow batch and one block.
    """
    # By a column that nothing below is partitioned by: a shuffle on the key itself may be left out as done already,
    # and what stands in for it is then read in other partitions, as no operator here states that it needs them.
    part = F.xxhash64("block_key").alias("_part")
    gathered = edges.select("rep", "head", "block_key", part).repartition("_part").sortWithinPartitions("block_key")
    return gathered.mapInPandas(_per_block, "rep bigint, block_key string, canonical bigint")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for edges (a, b) of any shape and size: root is the lowest node of the component.

    Every task first reduces its own links to a forest, so that only components which leave their task take rounds of
    two star rewrites. Those end when a count of the nodes that are not yet next to their root is zero. Every round is
    checkpointed, so a lost executor never replays the rounds before; nodes with very many neighbours are spread by
    ``attach_group``.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    linked = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    current = linked.mapInPandas(_local_forests, "u bigint, v bigint").distinct().checkpoint()
    for _ in range(max_rounds):
        if not _unsettled(current):
            break
        current = _small_star(_large_star(current)).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)


def _unsettled(edges: DataFrame) -> int:
    """Nodes with several lower neighbours, or with a lower one while they are one themselves; stars have none."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("upper")),
    )))
    nodes = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"))
    return nodes.agg(F.count_if(F.expr("lower > 1 or (lower = 1 and upper = 1)"))).first()[0]


def _lowest(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the lowest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _lowest(both).withColumn("m", F.least("m", "u"))
    tied = attach_group(both, lowest, "u", "n")
    return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the lowest of them."""
    tied = attach_group(edges, _lowest(edges), "u", "n")
    moved = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = tied.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()
