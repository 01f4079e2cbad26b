"""Near duplicates of a cell by 64-bit SimHash, compared exactly tile by tile."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.cells import KEY, ROW, cut, first_row, keyed
from tidyledger.operators.components import connected_components

BITS = 64
SEED = 42
SLICE = 65_536  # shingles hashed at a time
TILE = 512  # fingerprints on a side of a comparison
BUCKET = 4_096  # fingerprints that one task compares at a time; larger buckets are cut into tiles before


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of all shingles of ``words`` words of a UTF-8 text, as an unsigned number; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        after = np.cumsum(sizes + 1)
        starts = np.concatenate([[0], after])[: len(found) - words + 1].tolist()
        ends = (after - 1)[words - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        spans = zip(starts[at : at + SLICE], ends[at : at + SLICE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], [KEY, ROW, "print"])

    return run


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per node that connects what the links (a, b) connect: to the lowest node reached."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    lowest = np.arange(len(nodes))
    while True:
        low = np.minimum(lowest[left], lowest[right])
        after = lowest.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, lowest):
            moved = lowest != np.arange(len(nodes))
            return nodes[moved], nodes[lowest[moved]]
        lowest = after


def near(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints within ``radius`` bits, of one set or between two.

    Fingerprints are ordered by their number of ones and cut into tiles. Two tiles whose numbers of ones are
    further apart than the radius hold no pair and are skipped; all others are compared bit by bit.
    """
    inner = right is None
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if inner else right[np.argsort(np.bitwise_count(right), kind="stable")]
    ones_l, ones_r = np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(left), TILE):
        rows = left[i : i + TILE]
        low, high = ones_l[i], ones_l[i + len(rows) - 1]
        for j in range(i if inner else 0, len(right), TILE):
            cols = right[j : j + TILE]
            if ones_r[j] > high + radius:
                break
            if ones_r[j + len(cols) - 1] < low - radius:
                continue
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
            apart = rows[x] != cols[y]
            if apart.any():
                found.append(_stars(rows[x[apart]], cols[y[apart]]))
    if not found:
        return left[:0], left[:0]
    return _stars(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _compare(radius: int):
    def run(work: pd.DataFrame) -> pd.DataFrame:
        work = work.sort_values("bucket", kind="stable")
        buckets = work["bucket"].to_numpy()
        prints = work["print"].to_numpy().view(np.uint64)
        side = work["side"].to_numpy()
        edges = np.flatnonzero(np.diff(buckets)) + 1
        found = []
        for a, b in itertools.pairwise([0, *edges.tolist(), len(buckets)]):
            if b - a < 2:
                continue
            own, where = prints[a:b], side[a:b]
            pair = near(own[where == 1], own[where == 2], radius) if where.any() else near(own, None, radius)
            if len(pair[0]):
                found.append(pair)
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` runs of neighbouring bits that make up a fingerprint."""
    bounds = [BITS * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(bounds)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(prints: int, radius: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under at least one of them.

    Of ``radius + extra`` blocks at most ``radius`` differ, so ``extra`` agree. More blocks make longer masks;
    the first that spread this many fingerprints thinly enough are taken. Any choice finds the same pairs.
    """
    for extra in range(1, 5):
        blocks = _blocks(radius + extra)
        if prints >> (extra * (BITS // (radius + extra))) < 256:
            break
    return [_signed(sum(chosen)) for chosen in itertools.combinations(blocks, extra)]


def links(prints: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b) that connect all distinct fingerprints (column ``print``) within ``radius`` bits of each other.

    Fingerprints meet in buckets that agree under a mask. Whole buckets are compared many to a task; one above
    ``bucket`` fingerprints is cut into tiles by number of ones, and only tile pairs within the radius are compared,
    each as its own piece of work. A piece returns at most one link per fingerprint, never all pairs.
    """
    masks = _masks(prints.count(), radius)
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask")) for i, m in enumerate(masks)]))
    keys = prints.select("print", spread.alias("m")).select(
        "print", F.xxhash64("m.i", F.col("print").bitwiseAND(F.col("m.mask"))).alias("bucket")
    )
    sizes = keys.groupBy("bucket").count().where("count > 1")
    small = keys.join(sizes.where(F.col("count") <= bucket), "bucket").select(
        "bucket", "print", F.lit(0).alias("side"), F.floor(F.pmod(F.xxhash64("bucket"), F.lit(2**20))).alias("work")
    )
    tasks = max(1, math.ceil(sizes.where(F.col("count") <= bucket).agg(F.sum("count")).first()[0] or 1) // 16_384)
    small = small.withColumn("work", F.pmod("work", F.lit(tasks)))
    edge = "a long, b long"
    found = small.groupBy("work").applyInPandas(_compare(radius), edge)
    large = keys.join(sizes.where(F.col("count") > bucket).select("bucket"), "bucket").withColumn(
        "ones", F.bit_count("print")
    )
    cells = large.groupBy("bucket", "ones").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket)).cast("int").alias("parts"))
    tiles = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    other = tiles.select("bucket", F.col("ones").alias("ones_r"), F.col("part").alias("part_r"))
    near_tiles = (F.col("ones_r") >= F.col("ones")) & (F.col("ones_r") <= F.col("ones") + radius)
    once = (F.col("ones_r") > F.col("ones")) | (F.col("part_r") >= F.col("part"))
    pairs = tiles.join(other, "bucket").where(near_tiles & once)
    pairs = pairs.withColumn("work", F.xxhash64("bucket", "ones", "part", "ones_r", "part_r"))
    same = (F.col("ones") == F.col("ones_r")) & (F.col("part") == F.col("part_r"))
    placed = large.join(cells, ["bucket", "ones"]).select(
        "bucket", "ones", F.pmod(F.xxhash64("print"), "parts").cast("int").alias("part"), "print"
    )
    first = placed.join(pairs, ["bucket", "ones", "part"]).select(
        "bucket", "print", F.when(same, 0).otherwise(1).alias("side"), "work"
    )
    second = placed.withColumnsRenamed({"ones": "ones_r", "part": "part_r"}).join(
        pairs.where(~same), ["bucket", "ones_r", "part_r"]
    )
    second = second.select("bucket", "print", F.lit(2).alias("side"), "work")
    return found.unionByName(first.unionByName(second).groupBy("work").applyInPandas(_compare(radius), edge))


def near_duplicates(
    rows: DataFrame,
    cell: str,
    row_index: str = ROW,
    row_key: str | None = None,
    words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """Match groups of rows whose cells have SimHash fingerprints within ``radius`` bits, directly or by a chain.

    Returns one row per row of the table: (row_key, row_index, fingerprint, canonical_row_index, is_canonical).
    ``fingerprint`` is 16 hex digits over all shingles of ``words`` lower-cased words, repeats counted; a shorter cell
    is one shingle, a missing, empty or blank one has fingerprint zero, which links like any other. The canonical row
    is the one of smallest row_index in the group, rows without one last, then by row_key; repeated rows are further
    members. An empty table gives no rows. Other columns of the table are not read.

    Rows of one fingerprint are grouped first, so copies cost nothing; distinct fingerprints are compared exactly
    (see ``links``) and components found by rounds of star contraction over stored links.
    """
    schema = f"{KEY} long, {ROW} long, print long"
    printed = cut(keyed(rows, cell, row_index, row_key).mapInArrow(_fingerprints(words), schema))
    prints = cut(printed.groupBy("print").agg(F.min(first_row()).alias("first")))
    roots = connected_components(links(prints.select("print"), radius))
    rooted = prints.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first"
    )
    canonical = rooted.groupBy("root").agg(F.min("first").alias("canonical"))
    members = rooted.join(canonical, "root").select("print", "canonical")
    return printed.join(members, "print").select(
        KEY,
        ROW,
        hex16(F.col("print")).alias("fingerprint"),
        F.col(f"canonical.{ROW}").alias("canonical_row_index"),
        (F.col(f"canonical.{KEY}") == F.col(KEY)).alias("is_canonical"),
    )


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
