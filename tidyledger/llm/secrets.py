"""Secrets in cells, told from widely copied examples by how many owners and data sources have the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.cells import CELL, KEY, ROW, cut
from tidyledger.plans.skew import attach_group

# The kinds of secrets in order, and what they look like. Letters of names count in either case.
NAMES = r"(?:(?i:password|passwd|secret|token)|(?i:api_?key))"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = tuple(PATTERNS)
# What the corpus may prove to be a secret: a token of mixed letters and digits that no name or prefix announces.
OWNED = "owned"
TOKEN = r"[A-Za-z0-9+_=-]{20,}"
VARIED = 12  # different signs of a token that looks drawn at random
HOT = 10_000  # occurrences of a value beyond which its verdict is broadcast; at most 10,000 values are

# The same matches with runs that are too short left out, so that ordinary words need no place in the result.
SEARCHED = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+", OWNED: TOKEN}


def _hits(kind: str) -> Column:
    """array<struct<kind, n, gap, hit>> of the leftmost matches: each with the text's length since the last one."""
    pattern = SEARCHED[kind]
    pairs = F.zip_with(
        F.regexp_extract_all(CELL, F.lit(pattern), F.lit(0)),
        F.split(CELL, pattern, -1),
        lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")),
    )
    # The piece behind the last match has no hit; lambdas see the pair alone, so nothing is worked out per element.
    told = F.transform(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda p, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.length(p["gap"]).alias("gap"), p["hit"].alias("hit")),
    )
    return F.when(F.rlike(CELL, F.lit(pattern)), told)


def looks_drawn(value: Column) -> Column:
    """Upper and lower case letters, digits, and enough different signs among them."""
    kinds = [F.rlike(value, F.lit(f"[{signs}]")) for signs in ("A-Z", "a-z", "0-9")]
    return kinds[0] & kinds[1] & kinds[2] & (F.size(F.array_distinct(F.split(value, ""))) >= VARIED)


def candidates(scanned: DataFrame) -> DataFrame:
    """(row_key, kind, start, stop, value, source, owner) of all base spans and unannounced tokens.

    Places are running sums over a row's own matches, by a window per row: a text of any number of matches costs in
    proportion to it. A token inside a base span is that span.
    """
    hits = scanned.select(KEY, "source", "owner", F.inline("hits")).repartition(KEY)
    upto = Window.partitionBy(KEY, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("hit")
    placed = hits.withColumn("stop", F.sum(F.col("gap") + length).over(upto)).withColumn("start", F.col("stop") - length)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("hit", ASSIGN, 1)).otherwise(F.col("hit"))
    least = F.lit(0)
    for kind, n in LEAST.items():
        least = F.when(F.col("kind") == kind, n).otherwise(least)
    long = placed.withColumn("value", value).where(F.length("value") >= least)
    known = long.where((F.col("kind") != OWNED) | looks_drawn(F.col("value")))
    before = Window.partitionBy(KEY).orderBy("start", F.col("kind") == OWNED)
    before = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.max(F.when(F.col("kind") != OWNED, F.col("stop"))).over(before)
    covered = known.withColumn("covered", inside)
    free = covered.where((F.col("kind") != OWNED) | F.col("covered").isNull() | (F.col("covered") <= F.col("start")))
    return free.select(
        KEY, "kind", F.col("start").cast("long"), F.col("stop").cast("long"),
        F.unhex(F.sha2("value", 256)).alias("value"), "source", "owner",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, n, sources, owners, announced) of each candidate value over the whole table.

    Summed per value, owner and source first, then per value: an example in a third of all rows arrives at the last
    step as one partial sum a task. Rows without owner or source share one unknown.
    """
    named = F.max((F.col("kind") != OWNED).cast("int")).alias("announced")
    pairs = found.groupBy("value", "owner", "source").agg(F.count(F.lit(1)).alias("n"), named)
    owners = pairs.groupBy("value", "owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.max("announced").alias("announced")
    )
    return owners.groupBy("value").agg(
        F.sum("n").alias("n"), F.sum("sources").alias("sources"), F.count(F.lit(1)).alias("owners"),
        F.max("announced").alias("announced"),
    )


def secret_cells(
    rows: DataFrame,
    cell: str,
    row_index: str = ROW,
    row_key: str | None = None,
    source: str = "data_source_id",
    owner: str = "organization_id",
    copied: int = 3,
) -> DataFrame:
    """Secrets in the cells of rows that belong to data sources of organizations.

    Returns one row per row of the table: (row_key, row_index, spans), spans being (kind, start, stop, verdict,
    occurrences, sources, owners) in code points, sorted by start, then kind in the order assign, access, hex, owned.
    Kinds: ``assign`` is a name such as password with its value, ``access`` an access key id, ``hex`` a long run of
    hexadecimal digits; of each the leftmost matches that do not overlap, too short ones dropped. These always are
    spans. ``owned`` is a token of 20 or more signs that looks drawn at random, outside of base spans; it is a span
    where its value has one owner in the whole table, or stands elsewhere as a base value, unless it is an example.

    The verdict follows from all occurrences of the value: ``example`` with ``copied`` owners or more, ``live`` with
    one owner, ``shared`` between. A source belongs to its owner; the same source under two owners counts twice.

    Missing and empty cells have no spans; rows without source or owner count as of one unknown. Repeated rows are
    judged each and are of one owner. An empty table gives no rows. Columns not named are not read.

    DataFrame functions only. One pass finds matches and stores them; values travel as digests, verdicts of values
    that occur very often are broadcast (a bounded number), the others joined.
    """
    cells = rows.select(
        (rows[row_key].cast("long") if row_key else F.monotonically_increasing_id()).alias(KEY),
        rows[row_index].cast("long").alias(ROW),
        F.coalesce(rows[cell].cast("string"), F.lit("")).alias(CELL),
        rows[source].cast("string").alias("source"),
        rows[owner].cast("string").alias("owner"),
    )
    nothing = F.expr("cast(array() as array<struct<kind string, n int, gap int, hit string>>)")
    hits = F.concat(*[F.coalesce(_hits(kind), nothing) for kind in SEARCHED])
    scanned = cut(cells.select(KEY, ROW, "source", "owner", hits.alias("hits")))
    found = cut(candidates(scanned.where(F.size("hits") > 0)))
    values = ownership(found)
    judged = attach_group(found.select(KEY, "kind", "start", "stop", "value"), values, "value", "n", hot_rows=HOT)
    verdict = (
        F.when(F.col("owners") >= copied, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    )
    told = judged.withColumn("verdict", verdict).where(
        (F.col("kind") != OWNED)
        | (F.col("verdict") == "live")
        | ((F.col("announced") == 1) & (F.col("verdict") != "example"))
    )
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, OWNED))), F.col("kind")).cast("int")
    span = F.struct(
        "start", rank.alias("rank"), "stop", "kind", "verdict", F.col("n").alias("occurrences"), "sources", "owners"
    )
    listed = told.groupBy(KEY).agg(F.sort_array(F.collect_list(span)).alias("listed"))
    names = ("kind", "start", "stop", "verdict", "occurrences", "sources", "owners")
    spans = F.transform("listed", lambda s: F.struct(*[s[c].alias(c) for c in names]))
    none = F.expr(
        "cast(array() as array<struct<kind string, start bigint, stop bigint, verdict string, occurrences bigint,"
        " sources bigint, owners bigint>>)"
    )
    return scanned.select(KEY, ROW).join(listed, KEY, "left").select(KEY, ROW, F.coalesce(spans, none).alias("spans"))
