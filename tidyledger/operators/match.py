"""Duplicate detection: exact rows, then weighted field agreement inside blocks, then clusters.

Nothing here walks pairs except the decision log itself. A pair's score depends only on which fields
agree, so counts come from group sizes per set of agreeing fields, and clusters from linking every row to
the first row of each group that agrees on a sufficient set. Both are linear in the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.config import MATCHING_VERSION, AuditLimits, MatchField, MatchLimits, MatchRules
from tidyledger.functions.text import fold, row_key
from tidyledger.operators.components import components_by_block, connected_components
from tidyledger.plans.onerow import beside
from tidyledger.plans.order import bucket_of, first_rows, next_in_group, offsets
from tidyledger.plans.skew import HOT_ROWS, MAX_HOT, attach_group, without_hot
from tidyledger.session import ensure_checkpoint_dir
from tidyledger.sources.tables import ROW, CellTable

EXACT_ROW = "exact_row_match"
NORMALIZED_EXACT = "normalized_exact_match"
COMPOSITE = "composite_weighted_match"
# With more freely varying fields than this, sets of fields outnumber rows of a block: blocks are scored directly.
FEW_FIELDS = 6
BLOCK_ROWS = 500_000  # rows of a block whose links one task holds
TUPLES = 1_000  # distinct value tuples of a block, up to which all meet in one task, and of one side of a piece beyond


def blocking_field(fields: tuple[MatchField, ...]) -> int:
    """Position of the heaviest field, the earliest on a tie."""
    return max(range(len(fields)), key=lambda i: (fields[i].weight, -i))


def score_of(fields: tuple[MatchField, ...], agreeing: frozenset[int]) -> float:
    """Weight share of the agreeing fields, summed in field order."""
    matched = total = 0.0
    for i, f in enumerate(fields):
        total += f.weight
        matched += f.weight if i in agreeing else 0.0
    return matched / total if total > 0 else 0.0


def winning_sets(
    fields: tuple[MatchField, ...], threshold: float, always: frozenset[int] = frozenset()
) -> list[frozenset[int]]:
    """Smallest sets of further agreeing fields that, with ``always``, reach a score; smaller sets first."""
    free = [i for i in range(len(fields)) if i not in always]
    found: list[frozenset[int]] = []
    for size in range(len(free) + 1):
        for chosen in map(frozenset, combinations(free, size)):
            if score_of(fields, chosen | always) >= threshold and not any(s <= chosen for s in found):
                found.append(chosen)
    return found


class Match:
    """Lazy results of one matching run."""

    def __init__(
        self,
        table: CellTable,
        rules: MatchRules | None = None,
        limits: MatchLimits = MatchLimits(),
        audit: AuditLimits = AuditLimits(),
        run_id: str = "run",
        checkpoint: bool = True,
    ):
        self.table, self.limits, self.audit, self.run_id = table, limits, audit, run_id
        self.checkpoint = checkpoint
        self.rules = rules if rules is not None and rules.fields else None

    # ---- exact rows -------------------------------------------------------------------------------

    @cached_property
    def keyed(self) -> DataFrame:
        """(row_index, row_key, field values): every row with its digest and the compared cells."""
        return self.table.frame.select(ROW, row_key(self.table.cells).alias("row_key"), *self._field_columns())

    @cached_property
    def distinct_rows(self) -> DataFrame:
        """One row per distinct full row: its lowest row_index, its size and its field values.

        Repeats are collapsed before the shuffle, so a row that fills a third of the table costs nothing.
        """
        carried = [F.first(c).alias(c) for c in self._field_names()]
        distinct = self.keyed.groupBy("row_key").agg(
            F.min(ROW).alias("rep"), F.count(F.lit(1)).alias("row_size"), *carried
        )
        # Every later result starts here: written once to the shared checkpoint folder.
        return self._stored(distinct)

    def _stored(self, frame: DataFrame) -> DataFrame:
        if not self.checkpoint:
            return frame
        ensure_checkpoint_dir(frame.sparkSession)
        return frame.checkpoint()

    @cached_property
    def exact_groups(self) -> DataFrame:
        return self.distinct_rows.where(F.col("row_size") > 1).select("row_key", "rep", "row_size")

    @cached_property
    def repeated_rows(self) -> DataFrame:
        """(row_index, rep, row_size) of every row that has an exact copy."""
        rows = self.keyed.select("row_key", ROW)
        return attach_group(rows, self.exact_groups, "row_key", "row_size")

    # ---- fields and blocks ------------------------------------------------------------------------

    def _field_names(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.rules.fields))] if self.rules else []

    def _field_columns(self) -> list[Column]:
        """Compared value of each rule field; a column that does not exist counts as blank."""
        columns = []
        for i, spec in enumerate(self.rules.fields if self.rules else ()):
            position = self.table.position(spec.column_name)
            raw = F.lit("") if position is None else F.col(f"c{position}")
            # Not a bare column: for each one the optimizer would double what it knows of the digest beside it.
            columns.append((fold(raw) if spec.comparison == "normalized_exact" else F.concat(raw, F.lit(""))).alias(f"f{i}"))
        return columns

    @cached_property
    def candidates(self) -> DataFrame:
        """(rep, row_size, block_key, f0..): one per distinct row with a non-blank blocking value."""
        spec = blocking_field(self.rules.fields)
        return (
            self.distinct_rows.withColumn("block_key", fold(F.col(f"f{spec}")))
            .where(F.col("block_key") != "")
            .drop("row_key")
        )

    @cached_property
    def blocks(self) -> DataFrame:
        return self.candidates.groupBy("block_key").agg(F.count(F.lit(1)).alias("block_size"))

    @cached_property
    def compared(self) -> DataFrame:
        """Candidates of the blocks that are worked on."""
        if self.limits.max_block_size is None:
            return self.candidates
        cap = self.limits.max_block_size
        kept = self.blocks.where(F.col("block_size").between(2, cap))
        rest = without_hot(self.candidates, self.blocks, "block_key", "block_size", max(cap, HOT_ROWS))
        return rest.join(kept.select("block_key"), "block_key", "left_semi")

    @cached_property
    def skipped_blocks(self) -> DataFrame:
        """Blocks above the size limit: true size and the first few row indexes."""
        schema = "blocking_key string, block_size bigint, sample_row_indices array<bigint>"
        if self.rules is None or self.limits.max_block_size is None:
            return self.table.frame.sparkSession.createDataFrame([], schema)
        big = self.blocks.where(F.col("block_size") > self.limits.max_block_size)
        members = attach_group(self.candidates.select("block_key", "rep"), big, "block_key", "block_size")
        # The top-k filter is applied per task before the shuffle; a block is never gathered whole.
        order = Window.partitionBy("block_key").orderBy("rep")
        sample = members.withColumn("_rank", F.row_number().over(order)).where(
            F.col("_rank") <= self.limits.max_skipped_sample
        )
        return sample.groupBy(F.col("block_key").alias("blocking_key")).agg(
            F.max("block_size").alias("block_size"), F.sort_array(F.collect_list("rep")).alias("sample_row_indices")
        )

    @property
    def _duplicate_sets(self) -> list[frozenset[int]]:
        return winning_sets(self.rules.fields, self.rules.duplicate_threshold, self._always)

    # ---- pair counts without pairs ----------------------------------------------------------------

    @property
    def _rule_name(self) -> str:
        return NORMALIZED_EXACT if len(self.rules.fields) == 1 else COMPOSITE

    @cached_property
    def _always(self) -> frozenset[int]:
        """Fields every in-block pair agrees on: the blocking field when it is compared in folded form."""
        spec = blocking_field(self.rules.fields)
        folded = self.rules.fields[spec].comparison == "normalized_exact"
        return frozenset({spec}) if folded else frozenset()

    @cached_property
    def _free(self) -> list[int]:
        return [i for i in range(len(self.rules.fields)) if i not in self._always]

    @property
    def _sets(self) -> list[frozenset[int]]:
        return [frozenset(c) for k in range(len(self._free) + 1) for c in combinations(self._free, k)]

    @property
    def _pairs(self) -> Column:
        """Pairs among ``n`` rows. Without a block cap n has no bound, so 38 digits are kept."""
        if self.limits.max_block_size is not None:
            return F.expr("n * (n - 1) div 2")
        return F.expr("cast(n as decimal(19,0)) * cast(n - 1 as decimal(18,0)) / 2").cast("decimal(38,0)")

    def _agreement_sizes(self, rows: DataFrame, within: str, sets: list[frozenset[int]]) -> DataFrame:
        """(within, set_id, n): sizes of the groups agreeing on each set of fields.

        Candidates collapse to distinct value tuples first. Sets then follow from the top of the lattice down, one
        field less per level: each group is added into those of the sets that have it as their parent, by one
        aggregation per level over what the level above has left. No candidate is repeated per set. Levels are stored:
        partitioned by block already, all of them would otherwise be worked out again within one task, which holds the
        memory of each aggregation to its end.
        """
        values, number = [f"g{i}" for i in self._free], {s: n for n, s in enumerate(sets)}
        whole = frozenset(self._free)
        level = rows.groupBy(within, *[F.col(f"f{i}").alias(f"g{i}") for i in self._free]).agg(F.count(F.lit(1)).alias("n"))
        level = self._stored(level.withColumn("set_id", F.lit(number[whole])))
        found = level.select(within, "set_id", "n")
        blank = F.lit(None).cast("string")
        for size in range(len(whole), 0, -1):
            parts = None
            for parent in (s for s in sets if len(s) == size):
                # A set's parent has one field more: the first that the set lacks.
                lacking = min(whole - parent, default=len(self.rules.fields))
                children = [parent - {i} for i in sorted(parent) if i < lacking]
                if children:
                    told = F.array(*[
                        F.struct(
                            F.lit(number[child]).alias("set_id"),
                            *[(F.col(f"g{i}") if i in child else blank).alias(f"g{i}") for i in self._free],
                        )
                        for child in children
                    ])
                    own = F.col("set_id") == number[parent]
                    parts = F.when(own, told) if parts is None else parts.when(own, told)
            spread = level.select(within, "n", F.inline(parts))
            level = self._stored(spread.groupBy(within, "set_id", *values).agg(F.sum("n").alias("n")))
            found = found.unionByName(level.select(within, "set_id", "n"))
        return found

    @cached_property
    def block_pairs(self) -> DataFrame:
        """(block_key, comparisons, duplicates, ambiguous): exact numbers of pairs per block of two rows or more.

        For each set S of fields, ``at_least(S)`` sums n(n-1)/2 over the groups agreeing on S. Pairs that
        agree on exactly S follow by inclusion and exclusion; their score is a constant of the rules.
        """
        if self._many:
            return self._scored_block_pairs
        sets = self._sets
        fields = self.rules.fields
        duplicate, ambiguous = dict.fromkeys(sets, 0), dict.fromkeys(sets, 0)
        for exact in sets:
            score = score_of(fields, exact | self._always)
            target = None
            if score >= self.rules.duplicate_threshold:
                target = duplicate
            elif score >= self.rules.review_threshold:
                target = ambiguous
            if target is not None:
                for wider in (s for s in sets if s >= exact):
                    target[wider] += (-1) ** (len(wider) - len(exact))

        sizes = self._agreement_sizes(self.compared, "block_key", sets)

        def weighted(weights: dict[frozenset[int], int]) -> Column:
            weight = F.lit(0)
            for number, s in enumerate(sets):
                if weights[s]:
                    weight = F.when(F.col("set_id") == number, F.lit(weights[s])).otherwise(weight)
            return F.sum(self._pairs * weight)

        everything = {s: int(not s) for s in sets}
        return sizes.groupBy("block_key").agg(
            weighted(everything).alias("comparisons"),
            weighted(duplicate).alias("duplicates"),
            weighted(ambiguous).alias("ambiguous"),
        ).where("comparisons > 0")

    # ---- many fields: distinct tuples of a block, in large ones those that share a value rare enough to decide ---------

    @property
    def _many(self) -> bool:
        return len(self._free) > FEW_FIELDS

    @property
    def _tuple_keys(self) -> list[str]:
        return ["block_key", *[f"f{i}" for i in self._free]]

    @cached_property
    def _tuples(self) -> DataFrame:
        """(block_key, f.., head, n): each distinct tuple of compared values of a block, its first row and its rows."""
        tuples = self.compared.groupBy(*self._tuple_keys).agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n"))
        return self._stored(tuples)

    @property
    def _needed(self) -> float:
        """Weight that the free fields two tuples agree on must have at least, for the review threshold."""
        total = sum(f.weight for f in self.rules.fields)
        return self.rules.review_threshold * total - sum(self.rules.fields[i].weight for i in self._always) - 1e-9

    @cached_property
    def _sized_tuples(self) -> tuple[DataFrame, DataFrame | None]:
        """Tuples of the blocks whose tuples all meet in one task, and those of larger blocks, None without such a block."""
        sizes = self._tuples.groupBy("block_key").agg(F.count(F.lit(1)).alias("tuples"))
        large = self._stored(sizes.where(F.col("tuples") > TUPLES).select("block_key"))
        number = large.count()
        if not number:
            return self._tuples, None
        large = F.broadcast(large) if number <= MAX_HOT else large
        return tuple(self._tuples.join(large, "block_key", how) for how in ("left_anti", "left_semi"))

    @property
    def _lists(self) -> DataFrame:
        return self._lists_of(self._tuples)

    def _lists_of(self, tuples: DataFrame) -> DataFrame:
        """(block_key, field, value, parts, head, n, f.., order): tuples under those of their values that can decide.

        A tuple's values are ordered from the rarest in its block on. Two tuples that agree on enough weight share a
        value within the first values of both, those before which less than all but the needed weight has gone by: the
        first value they share lies there. So only the inverted lists of these values are joined; frequent values
        mostly come last and have no list. ``order`` has the frequency of each free field's value.
        """
        values = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("value")) for i in self._free])
        keys = ["block_key", "field", "value"]
        each = tuples.select("block_key", "head", F.inline(values))
        rarity = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
        sized = attach_group(each, rarity, keys, "found")
        weights = F.array(*[F.lit(float(f.weight)) for f in self.rules.fields])
        ranked = sized.groupBy("block_key", "head").agg(
            F.sort_array(F.collect_list(F.struct("found", "field", "value"))).alias("ranked")
        )
        free = sum(self.rules.fields[i].weight for i in self._free)

        def before(place: Column) -> Column:
            earlier = F.slice("ranked", F.lit(1), place)
            return F.aggregate(earlier, F.lit(0.0), lambda sum_, v: sum_ + F.get(weights, v["field"]))

        decides = F.filter("ranked", lambda v, place: F.lit(free) - before(place) >= self._needed)
        by_field = F.array_sort(F.transform("ranked", lambda v: F.struct(v["field"].alias("field"), v["found"].alias("found"))))
        told = ranked.select("block_key", "head", by_field["found"].alias("order"), decides.alias("decides"))
        listed = tuples.join(told, ["block_key", "head"]).withColumn("d", F.explode("decides"))
        parts = F.ceil(F.col("d.found") / F.lit(TUPLES)).cast("int").alias("parts")
        names = [f"f{i}" for i in self._free]
        return listed.select("block_key", "d.field", "d.value", "d.found", parts, "head", "n", "order", *names)

    def _agreements(self) -> tuple[dict[int, Column], Column]:
        """Whether two tuples beside each other agree, by field, and their score."""
        matched, total, agreed = F.lit(0.0), 0.0, {}
        for i, field in enumerate(self.rules.fields):
            weight = F.lit(float(field.weight))
            agree = F.lit(True) if i in self._always else F.col(f"a_f{i}") == F.col(f"b_f{i}")
            agreed[i] = agree
            matched, total = matched + F.when(agree, weight).otherwise(0.0), total + field.weight
        return agreed, matched / F.lit(total) if total > 0 else F.lit(0.0)

    def _side(self, side: str) -> list[Column]:
        """A tuple's first row, number of rows and values under the names of one side of a pair."""
        return [F.col("head").alias(side), F.col("n").alias(f"n_{side}"), *[F.col(f"f{i}").alias(f"{side}_f{i}") for i in self._free]]

    def _beside_each_other(self, tuples: DataFrame) -> DataFrame:
        """(block_key, a, n_a, a_f.., b, n_b, b_f.., own, score): all pairs of a block's tuples, ``own`` of one with itself.

        For blocks that a task can hold: tuples go to their block in one shuffle, and both sides read that one.
        """
        dealt = tuples.repartition("block_key")
        left, right = (dealt.select("block_key", *self._side(side)) for side in "ab")
        agreed, score = self._agreements()
        # Tuples of a block that agree on all fields are the same one, whatever row index they have.
        own = reduce(lambda both, agree: both & agree, agreed.values())
        return left.join(right, "block_key").withColumns({"own": own, "score": score}).where("a < b or own")

    def _met_in_lists(self, tuples: DataFrame) -> DataFrame:
        """The same of two tuples that reach the review threshold, in blocks of any size.

        Tuples meet in the list of the first value they share, once. A list of many tuples is dealt out in pieces, so
        that no task has a whole one. Where every pair of a block reaches the threshold its tuples are one list.
        """
        whole = self._needed <= 0
        if whole:
            parts = F.ceil(F.count(F.lit(1)) / F.lit(TUPLES)).cast("int").alias("parts")
            placed = tuples.join(tuples.groupBy("block_key").agg(parts), "block_key")
            keys, more = ["block_key"], []
        else:
            placed, keys, more = self._lists_of(tuples), ["block_key", "field", "value"], ["order"]
        left = placed.select(*keys, F.pmod(F.xxhash64("head"), "parts").alias("part"), *self._side("a"), *more)
        right = placed.select(
            *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), *self._side("b")
        )
        agreed, score = self._agreements()
        met = left.join(right, [*keys, "part"]).where("a < b").withColumn("score", score)
        met = met.where(F.col("score") >= self.rules.review_threshold)
        if not whole:
            shared = F.array(*[
                F.when(agreed[i], F.struct(F.get("order", F.lit(place)).alias("found"), F.lit(i).alias("field")))
                for place, i in enumerate(self._free)
            ])
            met = met.where(F.array_min(shared)["field"] == F.col("field"))
        return met

    @property
    def _both(self) -> Column:
        """Pairs of rows of two tuples."""
        return F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(18,0)")

    @cached_property
    def _scored_tuples(self) -> DataFrame:
        """(block_key, a, b, score, values of both): two tuples of a block that reach the review threshold."""
        small, large = self._sized_tuples
        sides = [f"{side}_f{i}" for side in "ab" for i in self._free]
        met = self._beside_each_other(small).where(~F.col("own") & (F.col("score") >= self.rules.review_threshold))
        found = met.select("block_key", "a", "b", *sides, "score")
        if large is not None:
            found = found.unionByName(self._met_in_lists(large).select("block_key", "a", "b", *sides, "score"))
        return found

    @property
    def _scored_block_pairs(self) -> DataFrame:
        small, large = self._sized_tuples
        duplicate = F.col("score") >= self.rules.duplicate_threshold
        own, enough = F.col("own"), F.col("score") >= self.rules.review_threshold
        # A block's tuples are in one task here, so its sums need no further shuffle.
        summed = self._beside_each_other(small).where(own | enough).withColumn("n", F.col("n_a")).groupBy("block_key").agg(
            F.sum(F.when(own, F.col("n"))).alias("n"),
            F.sum(F.when(own, self._pairs).when(duplicate, self._both).otherwise(0)).alias("duplicates"),
            F.sum(F.when(own | duplicate, 0).otherwise(self._both)).alias("ambiguous"),
        )
        if large is not None:
            between = self._met_in_lists(large).select(
                "block_key", F.lit(0).alias("rows"), F.when(duplicate, self._both).otherwise(0).alias("duplicates"),
                F.when(duplicate, 0).otherwise(self._both).alias("ambiguous"),
            )
            within = large.select(
                "block_key", F.col("n").alias("rows"), self._pairs.alias("duplicates"), F.lit(0).alias("ambiguous")
            )
            summed = summed.unionByName(between.unionByName(within).groupBy("block_key").agg(
                F.sum("rows").alias("n"), F.sum("duplicates").alias("duplicates"), F.sum("ambiguous").alias("ambiguous")
            ))
        return summed.select(
            "block_key", self._pairs.alias("comparisons"),
            *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("duplicates", "ambiguous")],
        ).where("comparisons > 0")

    def _scored_links(self) -> DataFrame:
        """(block_key, a, b, values of both): scoring pairs of tuples' first rows, and each row with its tuple's first."""
        names = self._field_names()
        shared = [F.col("block_key").alias(f"{side}_f{i}") for i in self._always for side in "ab"]
        values = [f"{side}_f{i}" for i in self._free for side in "ab"]
        between = self._scored_tuples.select("block_key", "a", "b", *values, *shared)
        copies = attach_group(self.compared, self._tuples.where("n > 1"), self._tuple_keys, "n").where("head <> rep")
        within = copies.select(
            "block_key", F.col("head").alias("a"), F.col("rep").alias("b"),
            *[F.col(c).alias(f"{side}_{c}") for c in names for side in "ab"],
        )
        return between.unionByName(within)

    # ---- clusters ---------------------------------------------------------------------------------

    @cached_property
    def _links(self) -> DataFrame:
        """(block_key, rep, head): each candidate tied to the first one agreeing on a winning set."""
        if self._many:
            linked = self._scored_tuples.where(F.col("score") >= self.rules.duplicate_threshold)
            copies = attach_group(self.compared, self._tuples.where("n > 1"), self._tuple_keys, "n")
            return linked.select("block_key", F.col("b").alias("rep"), F.col("a").alias("head")).unionByName(
                copies.select("block_key", "rep", "head")
            )
        parts = []
        for chosen in self._duplicate_sets:
            keys = ["block_key", *[f"f{i}" for i in sorted(chosen)]]
            heads = self.compared.groupBy(*keys).agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("_n"))
            heads = heads.where("_n > 1")
            if self.limits.max_block_size is None:
                tied = attach_group(self.compared, heads, keys, "_n")
            else:
                tied = self.compared.join(heads, keys)
            parts.append(tied.select("block_key", "rep", "head"))
        links = parts[0]
        for part in parts[1:]:
            links = links.unionByName(part)
        return links

    @cached_property
    def candidate_groups(self) -> DataFrame:
        """(rep, block_key, canonical) of the candidates that fall into a cluster by field agreement."""
        sets = [] if self._many else self._duplicate_sets
        if not sets and not self._many:
            return self.compared.where(F.lit(False)).select("rep", "block_key", F.col("rep").alias("canonical"))
        if len(sets) == 1:
            # One winning set: agreeing on it is transitive, so its groups are the clusters.
            return self._links.select("rep", "block_key", F.col("head").alias("canonical"))
        edges = self._links.where("rep <> head")
        if self.limits.max_block_size is not None:
            return components_by_block(edges)
        # No component leaves its block: blocks that a task can hold take one shuffle, only larger ones take rounds.
        large = self.blocks.where(F.col("block_size") > BLOCK_ROWS).select("block_key")
        number = large.count()
        if not number:
            return components_by_block(edges)
        large = F.broadcast(large) if number <= MAX_HOT else large
        within = components_by_block(edges.join(large, "block_key", "left_anti"))
        across = edges.join(large, "block_key", "left_semi")
        found = connected_components(across.select(F.col("rep").alias("a"), F.col("head").alias("b")))
        keys = self.compared.join(large, "block_key", "left_semi").select("rep", "block_key")
        named = found.select(F.col("node").alias("rep"), F.col("root").alias("canonical")).join(keys, "rep")
        return within.unionByName(named)

    @cached_property
    def _group_scores(self) -> DataFrame:
        """(canonical, low): lowest duplicate score inside each field-agreement cluster.

        For each score from the top down a pair exists when its exact agreement pattern occurs; the lowest
        occurring pattern is found from the group sizes inside the cluster, again without pairs.
        """
        if self._many:
            duplicates = self._scored_tuples.where(F.col("score") >= self.rules.duplicate_threshold)
            owner = self.candidate_groups.select(F.col("rep").alias("a"), "canonical")
            return duplicates.join(owner, "a").groupBy("canonical").agg(F.min("score").alias("low"))
        members = self.compared.join(self.candidate_groups.select("rep", "canonical"), "rep")
        fields = self.rules.fields
        sets = self._sets
        scores = {s: score_of(fields, s | self._always) for s in sets}
        sizes = self._agreement_sizes(members, "canonical", sets)
        at_least = sizes.groupBy("canonical").agg(
            *[
                F.sum(F.when(F.col("set_id") == number, self._pairs).otherwise(0)).alias(f"s{number}")
                for number in range(len(sets))
            ]
        )
        low = F.lit(1.0)
        for exact in sorted(sets, key=lambda s: -scores[s]):
            if scores[exact] < self.rules.duplicate_threshold:
                continue
            count = F.lit(0)
            for number, wider in enumerate(sets):
                if wider >= exact:
                    count = count + F.col(f"s{number}") * (-1) ** (len(wider) - len(exact))
            low = F.when(count > 0, F.lit(scores[exact])).otherwise(low)
        return at_least.select("canonical", low.alias("low"))

    @cached_property
    def _clusters(self) -> DataFrame:
        """(rep, row_size, canonical): each distinct row under the canonical row of its cluster."""
        sized = self.distinct_rows.select("rep", "row_size")
        if self.rules is None:
            return sized.where("row_size > 1").withColumn("canonical", F.col("rep"))
        grouped = sized.join(self.candidate_groups.select("rep", "canonical"), "rep", "left")
        return grouped.where("canonical is not null or row_size > 1").withColumn(
            "canonical", F.coalesce("canonical", "rep")
        )

    @cached_property
    def _cluster_sizes(self) -> DataFrame:
        """(canonical, record_count)."""
        return self._clusters.groupBy("canonical").agg(F.sum("row_size").alias("record_count"))

    @cached_property
    def groups(self) -> DataFrame:
        """(group_id, canonical_row_index, record_count, confidence_score)."""
        groups = self._cluster_sizes
        if self.rules is not None:
            groups = groups.join(self._group_scores, "canonical", "left")
        else:
            groups = groups.withColumn("low", F.lit(1.0))
        return groups.select(
            self.group_id(F.col("canonical")).alias("group_id"),
            F.col("canonical").alias("canonical_row_index"),
            "record_count",
            F.coalesce("low", F.lit(1.0)).alias("confidence_score"),
        )

    def group_id(self, canonical: Column) -> Column:
        """Deterministic id of a cluster: a digest of the run and its canonical row."""
        return F.sha2(F.concat_ws(":", F.lit(self.run_id), canonical.cast("string")), 256)

    @cached_property
    def members(self) -> DataFrame:
        """(group_id, canonical_row_index, record_count, row_index) of every clustered row.

        Distinct rows are listed directly; copies get their group through the digest of their row, with the
        largest groups broadcast. No group is ever gathered.
        """
        sized = self._clusters.join(self._cluster_sizes, "canonical").select(
            "rep", F.col("canonical").alias("canonical_row_index"), "record_count"
        )
        firsts = sized.select("canonical_row_index", "record_count", F.col("rep").alias(ROW))
        per_key = self.exact_groups.join(sized, "rep")
        copies = attach_group(self.keyed.select("row_key", ROW), per_key, "row_key", "row_size")
        copies = copies.where(F.col(ROW) != F.col("rep")).select("canonical_row_index", "record_count", ROW)
        return firsts.unionByName(copies).select(
            self.group_id(F.col("canonical_row_index")).alias("group_id"), "canonical_row_index", "record_count", ROW
        )

    # ---- decision log -----------------------------------------------------------------------------

    @cached_property
    def exact_decisions(self) -> DataFrame:
        """Consecutive copies of the same row, chained: n identical rows give n - 1 decisions."""
        limit = self.audit.max_decisions
        rows = self.repeated_rows
        if limit is not None:
            # Chains are logged group by group in the order of their first row: later groups are not needed.
            wanted = first_rows(self.exact_groups, "rep", limit)
            rows = rows.join(wanted.select("rep"), "rep", "left_semi")
        chained = next_in_group(rows.select(ROW, "rep", "row_size"), "rep", ROW, "b").where("b is not null")
        if limit is not None:
            chained = _cut_chains(chained, limit)
        return chained.select("rep", F.col(ROW).alias("a"), "b", "row_size")

    @cached_property
    def _logged_blocks(self) -> DataFrame:
        """Blocks whose decisions can reach the capped log, at most as many as the log has rows."""
        found = F.col("duplicates") + F.col("ambiguous")
        busy = self.block_pairs.withColumn("found", found).where(F.col("found") > 0)
        if self.audit.max_decisions is None:
            return busy.select("block_key")
        first = busy.orderBy("block_key").limit(self.audit.max_decisions)
        # At most max_decisions small rows: one task is enough for their running total.
        running = offsets(first.select("block_key", "found"), ["block_key"], "found")
        return running.where(F.col("_start") < self.audit.max_decisions).select("block_key")

    def _paired(self) -> DataFrame:
        """(block_key, a, b, values of both) of all pairs that agree on a winning set, in blocks of limited size."""
        names = self._field_names()
        busy = self.compared.join(self._logged_blocks, "block_key", "left_semi")
        left = busy.select("block_key", F.col("rep").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
        right = busy.select(
            F.col("block_key").alias("_block"), F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names]
        )
        apart = (F.col("block_key") == F.col("_block")) & (F.col("a") < F.col("b"))
        if self._many:
            return left.join(right, apart)
        sets = winning_sets(self.rules.fields, self.rules.review_threshold, self._always)
        return self._first_set(sets, lambda chosen: left.join(right, self._agree(chosen, apart)))

    def _starred(self) -> DataFrame:
        """(block_key, a, b, values of both): each candidate with the first one of every group it agrees with.

        In blocks of any size: a group of n gives n - 1 links, not its n(n-1)/2 pairs. ``block_pairs`` counts those.
        """
        if self._many:
            return self._scored_links()
        names = self._field_names()

        def links(chosen: frozenset[int]) -> DataFrame:
            keys = ["block_key", *[f"f{i}" for i in sorted(chosen)]]
            head = F.min(F.struct("rep", *names)).alias("head")
            heads = self.compared.groupBy(*keys).agg(head, F.count(F.lit(1)).alias("_n")).where("_n > 1")
            tied = attach_group(self.compared, heads, keys, "_n").where("head.rep <> rep")
            return tied.select(
                "block_key", F.col("head.rep").alias("a"), *[F.col(f"head.{c}").alias(f"a_{c}") for c in names],
                F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names],
            )

        # Sets that make a duplicate come first: their links alone connect the clusters.
        review = winning_sets(self.rules.fields, self.rules.review_threshold, self._always)
        sets = self._duplicate_sets + [s for s in review if s not in self._duplicate_sets]
        return self._first_set(sets, links)

    def _agree(self, chosen: frozenset[int], start: Column) -> Column:
        for i in sorted(chosen):
            start = start & (F.col(f"a_f{i}") == F.col(f"b_f{i}"))
        return start

    def _first_set(self, sets: list[frozenset[int]], pairs_of) -> DataFrame:
        """Pairs under every set, each under the first set it agrees on."""
        earlier, found = F.lit(False), None
        for chosen in sets:
            part = pairs_of(chosen).where(~earlier)
            earlier = earlier | self._agree(chosen, F.lit(True))
            found = part if found is None else found.unionByName(part)
        return found if found is not None else pairs_of(frozenset()).where(F.lit(False))

    @cached_property
    def field_decisions(self) -> DataFrame:
        """In-block pairs that score at least the review threshold.

        Pairs below the threshold are never formed. Under a block size limit all pairs are listed, without one each
        row's links to the first rows it agrees with.
        """
        rules, fields = self.rules, self.rules.fields
        pairs = self._starred() if self.limits.max_block_size is None else self._paired()
        agree = {i: F.col(f"a_f{i}") == F.col(f"b_f{i}") for i in range(len(fields))}

        matched, total, agreed = F.lit(0.0), 0.0, F.lit(0)
        for i, f in enumerate(fields):
            matched = matched + F.when(agree[i], F.lit(float(f.weight))).otherwise(0.0)
            agreed = agreed + F.when(agree[i], 1).otherwise(0)
            total += f.weight
        pairs = pairs.withColumn("total_score", matched / F.lit(total)).withColumn("matched_fields", agreed)
        if self._many:
            pairs = pairs.where(F.col("total_score") >= rules.review_threshold)
        duplicate = F.col("total_score") >= rules.duplicate_threshold
        comparisons = [
            part
            for i, f in enumerate(fields)
            for part in (
                F.lit(f.column_name),
                F.struct(
                    F.col(f"a_f{i}").alias("value_a"),
                    F.col(f"b_f{i}").alias("value_b"),
                    agree[i].alias("matched"),
                    F.lit(float(f.weight)).alias("weight"),
                    F.when(agree[i], F.lit(float(f.weight))).otherwise(0.0).alias("contribution"),
                ),
            )
        ]
        head = F.format_string(
            f"%d of {len(fields)} configured fields matched (score %.4f ", F.col("matched_fields"), F.col("total_score")
        )
        low, high = f"{rules.review_threshold:.4f}", f"{rules.duplicate_threshold:.4f}"
        reason = F.when(duplicate, F.concat(head, F.lit(f">= threshold {high})"))).otherwise(
            F.concat(
                head,
                F.lit(
                    f"is between the review threshold {low} and the duplicate threshold {high}) -- "
                    "flagged for manual review, not grouped"
                ),
            )
        )
        return pairs.select(
            "block_key",
            "a",
            "b",
            "total_score",
            F.when(duplicate, F.lit("duplicate")).otherwise(F.lit("ambiguous")).alias("decision"),
            F.create_map(*comparisons).alias("field_comparisons"),
            reason.alias("reason"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """The decision log: exact-row chains first, then pairs by block key and row indexes, up to the cap."""
        t = self.table
        by_row = t.frame.select(
            F.col(ROW).alias("a"),
            F.create_map(
                *[
                    part
                    for cell, header in zip(t.cells, _unique(t.headers))
                    for part in (
                        F.lit(header),
                        F.struct(
                            F.col(cell).alias("value_a"),
                            F.col(cell).alias("value_b"),
                            F.lit(True).alias("matched"),
                            F.lit(1.0).alias("weight"),
                            F.lit(1.0).alias("contribution"),
                        ),
                    )
                ]
            ).alias("field_comparisons"),
        )
        one = F.lit(1.0)
        links = self.exact_decisions
        exact = by_row.join(links, "a").select(
            F.lit(1).alias("stage"),
            F.col("rep").alias("order_row"),
            F.lit(None).cast("string").alias("blocking_key"),
            "a",
            "b",
            F.lit(EXACT_ROW).alias("rule_name"),
            "field_comparisons",
            one.alias("total_score"),
            one.alias("threshold_used"),
            F.lit("duplicate").alias("decision"),
            F.format_string(
                "identical row (Stage 1 exact match, chain-linked within a %d-row duplicate group)",
                F.col("row_size"),
            ).alias("reason"),
            F.col("rep").alias("anchor"),
        )
        if self.rules is not None:
            paired = self.field_decisions.select(
                F.lit(2).alias("stage"),
                F.lit(0).cast("long").alias("order_row"),
                F.col("block_key").alias("blocking_key"),
                "a",
                "b",
                F.lit(self._rule_name).alias("rule_name"),
                "field_comparisons",
                "total_score",
                F.lit(float(self.rules.duplicate_threshold)).alias("threshold_used"),
                "decision",
                "reason",
                F.when(F.col("decision") == "duplicate", F.col("a")).alias("anchor"),
            )
            log = exact.unionByName(paired)
        else:
            log = exact
        order = ["stage", "order_row", "blocking_key", "a", "b"]
        if self.audit.max_decisions is not None:
            log = log.orderBy(*order).limit(self.audit.max_decisions)
        # Cluster of a decision: that of its anchor row, which stands for itself among the candidates.
        owner = self._clusters.select(F.col("rep").alias("anchor"), "canonical")
        log = log.join(owner, "anchor", "left").withColumn("match_group_id", self.group_id(F.col("canonical")))
        return log.select(
            F.when(F.col("canonical").isNotNull(), F.col("match_group_id")).alias("match_group_id"),
            F.col("a").alias("record_a_row_index"),
            F.col("b").alias("record_b_row_index"),
            "blocking_key",
            "rule_name",
            "field_comparisons",
            "total_score",
            "threshold_used",
            "decision",
            F.col("total_score").alias("confidence_score"),
            "reason",
            F.lit(MATCHING_VERSION).alias("rule_version"),
        )

    # ---- totals -----------------------------------------------------------------------------------

    @cached_property
    def summary(self) -> DataFrame:
        """One row of true totals, whatever the caps."""
        rows = self.distinct_rows.agg(
            F.coalesce(F.sum("row_size"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("row_size") - 1), F.lit(0)).alias("exact_pairs"),
        )
        groups = self.groups.agg(
            F.count(F.lit(1)).alias("duplicate_group_count"),
            F.coalesce(F.min("confidence_score"), F.lit(1.0)).alias("confidence_score"),
        )
        zero = F.lit(0).cast("long")
        if self.rules is not None:
            pairs = self.block_pairs.agg(
                *[F.coalesce(F.sum(c), zero).alias(c) for c in ("comparisons", "duplicates", "ambiguous")]
            )
            cap = self.limits.max_block_size
            skipped = self.blocks.agg(
                (F.count_if(F.col("block_size") > cap) if cap is not None else zero).alias("skipped_block_count")
            )
            joined = beside(rows, groups, pairs, skipped)
            rule_name = self._rule_name
        else:
            joined = beside(rows, groups).withColumns(
                {c: zero for c in ("comparisons", "duplicates", "ambiguous", "skipped_block_count")}
            )
            rule_name = COMPOSITE
        by_rule = F.array(
            F.struct(F.lit(EXACT_ROW).alias("rule"), F.col("exact_pairs").alias("n")),
            F.struct(F.lit(rule_name).alias("rule"), (F.col("duplicates") + F.col("ambiguous")).alias("n")),
        )
        return joined.select(
            "row_count",
            (F.col("exact_pairs") + F.col("comparisons")).alias("total_comparisons_count"),
            "duplicate_group_count",
            (F.col("exact_pairs") + F.col("duplicates")).alias("duplicate_pairs_count"),
            F.col("ambiguous").alias("ambiguous_pairs_count"),
            "skipped_block_count",
            F.map_from_entries(F.filter(by_rule, lambda e: e["n"] > 0)).alias("decisions_by_rule"),
            "confidence_score",
            F.lit(MATCHING_VERSION).alias("match_engine_version"),
        )


def _cut_chains(chained: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` links in (group, row) order, found through a count per (group, row bucket)."""
    placed = chained.withColumn("_bucket", bucket_of(ROW))
    counts = placed.groupBy("rep", "_bucket").count().orderBy("rep", "_bucket").limit(limit)
    needed = offsets(counts, ["rep", "_bucket"]).where(F.col("_start") < limit).select("rep", "_bucket")
    return placed.join(needed, ["rep", "_bucket"], "left_semi").drop("_bucket").orderBy("rep", ROW).limit(limit)


def _unique(headers: tuple[str, ...]) -> list[str]:
    """Map keys must differ: a repeated header gets its position behind it."""
    return [h if h not in headers[:i] else f"{h}#{i}" for i, h in enumerate(headers)]


def match(
    table: CellTable,
    rules: MatchRules | None = None,
    limits: MatchLimits = MatchLimits(),
    audit: AuditLimits = AuditLimits(),
    run_id: str = "run",
    checkpoint: bool = True,
) -> Match:
    return Match(table, rules, limits, audit, run_id, checkpoint)
