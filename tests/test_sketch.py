"""Merged sketches against profiles of everything."""

import random

from tidyledger.config import ProfileLimits
from tidyledger.operators import profile, sketch
from tidyledger.sources.tables import from_frame

SCHEMA = "row_index bigint, a string, b string, empty string"


def rows(number, seed=2):
    draw = random.Random(seed)
    made = [(i, f" v{draw.randrange(number)}", draw.choice(["1", "2.5", "x", "", "true"]), "") for i in range(number)]
    draw.shuffle(made)
    return made


def test_sources_merge_to_the_profile_of_everything(spark):
    made = rows(900)
    limits = ProfileLimits(max_distinct_values=7, max_sample_values=3)
    parts = [
        sketch.column_sketches(from_frame(spark.createDataFrame(made[n::3], SCHEMA).repartition(4), "row_index"), f"s{n}", limits)
        for n in range(3)
    ]
    merged = {r.name: r for r in sketch.merged_profiles(parts[2].unionByName(parts[0]).unionByName(parts[1]), limits).collect()}
    whole = profile.column_profiles(from_frame(spark.createDataFrame(made, SCHEMA), "row_index"), limits)
    for exact in whole.collect():
        found = merged[exact.name]
        same = ("position", "inferred_type", "dominant_type", "non_null_count", "missing_count", "missing_percentage",
                "inconsistent_value_count", "observed_type_counts", "distinct_values_truncated")
        assert all(found[c] == exact[c] for c in same)
        assert abs(found.distinct_count - exact.distinct_count) <= 0.03 * exact.distinct_count
    first = []
    for n in range(3):
        for _, value, _, _ in sorted(made[n::3]):
            if value.strip() not in first:
                first.append(value.strip())
    assert merged["a"].retained_distinct_values == first[:7] and merged["a"].sample_values == first[:3]


def test_estimate_of_many_values(spark):
    frame = spark.range(60_000).selectExpr("id as row_index", "cast(id * 7 as string) as a", "cast(id % 40000 as string) as b")
    merged = sketch.merged_profiles(sketch.column_sketches(from_frame(frame, "row_index"), "s")).collect()
    counts = {r.name: r.distinct_count for r in merged}
    assert abs(counts["a"] - 60_000) < 0.03 * 60_000 and abs(counts["b"] - 40_000) < 0.03 * 40_000


def test_new_sources_and_empty_ones(spark):
    empty = sketch.column_sketches(from_frame(spark.createDataFrame([], SCHEMA), "row_index"), "none")
    stored = empty.unionByName(sketch.column_sketches(from_frame(spark.createDataFrame(rows(5), SCHEMA), "row_index"), "s1"))
    assert sketch.new_sources(stored, ["s1", "s2", "none"]) == ["s2"]
    found = {r.name: r for r in sketch.merged_profiles(empty).collect()}
    assert found["a"].inferred_type == "null" and found["a"].distinct_count == 0 and found["a"].sample_values == []
    assert sketch.merged_profiles(stored).count() == 3
