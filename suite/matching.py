"""Duplicate detection and export over documents and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import cells, fixture_sql, fold_sql, load, query
from tidyledger.config import AuditLimits, MatchField, MatchLimits, MatchRules
from tidyledger.operators import export
from tidyledger.operators.match import match
from tidyledger.sources.tables import from_frame

ALL = AuditLimits(None, None, None)
SINGLE = MatchRules(0.9, 0.4, (MatchField("email"),))
COMPOSITE = MatchRules(0.7, 0.4, (MatchField("email", weight=1.0), MatchField("name", weight=0.3), MatchField("zone", weight=0.3)))
CAP = 40  # of the queries that show a capped log; all others match blocks of any size
ANY = 10**12
WHOLE = MatchLimits()

DOCS = "(SELECT doc_id AS row_index, text, lang, source FROM documents)"
PEOPLE = f"({fixture_sql('people')})"


def _docs(spark, sf_dir):
    return from_frame(load(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"])


def _people(spark, sf_dir):
    return cells(spark, sf_dir, "people")


def exact_sql(source: str, columns: str) -> str:
    return f"""rows AS (SELECT * FROM {source}),
    keyed AS (SELECT row_index, min(row_index) OVER w AS rep, count(*) OVER (PARTITION BY {columns}) AS row_size,
                     lead(row_index) OVER (PARTITION BY {columns} ORDER BY row_index) AS nxt FROM rows
              WINDOW w AS (PARTITION BY {columns}))"""


EXACT_DOCS = exact_sql(DOCS, "text, lang, source")
P_COLS = "email, name, zone"
_TOTAL = "(1.0::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE)"


def people_sql(cap: int, single: bool) -> str:
    score = (
        "1.0::DOUBLE"
        if single
        else "((1.0::DOUBLE + CASE WHEN a.fname = b.fname THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
        f" + CASE WHEN a.fzone = b.fzone THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) / {_TOTAL}"
    )
    high = 0.9 if single else 0.7
    return f"""WITH RECURSIVE {exact_sql(PEOPLE, P_COLS)},
    cand AS (SELECT k.row_index AS rep, {fold_sql("email")} AS bk, {fold_sql("name")} AS fname, {fold_sql("zone")} AS fzone
             FROM keyed k JOIN rows r USING (row_index) WHERE k.row_index = k.rep AND {fold_sql("email")} <> ''),
    blocks AS (SELECT bk, count(*) AS block_size FROM cand GROUP BY bk),
    pairs AS (SELECT a.bk, a.rep AS a, b.rep AS b, {score} AS score
              FROM cand a JOIN cand b ON a.bk = b.bk AND a.rep < b.rep
              JOIN blocks ON blocks.bk = a.bk AND block_size <= {cap}),
    judged AS (SELECT *, CASE WHEN score >= {high} THEN 'duplicate' WHEN score >= 0.4 THEN 'ambiguous' END AS decision FROM pairs),
    edges AS (SELECT a, b, score FROM judged WHERE decision = 'duplicate'
              UNION ALL SELECT row_index, nxt, CAST(1.0 AS DOUBLE) FROM keyed WHERE nxt IS NOT NULL),
    both_ways AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
    reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
    member AS (SELECT x AS row_index, least(x, min(y)) AS canonical FROM reach GROUP BY x),
    low AS (SELECT canonical, min(score) AS confidence_score FROM edges JOIN member ON row_index = a GROUP BY canonical),
    grp AS (SELECT canonical AS canonical_row_index, count(*) AS record_count FROM member GROUP BY canonical)"""


# ---- exact rows ------------------------------------------------------------------------------------


@query(
    "match_exact_rows",
    f"WITH {EXACT_DOCS} SELECT rep, row_index AS a, nxt AS b, row_size FROM keyed WHERE nxt IS NOT NULL",
)
def match_exact_rows(spark, sf_dir):
    return match(_docs(spark, sf_dir), audit=ALL).exact_decisions


@query(
    "match_exact_groups",
    f"WITH {exact_sql(PEOPLE, P_COLS)} SELECT rep AS canonical_row_index, count(*) AS record_count,"
    " 1.0 AS confidence_score FROM keyed WHERE row_size > 1 GROUP BY rep",
)
def match_exact_groups(spark, sf_dir):
    return match(_people(spark, sf_dir)).groups.drop("group_id")


@query(
    "match_pages_exact",
    "SELECT count(*) AS row_count, count(*) - count(DISTINCT html) AS duplicate_pairs_count FROM pages",
)
def match_pages_exact(spark, sf_dir):
    table = from_frame(load(spark, sf_dir, "pages"), "page_id", ["html"])
    return match(table).summary.select("row_count", "duplicate_pairs_count")


# ---- blocks ----------------------------------------------------------------------------------------


@query("match_blocks", f"{people_sql(10**9, True)} SELECT bk AS block_key, block_size FROM blocks")
def match_blocks(spark, sf_dir):
    return match(_people(spark, sf_dir), SINGLE).blocks


_EVENT_SQL = """WITH rows AS (SELECT event_id AS row_index, CAST(user_id AS VARCHAR) AS bk FROM events),
    sized AS (SELECT *, count(*) OVER (PARTITION BY bk) AS block_size,
                     row_number() OVER (PARTITION BY bk ORDER BY row_index) AS r FROM rows)
    SELECT bk AS blocking_key, max(block_size) AS block_size,
           string_agg(CAST(row_index AS VARCHAR), ',' ORDER BY row_index) AS sample
    FROM sized WHERE block_size > 50 AND r <= 20 GROUP BY bk"""


@query("match_skipped_blocks", _EVENT_SQL)
def match_skipped_blocks(spark, sf_dir):
    table = from_frame(load(spark, sf_dir, "events"), "event_id", ["user_id", "ts", "event_type", "value", "props"])
    rules = MatchRules(0.9, 0.4, (MatchField("user_id"),))
    skipped = match(table, rules, MatchLimits(max_block_size=50)).skipped_blocks
    return skipped.select(
        "blocking_key", "block_size",
        F.array_join(F.transform("sample_row_indices", lambda i: i.cast("string")), ",").alias("sample"),
    )


# ---- pairs -----------------------------------------------------------------------------------------

_PAIR = "bk AS block_key, a, b, round(score, 9) AS total_score, decision"


@query("match_pairs_single", f"{people_sql(CAP, True)} SELECT {_PAIR} FROM judged WHERE decision IS NOT NULL")
def match_pairs_single(spark, sf_dir):
    run = match(_people(spark, sf_dir), SINGLE, MatchLimits(CAP), ALL)
    return _pairs(run)


@query("match_pairs_composite", f"{people_sql(CAP, False)} SELECT {_PAIR} FROM judged WHERE decision IS NOT NULL")
def match_pairs_composite(spark, sf_dir):
    run = match(_people(spark, sf_dir), COMPOSITE, MatchLimits(CAP), ALL)
    return _pairs(run)


def _pairs(run):
    return run.field_decisions.select(
        "block_key", "a", "b", F.round("total_score", 9).alias("total_score"), "decision"
    )


@query(
    "match_pair_counts",
    f"{people_sql(ANY, False)} SELECT bk AS block_key, count(*) AS comparisons,"
    " count(*) FILTER (WHERE decision = 'duplicate') AS duplicates,"
    " count(*) FILTER (WHERE decision = 'ambiguous') AS ambiguous FROM judged GROUP BY bk",
)
def match_pair_counts(spark, sf_dir):
    counts = match(_people(spark, sf_dir), COMPOSITE, WHOLE).block_pairs
    return counts.select("block_key", *[F.col(c).cast("long") for c in ("comparisons", "duplicates", "ambiguous")])


@query(
    "match_links",
    f"{people_sql(ANY, True)}, f AS (SELECT bk, min(rep) AS a FROM cand GROUP BY bk)"
    " SELECT bk AS block_key, a, rep AS b, 1.0 AS total_score, 'duplicate' AS decision FROM cand JOIN f USING (bk)"
    " WHERE rep <> a",
)
def match_links(spark, sf_dir):
    """Without a block limit: one link per row to the first row it agrees with."""
    return _pairs(match(_people(spark, sf_dir), SINGLE, WHOLE, ALL))


# Links of a row are to the first row with its name, its zone, and its key alone; a pair counts under the first of these.
LINKED = f"""{people_sql(ANY, False)},
    f AS (SELECT *, min(rep) OVER (PARTITION BY bk, fname) AS by_name, min(rep) OVER (PARTITION BY bk, fzone) AS by_zone,
                 min(rep) OVER (PARTITION BY bk) AS by_key FROM cand),
    links AS (SELECT bk, by_name AS a, rep AS b FROM f WHERE by_name <> rep
              UNION ALL SELECT f.bk, by_zone, f.rep FROM f JOIN cand h ON h.rep = by_zone WHERE by_zone <> f.rep AND h.fname <> f.fname
              UNION ALL SELECT f.bk, by_key, f.rep FROM f JOIN cand h ON h.rep = by_key
              WHERE by_key <> f.rep AND h.fname <> f.fname AND h.fzone <> f.fzone),
    seen AS (SELECT l.*, x.fname AS name_a, y.fname AS name_b, x.fzone AS zone_a, y.fzone AS zone_b,
                    ((1.0::DOUBLE + CASE WHEN x.fname = y.fname THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
                     + CASE WHEN x.fzone = y.fzone THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) / {_TOTAL} AS score,
                    CASE WHEN x.fname = y.fname OR x.fzone = y.fzone THEN 'duplicate' ELSE 'ambiguous' END AS decision
             FROM links l JOIN cand x ON x.rep = a JOIN cand y ON y.rep = b)"""


@query("match_links_composite", f"{LINKED} SELECT {_PAIR} FROM seen")
def match_links_composite(spark, sf_dir):
    """Without a block limit: links of each row to the first rows it agrees with."""
    return _pairs(match(_people(spark, sf_dir), COMPOSITE, WHOLE, ALL))


_LOGGED = f"""{people_sql(CAP, False)},
    log AS (SELECT 1 AS stage, rep AS o, CAST(NULL AS VARCHAR) AS blocking_key, row_index AS a, nxt AS b, CAST(1.0 AS DOUBLE) AS score, 'duplicate' AS decision,
                   'exact_row_match' AS rule_name FROM keyed WHERE nxt IS NOT NULL
            UNION ALL SELECT 2, 0, bk, a, b, score, decision, 'composite_weighted_match' FROM judged WHERE decision IS NOT NULL)
    SELECT blocking_key, a AS record_a_row_index, b AS record_b_row_index, round(score, 9) AS total_score, decision,
           rule_name, CASE WHEN decision = 'duplicate' THEN canonical END AS canonical_row_index
    FROM log LEFT JOIN member ON row_index = a ORDER BY stage, o, blocking_key, a, b LIMIT 9000"""


@query("match_decision_log_cap", _LOGGED)
def match_decision_log_cap(spark, sf_dir):
    run = match(_people(spark, sf_dir), COMPOSITE, MatchLimits(CAP), AuditLimits(max_decisions=9000))
    owners = run.groups.select(F.col("group_id").alias("match_group_id"), "canonical_row_index")
    return run.decisions.join(owners, "match_group_id", "left").select(
        "blocking_key", "record_a_row_index", "record_b_row_index", F.round("total_score", 9).alias("total_score"),
        "decision", "rule_name", "canonical_row_index",
    )


# ---- groups ----------------------------------------------------------------------------------------

_GROUPS = "SELECT canonical_row_index, record_count, round(confidence_score, 9) AS confidence_score FROM grp JOIN low ON canonical = canonical_row_index"


def _groups(run):
    return run.groups.select(
        "canonical_row_index", "record_count", F.round("confidence_score", 9).alias("confidence_score")
    )


@query("match_groups", f"{people_sql(ANY, False)} {_GROUPS}")
def match_groups(spark, sf_dir):
    return _groups(match(_people(spark, sf_dir), COMPOSITE, WHOLE))


@query("match_groups_single", f"{people_sql(ANY, True)} {_GROUPS}")
def match_groups_single(spark, sf_dir):
    return _groups(match(_people(spark, sf_dir), SINGLE, WHOLE))


@query("match_groups_uncapped", f"{people_sql(ANY, True)} {_GROUPS}")
def match_groups_uncapped(spark, sf_dir):
    return _groups(match(_people(spark, sf_dir), SINGLE, WHOLE))


@query("match_members", f"{people_sql(ANY, False)} SELECT canonical AS canonical_row_index, row_index FROM member")
def match_members(spark, sf_dir):
    run = match(_people(spark, sf_dir), COMPOSITE, WHOLE)
    return run.members.select("canonical_row_index", "row_index")


@query(
    "match_group_index",
    f"{people_sql(ANY, True)} SELECT canonical_row_index, row_number() OVER (ORDER BY canonical_row_index) - 1 AS group_index FROM grp",
)
def match_group_index(spark, sf_dir):
    from tidyledger.plans.order import number_rows

    groups = match(_people(spark, sf_dir), SINGLE, WHOLE).groups.select("canonical_row_index")
    return number_rows(groups, "canonical_row_index", "group_index")


_SUMMARY = f"""{people_sql(ANY, False)} SELECT (SELECT count(*) FROM rows) AS row_count,
    (SELECT count(*) FROM judged) + (SELECT count(*) FROM keyed WHERE nxt IS NOT NULL) AS total_comparisons_count,
    (SELECT count(*) FROM grp) AS duplicate_group_count, (SELECT count(*) FROM edges) AS duplicate_pairs_count,
    (SELECT count(*) FROM judged WHERE decision = 'ambiguous') AS ambiguous_pairs_count,
    (SELECT count(*) FROM blocks WHERE block_size > {ANY}) AS skipped_block_count,
    (SELECT round(min(confidence_score), 9) FROM low) AS confidence_score,
    (SELECT string_agg(rule || '=' || CAST(n AS VARCHAR), ';' ORDER BY rule) FROM (
        SELECT 'exact_row_match' AS rule, count(*) AS n FROM keyed WHERE nxt IS NOT NULL
        UNION ALL SELECT 'composite_weighted_match', count(*) FROM judged WHERE decision IS NOT NULL) WHERE n > 0
    ) AS decisions_by_rule"""


@query("match_summary", _SUMMARY)
def match_summary(spark, sf_dir):
    s = match(_people(spark, sf_dir), COMPOSITE, WHOLE).summary
    counts = [c for c in s.columns if c.endswith("_count")]
    by_rule = F.array_sort(F.map_entries("decisions_by_rule"))
    listed = F.array_join(F.transform(by_rule, lambda e: F.concat_ws("=", e["key"], e["value"].cast("long"))), ";")
    return s.select(
        *[F.col(c).cast("long") for c in counts],
        F.round("confidence_score", 9).alias("confidence_score"),
        listed.alias("decisions_by_rule"),
    )


# ---- many fields ------------------------------------------------------------------------------------

MANY = MatchRules(
    0.75, 0.5,
    (MatchField("customer", weight=3.0), *(MatchField(f"k{i}", weight=1.0) for i in range(8))),
)
_ORDERS = (
    "SELECT o_orderkey AS row_index, CAST(o_custkey AS STRING) AS customer, o_orderstatus AS k0, o_orderpriority AS k1,"
    " CAST(o_orderkey % 2 AS STRING) AS k2, CAST(o_orderkey % 3 AS STRING) AS k3, CAST(o_custkey % 4 AS STRING) AS k4,"
    " CAST(o_orderkey % 5 AS STRING) AS k5, substr(CAST(o_orderdate AS STRING), 1, 3) AS k6,"
    " substr(CAST(o_orderdate AS STRING), 6, 2) AS k7 FROM orders"
)
_AGREED = " + ".join(["3.0", *(f"CASE WHEN lower(a.k{i}) = lower(b.k{i}) THEN 1.0 ELSE 0.0 END" for i in range(8))])


@query(
    "match_pair_counts_many_fields",
    f"""WITH o AS ({_ORDERS}), d AS (SELECT * EXCLUDE (row_index), min(row_index) AS rep FROM o GROUP BY ALL),
    s AS (SELECT a.customer AS block_key, ({_AGREED}) / 11.0 AS score FROM d a JOIN d b ON a.customer = b.customer AND a.rep < b.rep)
    SELECT block_key, count(*) AS comparisons, count(*) FILTER (WHERE score >= 0.75) AS duplicates,
        count(*) FILTER (WHERE score >= 0.5 AND score < 0.75) AS ambiguous FROM s GROUP BY block_key""",
)
def match_pair_counts_many_fields(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    table = from_frame(spark.sql(_ORDERS), "row_index")
    counts = match(table, MANY).block_pairs
    return counts.select("block_key", *[F.col(c).cast("long") for c in ("comparisons", "duplicates", "ambiguous")])


# ---- export ----------------------------------------------------------------------------------------


def _export(spark, sf_dir, limits=ALL):
    table = _people(spark, sf_dir)
    return export.Export(table, match(table, COMPOSITE, WHOLE).members, limits)


@query(
    "export_rows",
    f"{people_sql(ANY, False)} SELECT row_index, email, name, zone, 'True' AS __dq_canonical_record,"
    " CAST(row_index AS VARCHAR) AS __dq_source_row_index FROM rows"
    " WHERE row_index NOT IN (SELECT row_index FROM member WHERE row_index <> canonical)",
)
def export_rows(spark, sf_dir):
    return _export(spark, sf_dir).rows.named()


_EXCLUDED = (
    f"{people_sql(ANY, False)} SELECT row_index, canonical AS canonical_row_index,"
    " 'row ' || CAST(row_index AS VARCHAR) || ' excluded: member of duplicate group (canonical row_index=' ||"
    " CAST(canonical AS VARCHAR) || ', ' || CAST(record_count AS VARCHAR) || ' members)' AS reason"
    " FROM member JOIN grp ON canonical = canonical_row_index WHERE row_index <> canonical"
)


@query("export_exclusions", _EXCLUDED)
def export_exclusions(spark, sf_dir):
    return _export(spark, sf_dir).exclusions.drop("match_group_id", "rule_version")


@query("export_exclusions_cap", f"{_EXCLUDED} ORDER BY row_index LIMIT 300")
def export_exclusions_cap(spark, sf_dir):
    log = _export(spark, sf_dir, AuditLimits(max_exclusions=300)).exclusions
    return log.drop("match_group_id", "rule_version")


@query(
    "export_counts",
    f"{people_sql(ANY, False)} SELECT count(*) AS source_row_count,"
    " count(*) - (SELECT count(*) FROM member WHERE row_index <> canonical) AS row_count,"
    " (SELECT count(*) FROM member WHERE row_index <> canonical) AS excluded_row_count,"
    " (SELECT count(*) FROM grp) AS duplicate_groups_materialized_count, 5 AS output_column_count FROM rows",
)
def export_counts(spark, sf_dir):
    return _export(spark, sf_dir).summary


@query(
    "group_membership_check",
    f"{people_sql(ANY, True)} SELECT canonical_row_index, record_count, record_count AS member_count, true AS complete FROM grp",
)
def group_membership_check(spark, sf_dir):
    run = match(_people(spark, sf_dir), SINGLE, WHOLE, ALL)
    return export.rebuild_membership(run.decisions, run.groups).drop("group_id")
