"""The numbered operators over the driver tables: each query maps a table to its operator and the result back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm import (
    backoff,
    chat,
    decontaminate,
    disclosure,
    exact,
    html_text,
    infill,
    packing,
    quality,
    repair,
    secrets,
    simhash,
    toxicity,
)
from tidyledger.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(doc_id: str, parts: int):
    return F.crc32(F.col(doc_id).cast("string")) % parts


@query
def op1_toxicity_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    seen = labels.where(_remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    model = toxicity.fit(documents, seen, "text", "toxic", "doc_id")
    scored = toxicity.toxic_cells(documents, "text", model, "doc_id")
    return scored.select(
        F.col("row_index").alias("doc_id"),
        (_remainder("row_index", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op10_quality_by_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    scored = quality.good_cells(documents, "text", quality_model(spark, documents, sf_dir), "doc_id")
    return scored.select(
        F.col("row_index").alias("doc_id"),
        (_remainder("row_index", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


GOOD = 0.3  # score from which a document counts as good


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> bytes:
    """Fitted on labelled documents outside the held-out fifth."""
    seen = load(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0).select("doc_id", "quality")
    return quality.fit(documents, seen, "text", "quality", "doc_id")


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select(
        F.col("row_index").alias("doc_id"), "fingerprint", F.col("canonical_row_index").alias("component_id")
    )


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(load(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select(
        F.col("row_index").alias("doc_id"),
        F.col("canonical_row_index").alias("keep_id"),
        "group_size",
        F.col("is_canonical").alias("kept"),
        F.col("cell_sha256").alias("text_sha256"),
    )


ORACLES["op8_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
        sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]', '', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query
def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_cells(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "text", "text", "doc_id", "item_id"
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("row_index").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("entry_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("entry_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.packed_cells(documents, "text", path, "doc_id", added=True)
    return packed.select(
        F.col("row_index").alias("doc_id"),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        "offset",
    )


@query
def op2_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.disclosing_cells(load(spark, sf_dir, "documents"), "text", "doc_id")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != disclosure.TERM)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row_index").alias("doc_id"),
        *[count(kind) for kind in disclosure.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


CONTROL = r"\### Assistant: </turn> ok"


@query
def op3_relational_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    made = chat.formatted_chats(turns.unionByName(control), "conv_id")
    told = made.withColumn("turns", chat.read_turns("formatted"))
    told = told.withColumn("learned", chat.read_trained("formatted", "loss_mask"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        F.col("chat_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op3_relational_chat_format"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v (n, r)
), e AS (
    SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
        length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_chars,
        length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS role_chars
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        CAST(sum(text_chars + CASE WHEN before IS DISTINCT FROM role THEN 7 + role_chars ELSE 6 END
            + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
    formatted_chars
FROM g
"""


@query
def op9_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_text.extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_stupid_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = backoff.backoff_scores(documents, "text", path, "doc_id", added=True)
    return found.select(F.col("row_index").alias("doc_id"), "n_tokens", "score", "mean_score")


@query
def op13_fill_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infilled_cells(load(spark, sf_dir, "documents"), "text", "doc_id")
    return made.select(
        F.col("row_index").alias("doc_id"),
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"),
    )


ORACLES["op13_fill_in_the_middle"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), c AS (
    SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one,
        CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS other,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT *, array_to_string(units[1:least(one, other)], '') AS prefix,
        array_to_string(units[least(one, other) + 1:greatest(one, other)], '') AS middle,
        array_to_string(units[greatest(one, other) + 1:], '') AS suffix
    FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


def _damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with one in four damaged, by the hash of conversation and turn; null is one space."""
    space = F.lit(" ")
    place = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    damage = (F.crc32(F.concat_ws(":", *place)) % 20).alias("damage")
    whole = turns.select("conv_id", "turn", *[F.coalesce(c, space).alias(c) for c in ("role", "text")], damage)
    text = (
        F.when(F.col("damage") == 1, "")
        .when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = whole.where("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("n"))
    return kept.select("conv_id", "turn", "role", "text", F.explode("n")).drop("col")


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mended = repair.repaired_chats(_damaged(turns), "conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id").distinct()
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    return every.join(mended, F.col("conv_id").eqNullSafe(F.col("chat_id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256"),
    )


@query
def op11_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("organization_id"),
        F.concat_ws(":", "source", "lang").alias("data_source_id"),
    )
    found = secrets.secret_cells(documents, "text", "doc_id")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def judged(verdict: str):
        return F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long").alias(f"n_{verdict}")

    return found.select(
        F.col("row_index").alias("doc_id"),
        *[count(kind) for kind in secrets.KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != secrets.OWNED)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        judged("live"),
        judged("example"),
    )


ORACLES["op11_secret_ownership"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, source AS owner,
        coalesce(source || ':' || lang, source, lang, '') AS repository
    FROM documents
), p (kind, rank, least, pattern) AS (
    VALUES ('assign', 1, 6, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|'
            || '[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
        ('access', 2, 20, 'AKIA[A-Z0-9]+'), ('hex', 3, 24, '[0-9a-f]+'), ('owned', 4, 0, '[A-Za-z0-9+_=-]{20,}')
), h AS (
    SELECT k, kind, rank, least, owner, repository, unnest(regexp_extract_all(text, pattern)) AS hit,
        unnest([length(x) FOR x IN string_split_regex(text, pattern)][:-2]) AS gap,
        unnest(range(len(regexp_extract_all(text, pattern)))) AS n
    FROM d, p WHERE regexp_matches(text, pattern)
), s AS (
    SELECT *, CAST(sum(gap + length(hit)) OVER (PARTITION BY k, kind ORDER BY n) AS BIGINT) AS stop,
        CASE kind WHEN 'assign' THEN regexp_extract(hit, (SELECT pattern FROM p WHERE rank = 1), 1) ELSE hit END AS value
    FROM h
), f AS (
    SELECT *, stop - length(hit) AS start FROM s WHERE length(value) >= least AND (kind <> 'owned' OR (
        regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
        AND len(list_distinct(string_split(value, ''))) >= 12))
), c AS (
    SELECT *, max(CASE WHEN kind <> 'owned' THEN stop END) OVER (PARTITION BY k ORDER BY start, kind = 'owned'
        ROWS UNBOUNDED PRECEDING) AS covered
    FROM f
), g AS (SELECT * FROM c WHERE kind <> 'owned' OR covered IS NULL OR covered <= start
), v AS (
    SELECT value, max(CASE WHEN kind <> 'owned' THEN 1 ELSE 0 END) AS announced,
        count(DISTINCT owner) + max(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) AS owners
    FROM g GROUP BY value
), j AS (
    SELECT g.*, CASE WHEN owners >= 3 THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict, announced
    FROM g JOIN v USING (value)
), t AS (
    SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
    FROM j WHERE kind <> 'owned' OR verdict = 'live' OR (announced = 1 AND verdict <> 'example') GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN t USING (k)
"""
