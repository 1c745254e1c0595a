"""Queries over evidence: signals, choice, packing, constraints (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import evidence as ev
from verdigris.sources.tables import table

ISSUE, KEY = "turn_row_id", "evidence_row_id"
REQUIRED = ["amount", "deadline", "definition"]
RULES = [
    {"name": "pay_at_night", "priority": 1, "all": [["đêm"], ["phụ cấp", "lương", "tiền"]], "none": []},
    {"name": "leaving_early", "priority": 2, "all": [["nghỉ việc", "thôi việc"], ["phạt", "trước"]], "none": ["tai nạn"]},
    {"name": "accident_office", "priority": 3, "all": [["tai nạn"], ["giải quyết", "bồi thường"]], "none": []},
    {"name": "never", "priority": 0, "all": [], "none": []},
]


def _evidence(spark, d):
    return table(spark, d, "scored_evidence")


def e_signals(spark: SparkSession, d: str) -> DataFrame:
    """Rank, overlap and role signals of every row, and their weighted total."""
    q = table(spark, d, "turns").select(F.col("turn_row_id"), t.token_set(F.col("user_query")).alias("q"))
    e = _evidence(spark, d).select(KEY, ISSUE, "semantic_score", "evidence_roles", t.token_set(F.col("content")).alias("c")).join(q, ISSUE, "left")
    overlap = F.size(F.array_intersect("q", "c")) / F.greatest(F.lit(1), F.size("q"))
    # Numbers only go on to the window.
    scored = e.select(KEY, ISSUE, "semantic_score", F.when(F.col("q").isNotNull(), overlap).alias("lexical"), (F.least(F.size("evidence_roles"), F.lit(3)) / 3).alias("roles"))
    ranked = scored.withColumn("semantic", ev.rank_signal(ISSUE, "semantic_score", KEY))
    signals = {name: (F.col(name), weight) for name, weight in (("semantic", 1.0), ("lexical", 1.0), ("roles", 2.5))}
    return ranked.select(KEY, *[F.round(name, 6).alias(name) for name in signals], F.round(ev.weighted(signals), 5).alias("total"))


def e_siblings(spark: SparkSession, d: str) -> DataFrame:
    return ev.sibling_bonus(_evidence(spark, d), ISSUE, ["doc_id", "article_number"], "total_score", KEY).select(KEY, "bonus")


def e_winners(spark: SparkSession, d: str) -> DataFrame:
    return ev.winners(_evidence(spark, d), ISSUE, "total_score", KEY)


def e_role_cover(spark: SparkSession, d: str) -> DataFrame:
    return ev.role_cover(_evidence(spark, d), ISSUE, "evidence_roles", "total_score", KEY)


def e_fair_share(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a conversation, one row of each turn in turn, at most 4 per turn and 10 in all."""
    conv = table(spark, d, "turns").select("turn_row_id", "conv_id")
    e = ev.capped(_evidence(spark, d).join(conv, ISSUE), ISSUE, [F.col("total_score").desc_nulls_last(), F.col(KEY)], 4)
    shared = ev.fair_share(e, "conv_id", ISSUE, [F.col("total_score").desc_nulls_last(), F.col(KEY)], KEY)
    return shared.where("position <= 10").select("conv_id", KEY, "turn", "position")


def e_budget(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of a conversation that fits into 1,500 characters."""
    sized = e_fair_share(spark, d).join(_evidence(spark, d).select(KEY, F.coalesce(F.length("content"), F.lit(0)).alias("n")), KEY)
    return ev.within_budget(sized, "conv_id", "position", F.col("n"), 1500).select("conv_id", KEY, "position", "spent")


def e_completeness(spark: SparkSession, d: str) -> DataFrame:
    return ev.completeness(_evidence(spark, d), ISSUE, "evidence_roles", REQUIRED)


def e_constraints(spark: SparkSession, d: str) -> DataFrame:
    return ev.plan_constraints(table(spark, d, "turns"), "turn_row_id", "user_query", RULES)


def e_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct points of a clause as one block, in the order of their letters (đ after d)."""
    e = _evidence(spark, d).where("point <> '' AND content IS NOT NULL")
    letter = F.when(F.col("point") == "đ", F.lit("d~")).otherwise(F.col("point"))
    newest = e.groupBy("doc_id", "article_number", "clause_number", letter.alias("letter")).agg(F.max_by("content", F.struct("index_version", KEY)).alias("c"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", "c"))), lambda x: x["c"]), "\n")
    packed = newest.groupBy("doc_id", "article_number", "clause_number").agg(F.count("*").alias("n_points"), F.md5(block).alias("block_md5"))
    return packed


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("e_")}


def oracle_sql() -> dict:
    rn = "row_number() OVER (PARTITION BY turn_row_id ORDER BY {} DESC NULLS LAST, evidence_row_id)"
    fair = """c AS (SELECT e.*, conv_id FROM scored_evidence e JOIN (SELECT turn_row_id, conv_id FROM turns) t USING (turn_row_id)
 QUALIFY row_number() OVER (PARTITION BY turn_row_id ORDER BY total_score DESC NULLS LAST, evidence_row_id) <= 4),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn_row_id ORDER BY total_score DESC NULLS LAST, evidence_row_id)::INT AS turn FROM c),
s AS (SELECT conv_id, evidence_row_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn_row_id, evidence_row_id)::INT AS position FROM f QUALIFY position <= 10)"""
    cases = []
    for rule in RULES:
        groups = [t.sql_contains_any("user_query", g) for g in rule["all"]] or ["false"]
        none = [f"NOT {t.sql_contains_any('user_query', [w])}" for w in rule["none"]]
        cases.append(f"SELECT turn_row_id, '{rule['name']}' AS rule, {rule['priority']} AS priority FROM turns WHERE {' AND '.join(groups + none)}")
    union = " UNION ALL ".join(cases)
    need = "[" + ", ".join(f"'{r}'" for r in REQUIRED) + "]"
    return {
        "e_signals": f"""WITH x AS (SELECT e.evidence_row_id, e.turn_row_id, evidence_roles, list_distinct({t.sql_tokens('content')}) AS c, q,
 1 - ({rn.format('semantic_score')} - 1) / count(*) OVER (PARTITION BY turn_row_id) AS semantic
 FROM scored_evidence e LEFT JOIN (SELECT turn_row_id, list_distinct({t.sql_tokens('user_query')}) AS q FROM turns) USING (turn_row_id)),
y AS (SELECT *, CASE WHEN q IS NOT NULL THEN len(list_intersect(q, c)) / greatest(1, len(q)) END AS lexical, least(len(evidence_roles), 3) / 3 AS roles FROM x)
SELECT evidence_row_id, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(roles, 6) AS roles,
 round(semantic + coalesce(lexical, 0.0::DOUBLE) + coalesce(roles, 0.0::DOUBLE) * 2.5::DOUBLE, 5) AS total FROM y""",
        "e_siblings": """SELECT evidence_row_id, CASE WHEN row_number() OVER (w ORDER BY total_score DESC NULLS LAST, evidence_row_id) = 1
 AND count(*) OVER w > 1 AND total_score > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM scored_evidence WINDOW w AS (PARTITION BY turn_row_id, doc_id, article_number)""",
        "e_winners": f"""WITH x AS (SELECT turn_row_id, evidence_row_id AS winner, total_score AS best_score, {rn.format('total_score')} AS n,
 lead(total_score) OVER (PARTITION BY turn_row_id ORDER BY total_score DESC NULLS LAST, evidence_row_id) AS second_score FROM scored_evidence)
SELECT turn_row_id, winner, best_score, second_score, round(best_score - coalesce(second_score, 0.0::DOUBLE), 6) AS margin,
 coalesce(best_score < 0.5, true) OR round(best_score - coalesce(second_score, 0.0::DOUBLE), 6) < 0.1::DOUBLE AS unclear FROM x WHERE n = 1""",
        "e_role_cover": """WITH h AS (SELECT turn_row_id, evidence_row_id, total_score, unnest(list_distinct(evidence_roles)) AS role FROM scored_evidence WHERE total_score > 0)
SELECT turn_row_id, role, evidence_row_id, total_score FROM h QUALIFY row_number() OVER (PARTITION BY turn_row_id, role ORDER BY total_score DESC, evidence_row_id) = 1""",
        "e_fair_share": f"WITH {fair} SELECT conv_id, evidence_row_id, turn, position FROM s",
        "e_budget": f"""WITH {fair}, n AS (SELECT s.*, coalesce(length(content), 0) AS n FROM s JOIN scored_evidence USING (evidence_row_id)),
b AS (SELECT *, sum(n + 42) OVER (PARTITION BY conv_id ORDER BY position)::BIGINT AS spent FROM n),
m AS (SELECT *, min(CASE WHEN spent > 1500 AND position > 2 THEN position END) OVER (PARTITION BY conv_id) AS breach FROM b)
SELECT conv_id, evidence_row_id, position, spent FROM m WHERE breach IS NULL OR position < breach""",
        "e_completeness": f"""WITH r AS (SELECT turn_row_id, count(*) AS n_rows, flatten(list(coalesce(evidence_roles, []))) AS have FROM scored_evidence GROUP BY turn_row_id),
x AS (SELECT turn_row_id, n_rows, len(list_intersect(list_distinct(have), {need}))::INT AS n_covered FROM r)
SELECT turn_row_id, n_rows, n_covered, round(n_covered / {len(REQUIRED)}, 6) AS ratio,
 CASE WHEN n_covered = {len(REQUIRED)} THEN 'PASS' WHEN n_covered / {len(REQUIRED)} >= 0.5 THEN 'PARTIAL' WHEN n_covered > 0 THEN 'INCOMPLETE' ELSE 'FAIL' END AS verdict FROM x""",
        "e_constraints": f"WITH u AS ({union}) SELECT turn_row_id, row_number() OVER (PARTITION BY turn_row_id ORDER BY priority, rule)::INT AS place, rule, priority FROM u",
        "e_blocks": """WITH e AS (SELECT *, CASE WHEN point = 'đ' THEN 'd~' ELSE point END AS letter FROM scored_evidence WHERE point <> '' AND content IS NOT NULL),
n AS (SELECT doc_id, article_number, clause_number, letter, content FROM e
 QUALIFY row_number() OVER (PARTITION BY doc_id, article_number, clause_number, letter ORDER BY index_version DESC NULLS LAST, evidence_row_id DESC) = 1)
SELECT doc_id, article_number, clause_number, count(*) AS n_points, md5(string_agg(content, chr(10) ORDER BY letter)) AS block_md5 FROM n GROUP BY ALL""",
    }
