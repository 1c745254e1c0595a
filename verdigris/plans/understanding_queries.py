"""Queries that read questions by rules, and the rest of text and ranking (Q, R18-R28, T11, T20-T24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import restore, retrieve, rules
from verdigris.plans import retrieval_queries as r
from verdigris.sources.tables import table

ROUTES = [
    {"name": "reference", "any": ["điều ", "khoản "], "none": []},
    {"name": "document", "any": ["nghị định", "thông tư"], "none": []},
    {"name": "calculation", "any": ["tính ra sao", "bao nhiêu", "mấy phần trăm"], "none": []},
    {"name": "procedure", "any": ["giấy tờ", "hồ sơ", "khiếu nại"], "none": ["mã hồ sơ"]},
]
EVENTS = [
    {"name": "TERMINATION", "any": ["nghỉ việc", "thôi việc", "chấm dứt"]},
    {"name": "ACCIDENT", "any": ["tai nạn", "accident"]},
    {"name": "OVERTIME", "any": ["làm đêm", "làm thêm", "overtime"]},
    {"name": "MATERNITY", "any": ["thai sản", "mang thai", "maternity"]},
    {"name": "PAY", "any": ["lương", "wages"], "none": ["mức lương 4."]},
]
SMALL_TALK = ["chao ban", "cam on", "thanks", "good answer", "tam duoc", "tra loi nhanh", "de hieu"]


def q_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").select("turn_row_id", rules.first_match(F.col("user_query"), ROUTES, "general").alias("route"))


def q_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").select("turn_row_id", F.array_join(rules.labels(F.col("user_query"), EVENTS), ",").alias("events"))


def q_small_talk(spark: SparkSession, d: str) -> DataFrame:
    left = rules.remainder(F.col("comment"), SMALL_TALK)
    return table(spark, d, "feedback").select("feedback_row_id", left.alias("remainder"), ((left == "") & (F.col("comment") != "")).alias("is_small_talk"))


def q_decomposed(spark: SparkSession, d: str) -> DataFrame:
    return rules.decomposed(table(spark, d, "turns", "turn_row_id", "user_query"), "turn_row_id", "user_query")


def q_numbers_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer's numbers all come from its question or facts."""
    facts = F.array_join(F.map_values(F.coalesce("facts", F.create_map().cast("map<string,string>"))), " ")
    return table(spark, d, "turns").select("turn_row_id", rules.numbers_kept(F.col("assistant_response"), F.col("user_query"), facts).alias("kept"))


def q_grades(spark: SparkSession, d: str) -> DataFrame:
    """How good each ranking is: best and mean score of its top, and the verdict."""
    top = r._bm25(spark, d, 5).groupBy("query").agg(F.max("score").alias("best"), F.sum("score").alias("total"), F.count("*").alias("n"))
    best = F.round(F.col("best").cast("double"), 4)
    return top.select("query", best.alias("best"), F.col("n"), F.when(best >= 40, "good").when(best >= 20, "fair").otherwise("poor").alias("grade"))


def q_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """Rankings without chunks of forbidden articles."""
    ids = table(spark, d, "scored_evidence").select(F.col("evidence_row_id").alias("key"), "chunk_id")
    ranked = r._bm25(spark, d).join(ids, "key")
    kept = ranked.where(~(F.contains("chunk_id", F.lit("#d46")) | F.contains("chunk_id", F.lit("#d1-"))))
    return retrieve.reorder(kept, F.lit(0)).select("query", F.col("key").alias("evidence_row_id"), "new_rank")


def q_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cited ids looked up in the order given; the newest row of each."""
    c = table(spark, d, "phase5_7_cases_results").select("case_row_id", F.posexplode("cited_chunk_ids").alias("place", "chunk_id"))
    newest = table(spark, d, "scored_evidence").groupBy("chunk_id").agg(F.max_by("evidence_row_id", F.struct("index_version", "evidence_row_id")).alias("evidence_row_id"))
    return c.join(newest, "chunk_id", "left").select("case_row_id", "place", "chunk_id", "evidence_row_id")


def q_retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    """The text that is indexed: header parts and content, nulls skipped."""
    e = table(spark, d, "scored_evidence")
    text = F.concat_ws(" | ", "document_title", "document_no", F.concat(F.lit("Điều "), F.trim("article_number")), "article_title", F.nullif("content", F.lit("")))
    return e.select("evidence_row_id", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


def q_partial_json(spark: SparkSession, d: str) -> DataFrame:
    """The question of a payload, read even where the payload breaks off."""
    p = table(spark, d, "phase5b_failed_queries_diagnostics")
    raw = F.regexp_extract(F.coalesce("payload", F.lit("")), r'^\s*\{\s*"question_id"\s*:\s*"([^"\\]*)"', 1)
    return p.select("raw_id", F.nullif(raw, F.lit("")).alias("question_id"))


def q_restored(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their accents put back; the dictionary is counted from the evidence."""
    known = restore.entries(table(spark, d, "scored_evidence"), "content")
    a = table(spark, d, "turns").select(F.col("turn_row_id").alias("row_id"), F.col("assistant_response").alias("text"))
    return restore.restored_by(a, known)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict:
    def cond(rule, c):
        none = "".join(f" AND NOT {t.sql_contains_any(c, [w])}" for w in rule.get("none", []))
        return f"{t.sql_contains_any(c, rule['any'])}{none}"

    route = "CASE " + " ".join(f"WHEN {cond(x, 'user_query')} THEN '{x['name']}'" for x in ROUTES) + " ELSE 'general' END"
    events = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond(x, 'user_query')} THEN '{x['name']}' END" for x in EVENTS) + ")"
    left = f"concat(' ', trim(regexp_replace({t.sql_fold('comment')}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    for phrase in sorted(SMALL_TALK, key=lambda p: (-len(p), p)):
        left = f"replace({left}, ' {phrase} ', ' ')"
    bm = r.oracle_sql()["bm25_topk"]
    bm = bm[len("WITH ") : bm.rindex(" SELECT query, key AS")]
    norm = t.sql_normalize_query
    return {
        "q_routes": f"SELECT turn_row_id, {route} AS route FROM turns",
        "q_events": f"SELECT turn_row_id, {events} AS events FROM turns",
        "q_small_talk": f"SELECT feedback_row_id, trim({left}) AS remainder, trim({left}) = '' AND comment <> '' AS is_small_talk FROM feedback",
        "q_decomposed": f"""WITH x AS (SELECT turn_row_id, {norm('user_query')} AS q, list_filter(list_transform(string_split(user_query, '?'), lambda p: {norm('p')}), lambda p: length(p) >= 12) AS m,
 list_filter(list_transform(string_split(user_query, ';'), lambda p: {norm('p')}), lambda p: length(p) >= 12) AS s FROM turns WHERE user_query IS NOT NULL),
y AS (SELECT turn_row_id, CASE WHEN len(m) > 1 THEN m WHEN len(s) > 1 THEN s ELSE [q] END AS a FROM x) SELECT turn_row_id, generate_subscripts(a, 1)::INT - 1 AS part_no, unnest(a) AS part FROM y""",
        "q_numbers_kept": """WITH x AS (SELECT turn_row_id, regexp_extract_all(coalesce(assistant_response, ''), '\\d+') AS a, list_concat(regexp_extract_all(coalesce(user_query, ''), '\\d+'),
 regexp_extract_all(coalesce(array_to_string(map_values(facts), ' '), ''), '\\d+')) AS k FROM turns) SELECT turn_row_id, len(list_filter(a, lambda n: NOT list_contains(k, n))) = 0 AS kept FROM x""",
        "q_grades": f"""WITH {bm}, g AS (SELECT query, round(max(score)::DOUBLE, 4) AS best, count(*) AS n FROM bmr WHERE rank <= 5 GROUP BY query)
SELECT query, best, n, CASE WHEN best >= 40 THEN 'good' WHEN best >= 20 THEN 'fair' ELSE 'poor' END AS grade FROM g""",
        "q_forbidden": f"""WITH {bm} SELECT query, key AS evidence_row_id, row_number() OVER (PARTITION BY query ORDER BY rank, key)::INT AS new_rank
 FROM bmr JOIN scored_evidence ON evidence_row_id = key WHERE rank <= 10 AND NOT contains(chunk_id, '#d46') AND NOT contains(chunk_id, '#d1-')""",
        "q_lookup": """WITH n AS (SELECT chunk_id, evidence_row_id FROM scored_evidence QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY index_version DESC NULLS LAST, evidence_row_id DESC) = 1),
c AS (SELECT case_row_id, generate_subscripts(cited_chunk_ids, 1)::INT - 1 AS place, unnest(cited_chunk_ids) AS chunk_id FROM phase5_7_cases_results)
SELECT case_row_id, place, c.chunk_id, evidence_row_id FROM c LEFT JOIN n ON n.chunk_id = c.chunk_id""",
        "q_retrieval_text": """WITH x AS (SELECT evidence_row_id, concat_ws(' | ', document_title, document_no, 'Điều ' || trim(article_number), article_title, nullif(content, '')) AS t FROM scored_evidence)
SELECT evidence_row_id, md5(t) AS text_md5, length(t)::INT AS n_chars FROM x""",
        "q_partial_json": """SELECT raw_id, nullif(regexp_extract(coalesce(payload, ''), '^\\s*\\{\\s*"question_id"\\s*:\\s*"([^"\\\\]*)"', 1), '') AS question_id FROM phase5b_failed_queries_diagnostics""",
    }
