"""Queries of dashboards, audit, upkeep and checks (A, M12-M18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import admin, index, metrics
from verdigris.sources.tables import table

FIRST, LAST = "2024-01-03", "2024-01-20"
NEEDLE = "bang cham cong"


def a_daily(spark: SparkSession, d: str) -> DataFrame:
    return admin.daily_counts(table(spark, d, "events").where("event_type = 'error'"), "ts", "2023-12-28", "2024-02-05")


def a_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Filtered counts in one pass, and percentiles without a list of values."""
    e = table(spark, d, "events").withColumn("one", F.lit(1))
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("view", "signup", "error", "click", "purchase")]
    counts = e.groupBy("one").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), *kinds)
    shares = metrics.percentiles(e, "one", "value", {"p50": 0.5, "p95": 0.95})
    return counts.join(shares, "one", "left").drop("one").withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def a_audit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Local days in an inclusive range."""
    e = table(spark, d, "events").where(admin.day_range("ts", FIRST, LAST))
    return e.select("event_id", admin.local_day("ts").alias("day"), "event_type")


def a_search(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback")
    return f.where(admin.matches(["comment", "question", "reported_answer"], NEEDLE)).select("feedback_row_id", "rating", "status")


def a_details(spark: SparkSession, d: str) -> DataFrame:
    """Allowed members of a JSON column, clipped."""
    return table(spark, d, "events").select("event_id", F.substring(F.get_json_object("props", "$.k"), 1, 500).alias("k"))


def a_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Feedback re-deliveries: per natural id the row that came last."""
    f = table(spark, d, "feedback").select("id", "feedback_row_id", "rating", "status", "ingested_at")
    early, late = f.where(F.col("feedback_row_id") % 2 == 0), f.where(F.col("feedback_row_id") % 2 == 1)
    return admin.upsert(early, late, ["id"], ["ingested_at", "feedback_row_id"])


def a_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback").select("feedback_row_id", "owner_id", "rating")
    gone = table(spark, d, "feedback").where("rating = 'down' AND NOT share_consent").select("owner_id")
    return admin.without(f, gone, "owner_id")


def a_owned(spark: SparkSession, d: str) -> DataFrame:
    """Turns of one owner, visible while the owner has given feedback."""
    active = table(spark, d, "feedback").select("owner_id")
    return admin.owned(table(spark, d, "turns").select("turn_row_id", "owner_id", "conv_id"), "owner_id", F.lit("u0000001"), active)


def a_claimable(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs: signups wait, errors failed, clicks run since their timestamp."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("done")
    jobs = table(spark, d, "events").withColumn("status", status)
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return jobs.where(admin.claimable("status", "ts", now)).groupBy("status").agg(F.count("*").alias("n"), F.min("event_id").alias("first_job"))


AUDITED = ["article_title", "source_role", "rule_type", "legal_event"]


def a_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cell by cell what changed between index generations 1 and 2: chunks that came, went or hold something else."""
    latest = index.latest(table(spark, d, "scored_evidence"), ["chunk_id", "index_version"], ["ingested_at", "evidence_row_id"])
    of = lambda v: latest.where(F.col("index_version") == v).select("chunk_id", *AUDITED)
    return admin.audit(of(1), of(2), "chunk_id", AUDITED)


def a_violations(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback")
    return admin.violations(
        f,
        "feedback_row_id",
        {
            "rating_known": F.col("rating").isin("up", "down"),
            "no_text_without_consent": F.col("share_consent") | ((F.col("question") == "") & (F.col("reported_answer") == "")),
            "comment_short": F.length("comment") <= 1000,
            "has_owner": F.col("owner_id").isNotNull(),
            "not_early": F.col("ingested_at") >= F.col("created_at"),
        },
    )


def a_consent(spark: SparkSession, d: str) -> DataFrame:
    """Texts blanked where consent is missing; versions compared null-safe."""
    shared = lambda c: F.when(F.col("share_consent"), F.col(c)).otherwise(F.lit(""))
    return table(spark, d, "feedback").select(
        "feedback_row_id", F.length(shared("question")).alias("n_question"), F.length(shared("comment")).alias("n_comment"), (~F.col("privacy_version").eqNullSafe(F.lit(3))).alias("outdated")
    )


def a_latest_job(spark: SparkSession, d: str) -> DataFrame:
    """Per user the last error, and the number of views after it."""
    e = table(spark, d, "events")
    last = e.where("event_type = 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_error"), F.max("ts").alias("at"))
    views = e.where("event_type = 'view'").select("user_id", "ts")
    after = last.join(views, (views.user_id == last.user_id) & (views.ts > last["at"]), "left").groupBy(last.user_id, "last_error").agg(F.count("ts").alias("n_views_after"))
    return after


def a_valid_on(spark: SparkSession, d: str) -> DataFrame:
    """Whether the document that a question expects was in force when the question was loaded; unknown dates count as in force."""
    q = table(spark, d, "phase5b_eval_dataset").select("row_id", F.col("expected_doc_id").alias("document_no"), F.to_date("loaded_at").alias("on"))
    law = table(spark, d, "legal_documents").select("document_no", "effective_from", "validity")
    known = law.groupBy("document_no").agg(F.min("effective_from").alias("effective_from"))
    return q.join(known, "document_no", "left").select("row_id", F.coalesce(F.col("effective_from") <= F.col("on"), F.lit(True)).alias("in_force"))


def m_latency(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and the two kinds of 95th percentile per retrieval method."""
    c = table(spark, d, "phase5_7_cases_results")
    p95 = metrics.order_statistic(c, "retrieval_method", "total_latency_ms", 0.95, "p95_index")
    cont = metrics.percentiles(c, "retrieval_method", "total_latency_ms", {"median_ms": 0.5, "p95_cont": 0.95})
    means = c.groupBy("retrieval_method").agg(F.count("*").alias("n"), F.round(F.avg("total_latency_ms"), 4).alias("mean_ms"))
    both = means.join(p95, "retrieval_method", "left").join(cont, "retrieval_method", "left")
    return both.withColumns({name: F.round(name, 4) for name in ("median_ms", "p95_cont")})


def m_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Grounded share per strategy, methods as columns; a missing mean counts 0."""
    c = table(spark, d, "phase5_7_cases_results").withColumn("g", F.coalesce(F.col("is_fully_grounded").cast("double"), F.lit(0.0)))
    wide = c.groupBy("strategy").pivot("retrieval_method", ["BM25", "Dense", "Hybrid"]).agg(F.round(F.avg("g"), 6))
    return wide.na.fill(0.0).select("strategy", F.col("BM25").alias("bm25"), F.col("Dense").alias("dense"), F.col("Hybrid").alias("hybrid"), F.round(F.col("Hybrid") - F.col("BM25"), 6).alias("gain"))


def m_categories(spark: SparkSession, d: str) -> DataFrame:
    """Each case counted in all its categories at once."""
    c = table(spark, d, "phase5_7_cases_results")
    many = c.withColumn("category", F.explode(F.array(F.lit("ALL"), F.concat(F.lit("strategy:"), "strategy"), F.concat(F.lit("method:"), "retrieval_method"))))
    return many.groupBy("category").agg(F.count("*").alias("n"), F.count_if("abstain").alias("n_abstain"), F.round(F.avg("retrieval_latency_ms"), 4).alias("mean_ms"))


def m_cube(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "phase5_7_cases_results")
    return c.cube("strategy", "retrieval_method").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"), F.count_if(F.col("abstain").isNull()).alias("n_unknown"))


def m_gate(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance of the newest run of each case against the first."""
    c = table(spark, d, "phase5_7_cases_results").select("case_id", "case_row_id", "run_at", "total_latency_ms", "is_fully_grounded")
    runs = c.groupBy("case_id").agg(
        F.min_by(F.struct("total_latency_ms", "is_fully_grounded"), F.struct("run_at", "case_row_id")).alias("a"),
        F.max_by(F.struct("total_latency_ms", "is_fully_grounded"), F.struct("run_at", "case_row_id")).alias("b"),
        F.count("*").alias("n_runs"),
    )
    slower = F.round(F.col("b.total_latency_ms") - F.col("a.total_latency_ms"), 3)
    lost = F.coalesce(F.col("a.is_fully_grounded") & ~F.col("b.is_fully_grounded"), F.lit(False))
    return runs.where("n_runs > 1").select("case_id", "n_runs", slower.alias("slower_ms"), F.when(lost, "regressed").otherwise("held").alias("verdict"))


def v_citations(spark: SparkSession, d: str) -> DataFrame:
    """Cited chunks that exist, per case; a case that cites nothing has rate 1."""
    c = table(spark, d, "phase5_7_cases_results").select("case_row_id", "cited_chunk_ids")
    cited = c.select("case_row_id", F.explode(F.array_distinct("cited_chunk_ids")).alias("chunk_id"))
    known = table(spark, d, "scored_evidence").select("chunk_id").distinct().withColumn("known", F.lit(1))
    per = cited.join(known, "chunk_id", "left").groupBy("case_row_id").agg(F.count("*").alias("n_cited"), F.count("known").alias("n_known"))
    out = c.select("case_row_id").join(per, "case_row_id", "left").na.fill(0, ["n_cited", "n_known"])
    return out.withColumn("rate", F.when(F.col("n_cited") == 0, 1.0).otherwise(F.round(F.col("n_known") / F.col("n_cited"), 6)))


def v_phantoms(spark: SparkSession, d: str) -> DataFrame:
    """Articles an answer names that none of its cited chunks holds, and the faithfulness that leaves."""
    c = table(spark, d, "phase5_7_cases_results")
    allowed = F.transform(F.coalesce("cited_chunk_ids", F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"#d(\d+)", 1))
    ghosts = F.size(F.array_except(t.article_labels(F.col("full_answer")), allowed))
    empty = F.coalesce(F.trim("full_answer") == "", F.lit(True))
    score = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.5 * ghosts))
    return c.select("case_row_id", ghosts.alias("n_phantoms"), score.alias("faithfulness"))


def v_support(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rows retrieved for a turn hold the provision that its question names."""
    q = table(spark, d, "turns").select("turn_row_id", F.regexp_extract(F.lower("user_query"), r"điều\s+(\d+)", 1).alias("article")).where("article <> ''")
    have = table(spark, d, "scored_evidence").groupBy("turn_row_id", F.trim("article_number").alias("article")).agg(F.count("*").alias("n"))
    return q.join(have, ["turn_row_id", "article"], "left").select("turn_row_id", "article", F.coalesce(F.col("n") > 0, F.lit(False)).alias("supported"))


def v_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that names a turn which doesn't exist, or came before its turn."""
    turns = table(spark, d, "turns").select("turn_row_id", F.col("created_at").alias("asked_at"))
    e = table(spark, d, "scored_evidence").select("evidence_row_id", "turn_row_id", "created_at").join(turns, "turn_row_id", "left")
    reason = F.when(F.col("asked_at").isNull(), "no_turn").when(F.col("created_at") < F.col("asked_at"), "too_early")
    return e.select("evidence_row_id", reason.alias("violation")).where("violation IS NOT NULL")


def v_urls(spark: SparkSession, d: str) -> DataFrame:
    """Official addresses only: https, no user part, a government host."""
    host = F.element_at(F.array(F.lit("vbpl.gov.vn"), F.lit("chinhphu.vn"), F.lit("gov.vn.example"), F.lit("a@chinhphu.vn")), (F.col("feedback_row_id") % 4 + 1).cast("int"))
    url = F.concat(F.when(F.col("rating") == "up", "https://").otherwise("http://"), host, F.lit("/van-ban?id="), F.col("feedback_row_id").cast("string"))
    f = table(spark, d, "feedback").select("feedback_row_id", url.alias("url"))
    return f.withColumn("official", F.col("url").rlike(r"^https://([a-z0-9-]+\.)*(gov\.vn|chinhphu\.vn)(/|$)"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] in ("a_", "m_", "v_")}


def oracle_sql() -> dict:
    zone = "Asia/Ho_Chi_Minh"
    key = lambda c: f"trim(regexp_replace({t.sql_fold(c)}, '[^a-z0-9]+', ' ', 'g'))"
    return {
        "a_daily": """SELECT s.day::DATE AS day, count(event_id) AS n FROM generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY) s(day)
 LEFT JOIN (SELECT ts::DATE AS day, event_id FROM events WHERE event_type = 'error') e ON e.day = s.day::DATE GROUP BY s.day""",
        "a_dashboard": """SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count_if(event_type = 'view')::BIGINT AS n_view, count_if(event_type = 'signup')::BIGINT AS n_signup,
 count_if(event_type = 'error')::BIGINT AS n_error, count_if(event_type = 'click')::BIGINT AS n_click, count_if(event_type = 'purchase')::BIGINT AS n_purchase,
 round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events""",
        "a_audit_filter": f"SELECT event_id, (ts + INTERVAL 7 HOUR)::DATE AS day, event_type FROM events WHERE (ts + INTERVAL 7 HOUR)::DATE BETWEEN DATE '{FIRST}' AND DATE '{LAST}'",
        "a_search": f"SELECT feedback_row_id, rating, status FROM feedback WHERE contains({key('concat_ws(chr(32), comment, question, reported_answer)')}, '{NEEDLE}')",
        "a_details": "SELECT event_id, substring(props ->> '$.k', 1, 500) AS k FROM events",
        "a_upsert": "SELECT id, feedback_row_id, rating, status, ingested_at FROM feedback QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, feedback_row_id DESC) = 1",
        "a_soft_delete": "SELECT feedback_row_id, owner_id, rating FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM feedback g WHERE g.owner_id = f.owner_id AND g.rating = 'down' AND NOT g.share_consent)",
        "a_owned": "SELECT turn_row_id, owner_id, conv_id FROM turns WHERE owner_id = 'u0000001' AND owner_id IN (SELECT owner_id FROM feedback)",
        "a_claimable": """SELECT CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, count(*) AS n, min(event_id) AS first_job FROM events
 WHERE event_type IN ('signup', 'error') OR event_type = 'click' AND ts < TIMESTAMP '2024-01-15 11:50:00' GROUP BY 1""",
        "a_audit_rows": "WITH l AS (SELECT * FROM scored_evidence QUALIFY row_number() OVER (PARTITION BY chunk_id, index_version ORDER BY ingested_at DESC NULLS LAST, evidence_row_id DESC) = 1), a AS (FROM l WHERE index_version = 1), b AS (FROM l WHERE index_version = 2), "
        + "j AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'insert' WHEN b.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS action, "
        + ", ".join(f"a.{c}::VARCHAR AS a_{c}, b.{c}::VARCHAR AS b_{c}" for c in AUDITED)
        + " FROM a FULL JOIN b ON a.chunk_id = b.chunk_id) "
        + " UNION ALL ".join(f"SELECT chunk_id, action, '{c}' AS \"column\", a_{c} AS before, b_{c} AS after FROM j WHERE a_{c} IS DISTINCT FROM b_{c}" for c in AUDITED),
        "a_violations": " UNION ALL ".join(
            f"SELECT feedback_row_id, '{n}' AS violation FROM feedback WHERE NOT coalesce({c}, false)"
            for n, c in {
                "rating_known": "rating IN ('up', 'down')",
                "no_text_without_consent": "share_consent OR question = '' AND reported_answer = ''",
                "comment_short": "length(comment) <= 1000",
                "has_owner": "owner_id IS NOT NULL",
                "not_early": "ingested_at >= created_at",
            }.items()
        ),
        "a_consent": """SELECT feedback_row_id, length(CASE WHEN share_consent THEN question ELSE '' END)::INT AS n_question, length(CASE WHEN share_consent THEN comment ELSE '' END)::INT AS n_comment,
 privacy_version IS DISTINCT FROM 3 AS outdated FROM feedback""",
        "a_latest_job": """WITH l AS (SELECT user_id, event_id AS last_error, ts FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT l.user_id, last_error, count(e.ts) AS n_views_after FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'view' AND e.ts > l.ts GROUP BY ALL""",
        "a_valid_on": """SELECT row_id, coalesce(effective_from <= loaded_at::DATE, true) AS in_force FROM phase5b_eval_dataset
 LEFT JOIN (SELECT document_no, min(effective_from) AS effective_from FROM legal_documents GROUP BY document_no) l ON l.document_no = expected_doc_id""",
        "m_latency": """SELECT retrieval_method, count(*) AS n, round(avg(total_latency_ms), 4) AS mean_ms, round(median(total_latency_ms), 4) AS median_ms,
 list_sort(list(total_latency_ms))[(least(floor(count(*) * 0.95), count(*) - 1) + 1)::INT] AS p95_index, round(quantile_cont(total_latency_ms, 0.95), 4) AS p95_cont FROM phase5_7_cases_results GROUP BY 1""",
        "m_ablation": """WITH x AS (SELECT strategy, retrieval_method AS m, round(avg(coalesce(is_fully_grounded::INT::DOUBLE, 0)), 6) AS g FROM phase5_7_cases_results GROUP BY ALL),
y AS (SELECT strategy, coalesce(max(CASE WHEN m = 'BM25' THEN g END), 0) AS bm25, coalesce(max(CASE WHEN m = 'Dense' THEN g END), 0) AS dense, coalesce(max(CASE WHEN m = 'Hybrid' THEN g END), 0) AS hybrid FROM x GROUP BY strategy)
SELECT *, round(hybrid - bm25, 6) AS gain FROM y""",
        "m_categories": """WITH x AS (SELECT *, unnest(['ALL', 'strategy:' || strategy, 'method:' || retrieval_method]) AS category FROM phase5_7_cases_results)
SELECT category, count(*) AS n, count_if(abstain)::BIGINT AS n_abstain, round(avg(retrieval_latency_ms), 4) AS mean_ms FROM x GROUP BY category""",
        "m_cube": """SELECT strategy, retrieval_method, count(*) AS n, grouping(strategy, retrieval_method)::INT AS level, count_if(abstain IS NULL)::BIGINT AS n_unknown
 FROM phase5_7_cases_results GROUP BY CUBE (strategy, retrieval_method)""",
        "m_gate": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY run_at, case_row_id) AS i, count(*) OVER (PARTITION BY case_id) AS n_runs FROM phase5_7_cases_results)
SELECT a.case_id, a.n_runs, round(b.total_latency_ms - a.total_latency_ms, 3) AS slower_ms, CASE WHEN a.is_fully_grounded AND NOT b.is_fully_grounded THEN 'regressed' ELSE 'held' END AS verdict
 FROM r a JOIN r b ON a.case_id = b.case_id AND a.i = 1 AND b.i = b.n_runs WHERE a.n_runs > 1""",
        "v_citations": """WITH c AS (SELECT case_row_id, unnest(list_distinct(cited_chunk_ids)) AS chunk_id FROM phase5_7_cases_results), k AS (SELECT DISTINCT chunk_id AS known FROM scored_evidence),
p AS (SELECT case_row_id, count(*) AS n_cited, count(known) AS n_known FROM c LEFT JOIN k ON known = chunk_id GROUP BY 1)
SELECT r.case_row_id, coalesce(n_cited, 0) AS n_cited, coalesce(n_known, 0) AS n_known, CASE WHEN coalesce(n_cited, 0) = 0 THEN 1.0::DOUBLE ELSE round(n_known / n_cited, 6) END AS rate
 FROM phase5_7_cases_results r LEFT JOIN p USING (case_row_id)""",
        "v_phantoms": """WITH x AS (SELECT case_row_id, full_answer, list_distinct(regexp_extract_all(lower(coalesce(full_answer, '')), 'điều\\s+(\\d+[a-zđ]?)', 1)) AS named,
 list_transform(coalesce(cited_chunk_ids, []), lambda c: regexp_extract(c, '#d(\\d+)', 1)) AS allowed FROM phase5_7_cases_results),
y AS (SELECT *, len(list_filter(named, lambda a: NOT list_contains(allowed, a)))::INT AS n_phantoms FROM x)
SELECT case_row_id, n_phantoms, CASE WHEN coalesce(trim(full_answer) = '', true) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 0.5::DOUBLE * n_phantoms) END AS faithfulness FROM y""",
        "v_support": """WITH q AS (SELECT turn_row_id, regexp_extract(lower(user_query), 'điều\\s+(\\d+)', 1) AS article FROM turns)
SELECT turn_row_id, article, EXISTS (SELECT 1 FROM scored_evidence e WHERE e.turn_row_id = q.turn_row_id AND trim(e.article_number) = article) AS supported FROM q WHERE article <> ''""",
        "v_ownership": """SELECT evidence_row_id, CASE WHEN t.created_at IS NULL THEN 'no_turn' WHEN e.created_at < t.created_at THEN 'too_early' END AS violation
 FROM scored_evidence e LEFT JOIN turns t USING (turn_row_id) WHERE t.created_at IS NULL OR e.created_at < t.created_at""",
        "v_urls": """WITH x AS (SELECT feedback_row_id, CASE WHEN rating = 'up' THEN 'https://' ELSE 'http://' END || ['vbpl.gov.vn', 'chinhphu.vn', 'gov.vn.example', 'a@chinhphu.vn'][(feedback_row_id % 4 + 1)::INT]
 || '/van-ban?id=' || feedback_row_id AS url FROM feedback) SELECT *, regexp_matches(url, '^https://([a-z0-9-]+\\.)*(gov\\.vn|chinhphu\\.vn)(/|$)') AS official FROM x""",
    }
