"""Queries that judge evidence, answers and runs (E8-E26, V2-V3, M5-M24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as t
from verdigris.operators import metrics, retrieve, rules
from verdigris.plans import retrieval_queries as r
from verdigris.sources.tables import table

REASONS = {"in_scope": "words of the text and of the question differ", "ambiguous": "the question leaves out what decides", "out_of_scope": "nothing to be found"}
ROLES = ["amount", "deadline", "definition"]
RULE_TYPES = [
    {"name": "penalty", "any": ["khấu trừ", "bồi thường", "phạt"]},
    {"name": "exception", "any": ["trừ khi", "không kể", "riêng tại"]},
    {"name": "deadline", "any": ["chậm nhất", "trước ngày", "thời hạn"]},
    {"name": "amount", "any": ["hệ số", "mức ", "triệu đồng", "%"]},
    {"name": "duty", "any": ["phải ", "có trách nhiệm"]},
]
GOALS = {"documents": 1000, "scored_evidence": 2000, "turns": 2000, "legal_documents": 300}
LINE = r"^([A-Z]+)_(\d+)_(\d+)#d(\d+)(?:-k(\d+))?(?:-([a-zđ]))?$"


def _best(spark, d):
    """Evidence of each turn by falling total score."""
    w = Window.partitionBy("turn_row_id").orderBy(F.col("total_score").desc_nulls_last(), "evidence_row_id")
    return table(spark, d, "scored_evidence").withColumn("place", F.row_number().over(w))


# ------------------------------------------------------------------ measures
def m_failures(spark: SparkSession, d: str) -> DataFrame:
    """Scorable questions whose fused ranking has nothing relevant among its first five, with the likely reason."""
    q = table(spark, d, "phase5b_eval_dataset").where(F.col("row_id") % r.EVERY == 0)
    gold = q.select(F.col("row_id").alias("query"), "query_type", "expected_doc_id", "expected_article").where("expected_doc_id IS NOT NULL")
    hit = r._fused(spark, d).join(r.chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "document_no", "article_number"), "key")
    relevant = metrics.relevant("document_no", "article_number", "expected_doc_id", "expected_article")
    scores = metrics.per_query(gold, hit.join(gold, "query").select("query", "rank", relevant.alias("relevant")), F.lit(True))
    reason = F.coalesce(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("query_type")], F.lit("unknown"))
    return scores.where("first_rank IS NULL OR first_rank > 5").select("query", "query_type", "first_rank", reason.alias("reason"))


def m_required(spark: SparkSession, d: str) -> DataFrame:
    """Of all evidence that the deliveries of a question require, how much its BM25 top five holds."""
    e = table(spark, d, "phase5b_eval_dataset")
    gold = e.where("expected_doc_id IS NOT NULL").select("question_id", "expected_doc_id", "expected_article").distinct()
    asked = e.where(F.col("row_id") % r.EVERY == 0).select(F.col("row_id").alias("query"), "question_id").join(gold, "question_id")
    held = r._bm25(spark, d, 5).join(r.chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "document_no", "article_number"), "key").select("query", "document_no", "article_number")
    met = asked.join(held, "query", "left").withColumn("met", metrics.relevant("document_no", "article_number", "expected_doc_id", "expected_article"))
    items = met.groupBy("query", "expected_doc_id", "expected_article").agg(F.bool_or("met").alias("met"))
    return items.groupBy("query").agg(F.count("*").alias("n_required"), F.count_if("met").alias("n_met"), F.round(F.count_if("met") / F.count("*"), 6).alias("recall_5"))


def m_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of index generations 1 and 2 side by side, and what changed."""
    e = table(spark, d, "scored_evidence")
    of = lambda c, v: F.round(F.avg(F.when(F.col("index_version") == v, F.col(c))), 6)
    out = e.groupBy("legal_event").agg(*[of(c, v).alias(f"{c}_v{v}") for c in ("semantic_score", "lexical_score", "total_score") for v in (1, 2)])
    return out.select("*", *[F.round(F.col(f"{c}_v2") - F.col(f"{c}_v1"), 6).alias(f"{c}_delta") for c in ("semantic_score", "lexical_score", "total_score")])


def m_doc_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a question may mean: the same number in full, a part of it, or the leading number alone."""
    named = F.regexp_extract(F.lower(F.coalesce("question", F.lit(""))), r"(\d+(?:/\d+)?/[a-zđ]+-[a-zđ]+)", 1)
    asked = table(spark, d, "phase5b_eval_dataset").select("row_id", named.alias("named")).where("named <> ''").withColumn("lead", F.regexp_extract("named", r"^\d+", 0))
    known = table(spark, d, "legal_documents").select("document_no", F.lower("document_no").alias("low")).distinct().withColumn("lead", F.regexp_extract("low", r"^\d+", 0))
    kind = F.when(F.col("named") == F.col("low"), "same").when(F.contains("low", F.col("named")) | F.contains("named", F.col("low")), "part").otherwise("number")
    return asked.join(known, "lead").select("row_id", "document_no", kind.alias("match"))


def m_calculator(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each test against its first, per domain: formula, eligibility, amount within 10 or 0.1 %, clarification."""
    columns = ["domain", "expected_formula_id", "expected_eligible", "expected_amount", "requires_clarification"]
    b = table(spark, d, "wave2_calculator_benchmark").groupBy("test_id").agg(
        F.min_by(F.struct(*columns), "bench_row_id").alias("a"), F.max_by(F.struct(*columns), "bench_row_id").alias("z")
    )
    gap = F.abs(F.col("a.expected_amount") - F.col("z.expected_amount"))
    amount = F.when(F.col("a.expected_amount").isNull() | F.col("z.expected_amount").isNull(), F.col("a.expected_amount").eqNullSafe(F.col("z.expected_amount"))).otherwise((gap < 10) | (gap < F.abs(F.col("a.expected_amount")) * 0.001))
    tests = {"formula": F.col("a.expected_formula_id").eqNullSafe(F.col("z.expected_formula_id")), "eligible": F.col("a.expected_eligible").eqNullSafe(F.col("z.expected_eligible")), "amount": amount, "clarify": F.col("a.requires_clarification").eqNullSafe(F.col("z.requires_clarification"))}
    return b.groupBy(F.col("a.domain").alias("domain")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{name}") for name, c in tests.items()])


def m_production(spark: SparkSession, d: str) -> DataFrame:
    """Per retrieval method: whether the first citation stands, the share of citations that do, and of grounded answers."""
    cited, gone = F.array_compact("cited_chunk_ids"), F.coalesce("rejected_chunk_ids", F.array().cast("array<string>"))
    c = table(spark, d, "phase5_7_cases_results").select("retrieval_method", "is_fully_grounded", cited.alias("cited"), gone.alias("gone"))
    kept = F.filter("cited", lambda x: ~F.array_contains("gone", x))
    some = F.size("cited") > 0
    first = F.when(some, (~F.array_contains("gone", F.get("cited", F.lit(0)))).cast("double"))
    return c.groupBy("retrieval_method").agg(
        F.count("*").alias("n"), F.count_if(some).alias("n_citing"), F.round(F.avg(first), 6).alias("top_1"),
        F.round(F.avg(F.when(some, F.size(kept) / F.size("cited"))), 6).alias("precision"), F.round(F.avg(F.coalesce("is_fully_grounded", F.lit(False)).cast("double")), 6).alias("grounded"),
    )


def m_procedural(spark: SparkSession, d: str) -> DataFrame:
    """Share of turns with a procedure among their first 1, 3 and 5 pieces of evidence, per legal event of the first."""
    first = F.min(F.when(F.col("rule_type") == "PROCEDURE", F.col("place")))
    t_ = _best(spark, d).groupBy("turn_row_id").agg(first.alias("at"), F.min_by("legal_event", "place").alias("event"))
    return t_.groupBy("event").agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(F.col("at") <= k, F.lit(False)).cast("double")), 6).alias(f"top_{k}") for k in (1, 3, 5)])


def m_generation(spark: SparkSession, d: str) -> DataFrame:
    """What the strategies give: answers, their length, citations, abstentions and clarifications."""
    c = table(spark, d, "phase5_7_cases_results")
    said = F.coalesce(F.trim("full_answer") != "", F.lit(False))
    mean = lambda x: F.round(F.avg(x.cast("double")), 6)
    return c.groupBy("strategy").agg(
        F.count("*").alias("n"), mean(said).alias("answered"), mean(F.when(said, F.length("full_answer"))).alias("chars"), mean(F.coalesce(F.size(F.array_distinct(F.array_compact("cited_chunk_ids"))), F.lit(0))).alias("citations"),
        mean(F.coalesce("abstain", F.lit(False))).alias("abstained"), mean(F.coalesce("needs_clarification", F.lit(False))).alias("clarified"),
    )


def m_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Articles that an answer names against those of its citations."""
    cited = F.array_distinct(F.filter(F.transform(F.array_compact("cited_chunk_ids"), lambda c: F.regexp_extract(c, r"#d(\d+)", 1)), lambda a: a != ""))
    c = table(spark, d, "phase5_7_cases_results").select("case_row_id", t.article_labels(F.col("full_answer")).alias("named"), F.coalesce(cited, F.array().cast("array<string>")).alias("cited"))
    both = F.size(F.array_intersect("named", "cited"))
    return c.select("case_row_id", F.size("named").alias("n_named"), F.size("cited").alias("n_cited"), both.alias("n_both"), F.when(F.size("cited") > 0, F.round(both / F.size("cited"), 6)).alias("recall"))


def m_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Weighted marks of each case and the share that passes, per retrieval method."""
    marks = [(F.coalesce(F.trim("full_answer") != "", F.lit(False)), 0.4), (F.coalesce("is_fully_grounded", F.lit(False)), 0.3), (F.coalesce(F.size("cited_chunk_ids") > 0, F.lit(False)), 0.2), (~F.coalesce("abstain", F.lit(False)), 0.1)]
    score = sum((F.when(c, w).otherwise(0.0) for c, w in marks[1:]), F.when(marks[0][0], marks[0][1]).otherwise(0.0))
    c = table(spark, d, "phase5_7_cases_results").select("retrieval_method", F.round(score, 2).alias("score"))
    return c.groupBy("retrieval_method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg((F.col("score") >= 0.7).cast("double")), 6).alias("pass_rate"))


def m_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the tables against their goals."""
    out = None
    for name, goal in GOALS.items():
        row = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(goal).cast("bigint").alias("goal"))
        out = row if out is None else out.unionByName(row)
    return out.select("name", "n", "goal", F.round(F.col("n") / F.col("goal"), 6).alias("ratio"), (F.col("n") >= F.col("goal")).alias("reached"))


def m_regression(spark: SparkSession, d: str) -> DataFrame:
    """Each index generation against the one before; a fall of the mean score by more than a hundredth is a regression."""
    e = table(spark, d, "scored_evidence").groupBy("index_version").agg(
        F.count("*").alias("n"), F.round(F.avg((F.coalesce(F.length("content"), F.lit(0)) > 0).cast("double")), 6).alias("filled"), F.round(F.avg("total_score"), 6).alias("mean_score")
    )
    before = e.select((F.col("index_version") + 1).alias("index_version"), F.col("mean_score").alias("before"))
    return e.join(before, "index_version", "left").withColumn("regressed", F.coalesce(F.col("mean_score") < F.col("before") - 0.01, F.lit(False)))


# ------------------------------------------------------------------ citations
def v_formatted(spark: SparkSession, d: str) -> DataFrame:
    """The citations of a case as lines, each once, in the order of first mention."""
    part = lambda c, n: F.regexp_extract(c, LINE, n)

    def line(c):
        place = F.concat(F.when(part(c, 6) != "", F.concat(F.lit("điểm "), part(c, 6), F.lit(" "))).otherwise(""), F.when(part(c, 5) != "", F.concat(F.lit("khoản "), part(c, 5), F.lit(" "))).otherwise(""), F.lit("Điều "), part(c, 4))
        return F.when(part(c, 4) != "", F.concat(place, F.lit(", "), part(c, 2), F.lit("/"), part(c, 3))).otherwise(c)

    lines = F.array_distinct(F.transform(F.array_compact("cited_chunk_ids"), line))
    return table(spark, d, "phase5_7_cases_results").select("case_row_id", F.array_join(lines, "\n").alias("citations"))


def v_tokens(spark: SparkSession, d: str) -> DataFrame:
    """References in evidence as tokens; what leads to one goes with it."""
    text = F.regexp_replace("content", r"([Tt]heo |tại |nêu tại )?khoản (\d+) Điều (\d+)", "[$3.$2]")
    return table(spark, d, "scored_evidence").select("evidence_row_id", F.md5(F.regexp_replace(text, r"([Tt]heo |tại |nêu tại )?Điều (\d+)", "[$2]")).alias("text_md5"))


# ------------------------------------------------------------------ evidence
def e_classified(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scored_evidence")
    return e.select("evidence_row_id", rules.first_match(F.col("content"), RULE_TYPES, "other").alias("kind"), F.array_join(rules.labels(F.col("content"), RULE_TYPES), ",").alias("kinds"))


def e_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The first two pieces of a turn's evidence cover some of the roles; for the others the best further piece is added, which never covers less."""
    roles = _best(spark, d).select("turn_row_id", "evidence_row_id", "place", F.explode("evidence_roles").alias("role")).where(F.col("role").isin(ROLES))
    by_role = roles.groupBy("turn_row_id", "role").agg(F.min("place").alias("place"), F.min_by("evidence_row_id", "place").alias("evidence_row_id"))
    return by_role.groupBy("turn_row_id").agg(
        F.count_if(F.col("place") <= 2).alias("n_covered"), F.count("*").alias("n_repaired"), F.count_distinct(F.when(F.col("place") > 2, F.col("evidence_row_id"))).alias("n_added")
    )


def e_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without that of repealed documents, unless the question asks about the past."""
    repealed = table(spark, d, "legal_documents").where("validity = 'REPEALED'").select("doc_id").distinct().withColumn("repealed", F.lit(True))
    asks = table(spark, d, "turns").select("turn_row_id", t.contains_any(F.col("user_query"), r.HISTORICAL).alias("historical"))
    e = table(spark, d, "scored_evidence").select("evidence_row_id", "turn_row_id", "doc_id")
    joined = e.join(repealed, "doc_id", "left").join(asks, "turn_row_id")
    return joined.where(F.col("repealed").isNull() | F.col("historical")).select("evidence_row_id", "turn_row_id")


def e_sufficient(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn's evidence will do: enough pieces with content, one event, all roles."""
    roles = F.array_intersect(F.array_distinct(F.flatten(F.collect_list("evidence_roles"))), F.array(*[F.lit(x) for x in ROLES]))
    known = F.when(F.col("legal_event") != "UNKNOWN", F.col("legal_event"))
    x = table(spark, d, "scored_evidence").groupBy("turn_row_id").agg(F.count_if(F.coalesce(F.trim("content") != "", F.lit(False))).alias("n_filled"), F.count_distinct(known).alias("n_events"), F.size(roles).alias("n_roles"))
    return x.select("turn_row_id", F.when(F.col("n_filled") == 0, "empty").when(F.col("n_events") > 1, "mixed events").when(F.col("n_roles") < len(ROLES), "roles missing").otherwise("sufficient").alias("verdict"))


def e_contradicted(spark: SparkSession, d: str) -> DataFrame:
    """Articles and amounts that an answer states and no piece of its evidence does."""
    amounts = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*(?: triệu)? đồng"), F.lit(0)))
    e = table(spark, d, "scored_evidence").select("turn_row_id", t.article_labels(F.col("content")).alias("a"), amounts(F.col("content")).alias("m"))
    # One turn has as many pieces of evidence as a ranking returns.
    held = e.groupBy("turn_row_id").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"), F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"))
    answers = table(spark, d, "turns").select("turn_row_id", t.article_labels(F.col("assistant_response")).alias("sa"), amounts(F.col("assistant_response")).alias("sm"))
    j = answers.join(held, "turn_row_id")
    return j.select("turn_row_id", F.size(F.array_except("sa", "a")).alias("n_articles"), F.size(F.array_except("sm", "m")).alias("n_amounts"))


def e_quotes(spark: SparkSession, d: str) -> DataFrame:
    """At most three quotes for a rule type of a turn, each chunk once over all."""
    once = Window.partitionBy("turn_row_id", "chunk_id").orderBy("place")
    e = _best(spark, d).withColumn("again", F.row_number().over(once)).where("again = 1")
    inside = Window.partitionBy("turn_row_id", "rule_type").orderBy("place")
    return e.withColumn("quote_no", F.row_number().over(inside)).where("quote_no <= 3").select("turn_row_id", "rule_type", "quote_no", "evidence_row_id", F.substring("content", 1, 120).alias("quote"))


def e_overview(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a turn by document and article, without points whose whole clause is there too."""
    e = table(spark, d, "scored_evidence").withColumn("point", F.nullif("point", F.lit("")))
    whole = e.where("point IS NULL AND clause_number IS NOT NULL").select("turn_row_id", "doc_id", "article_number", "clause_number").distinct().withColumn("whole", F.lit(True))
    kept = e.join(whole, ["turn_row_id", "doc_id", "article_number", "clause_number"], "left").where("point IS NULL OR whole IS NULL")
    return kept.groupBy("turn_row_id", "doc_id", "article_number").agg(F.count("*").alias("n_blocks"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("n_chars"), F.min("evidence_row_id").alias("first_row"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("m_", "v_", "e_")) and callable(f)}


def oracle_sql() -> dict:
    own = r.oracle_sql()
    measured = own["retrieval_metrics"][: own["retrieval_metrics"].index("SELECT CASE WHEN grouping")]
    bm = own["bm25_topk"]
    bm = bm[len("WITH ") : bm.rindex(" SELECT query, key AS")]
    best = "best AS (SELECT *, row_number() OVER (PARTITION BY turn_row_id ORDER BY total_score DESC NULLS LAST, evidence_row_id) AS place FROM scored_evidence)"
    cond = lambda rule: t.sql_contains_any("content", rule["any"])
    labels = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), 'điều\\s+(\\d+[a-zđ]?)', 1))"
    amounts = lambda c: f"list_distinct(regexp_extract_all(coalesce({c}, ''), '\\d+(?:[.,]\\d+)*(?: triệu)? đồng'))"
    part = lambda n: f"regexp_extract(c, '{LINE}', {n})"
    line = f"""CASE WHEN {part(4)} <> '' THEN concat(CASE WHEN {part(6)} <> '' THEN 'điểm ' || {part(6)} || ' ' ELSE '' END, CASE WHEN {part(5)} <> '' THEN 'khoản ' || {part(5)} || ' ' ELSE '' END, 'Điều ', {part(4)}, ', ', {part(2)}, '/', {part(3)}) ELSE c END"""
    scores = ("semantic_score", "lexical_score", "total_score")
    roles = "[" + ", ".join(f"'{x}'" for x in ROLES) + "]"
    reasons = "CASE query_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " ELSE 'unknown' END"
    return {
        "m_failures": f"{measured} SELECT query, query_type, first_rank, {reasons} AS reason FROM m WHERE scorable AND (first_rank IS NULL OR first_rank > 5)",
        "m_required": f"""WITH {bm}, g AS (SELECT DISTINCT question_id, expected_doc_id, expected_article FROM phase5b_eval_dataset WHERE expected_doc_id IS NOT NULL),
a AS (SELECT row_id AS query, g.* FROM phase5b_eval_dataset e JOIN g ON g.question_id = e.question_id WHERE row_id % 50 = 0),
h AS (SELECT query, document_no, article_number FROM bmr JOIN scored_evidence ON evidence_row_id = key WHERE rank <= 5),
i AS (SELECT a.query, expected_doc_id, expected_article, bool_or(coalesce(document_no = expected_doc_id AND (expected_article IS NULL OR try_cast(trim(article_number) AS INT) = expected_article), false)) AS met
 FROM a LEFT JOIN h ON h.query = a.query GROUP BY ALL)
SELECT query, count(*) AS n_required, count_if(met)::BIGINT AS n_met, round(count_if(met) / count(*), 6) AS recall_5 FROM i GROUP BY query""",
        "m_delta": "WITH x AS (SELECT legal_event, " + ", ".join(f"round(avg({c}) FILTER (index_version = {v}), 6) AS {c}_v{v}" for c in scores for v in (1, 2)) + " FROM scored_evidence GROUP BY legal_event) SELECT *, " + ", ".join(f"round({c}_v2 - {c}_v1, 6) AS {c}_delta" for c in scores) + " FROM x",
        "m_doc_match": """WITH a AS (SELECT row_id, regexp_extract(lower(coalesce(question, '')), '(\\d+(?:/\\d+)?/[a-zđ]+-[a-zđ]+)', 1) AS named FROM phase5b_eval_dataset), k AS (SELECT DISTINCT document_no, lower(document_no) AS low FROM legal_documents)
SELECT row_id, document_no, CASE WHEN named = low THEN 'same' WHEN contains(low, named) OR contains(named, low) THEN 'part' ELSE 'number' END AS match FROM a JOIN k ON regexp_extract(named, '^\\d+') = regexp_extract(low, '^\\d+') WHERE named <> ''""",
        "m_calculator": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY bench_row_id) AS i, row_number() OVER (PARTITION BY test_id ORDER BY bench_row_id DESC) AS j FROM wave2_calculator_benchmark)
SELECT a.domain, count(*) AS n, count_if(a.expected_formula_id IS NOT DISTINCT FROM z.expected_formula_id)::BIGINT AS n_formula, count_if(a.expected_eligible IS NOT DISTINCT FROM z.expected_eligible)::BIGINT AS n_eligible,
 count_if(CASE WHEN a.expected_amount IS NULL OR z.expected_amount IS NULL THEN a.expected_amount IS NOT DISTINCT FROM z.expected_amount ELSE abs(a.expected_amount - z.expected_amount) < 10 OR abs(a.expected_amount - z.expected_amount) < abs(a.expected_amount) * 0.001 END)::BIGINT AS n_amount,
 count_if(a.requires_clarification IS NOT DISTINCT FROM z.requires_clarification)::BIGINT AS n_clarify FROM (FROM x WHERE i = 1) a JOIN (FROM x WHERE j = 1) z ON a.test_id = z.test_id GROUP BY a.domain""",
        "m_production": """WITH c AS (SELECT retrieval_method, is_fully_grounded, list_filter(cited_chunk_ids, lambda x: x IS NOT NULL) AS cited, coalesce(rejected_chunk_ids, []) AS gone FROM phase5_7_cases_results)
SELECT retrieval_method, count(*) AS n, count_if(len(cited) > 0)::BIGINT AS n_citing, round(avg(CASE WHEN len(cited) > 0 THEN (NOT list_contains(gone, cited[1]))::INT::DOUBLE END), 6) AS top_1,
 round(avg(CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: NOT list_contains(gone, x))) / len(cited) END), 6) AS "precision", round(avg(coalesce(is_fully_grounded, false)::INT::DOUBLE), 6) AS grounded FROM c GROUP BY retrieval_method""",
        "m_procedural": f"""WITH {best}, x AS (SELECT turn_row_id, min(CASE WHEN rule_type = 'PROCEDURE' THEN place END) AS at_, any_value(legal_event) FILTER (place = 1) AS event FROM best GROUP BY turn_row_id)
SELECT event, count(*) AS n, {', '.join(f"round(avg(coalesce(at_ <= {k}, false)::INT::DOUBLE), 6) AS top_{k}" for k in (1, 3, 5))} FROM x GROUP BY event""",
        "m_generation": """WITH c AS (SELECT *, coalesce(trim(full_answer) <> '', false) AS said FROM phase5_7_cases_results)
SELECT strategy, count(*) AS n, round(avg(said::INT::DOUBLE), 6) AS answered, round(avg(CASE WHEN said THEN length(full_answer)::DOUBLE END), 6) AS chars, round(avg(coalesce(len(list_distinct(cited_chunk_ids)), 0)::DOUBLE), 6) AS citations,
 round(avg(coalesce(abstain, false)::INT::DOUBLE), 6) AS abstained, round(avg(coalesce(needs_clarification, false)::INT::DOUBLE), 6) AS clarified FROM c GROUP BY strategy""",
        "m_overlap": f"""WITH c AS (SELECT case_row_id, {labels('full_answer')} AS named, coalesce(list_distinct(list_filter(list_transform(cited_chunk_ids, lambda c: regexp_extract(c, '#d(\\d+)', 1)), lambda a: a <> '')), []) AS cited FROM phase5_7_cases_results)
SELECT case_row_id, len(named)::INT AS n_named, len(cited)::INT AS n_cited, len(list_intersect(named, cited))::INT AS n_both, CASE WHEN len(cited) > 0 THEN round(len(list_intersect(named, cited)) / len(cited), 6) END AS recall FROM c""",
        "m_rubric": """WITH c AS (SELECT retrieval_method, round(CASE WHEN trim(full_answer) <> '' THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN is_fully_grounded THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN len(cited_chunk_ids) > 0 THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN NOT coalesce(abstain, false) THEN 0.1::DOUBLE ELSE 0.0 END, 2) AS score FROM phase5_7_cases_results)
SELECT retrieval_method, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg((score >= 0.7)::INT::DOUBLE), 6) AS pass_rate FROM c GROUP BY retrieval_method""",
        "m_snapshot": " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, {goal}::BIGINT AS goal, round(count(*) / {goal}, 6) AS ratio, count(*) >= {goal} AS reached FROM {name}" for name, goal in GOALS.items()),
        "m_regression": """WITH e AS (SELECT index_version, count(*) AS n, round(avg((coalesce(length(content), 0) > 0)::INT::DOUBLE), 6) AS filled, round(avg(total_score), 6) AS mean_score FROM scored_evidence GROUP BY index_version)
SELECT e.*, b.mean_score AS before, coalesce(e.mean_score < b.mean_score - 0.01, false) AS regressed FROM e LEFT JOIN e b ON b.index_version + 1 = e.index_version""",
        "v_formatted": f"""WITH x AS (SELECT case_row_id, list_transform(list_filter(cited_chunk_ids, lambda c: c IS NOT NULL), lambda c: {line}) AS l FROM phase5_7_cases_results)
SELECT case_row_id, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), chr(10)) AS citations FROM x""",
        "v_tokens": """SELECT evidence_row_id, md5(regexp_replace(regexp_replace(content, '([Tt]heo |tại |nêu tại )?khoản (\\d+) Điều (\\d+)', '[\\3.\\2]', 'g'), '([Tt]heo |tại |nêu tại )?Điều (\\d+)', '[\\2]', 'g')) AS text_md5 FROM scored_evidence""",
        "e_classified": f"""SELECT evidence_row_id, CASE {' '.join(f"WHEN {cond(x)} THEN '{x['name']}'" for x in RULE_TYPES)} ELSE 'other' END AS kind, concat_ws(',', {', '.join(f"CASE WHEN {cond(x)} THEN '{x['name']}' END" for x in RULE_TYPES)}) AS kinds FROM scored_evidence""",
        "e_repaired": f"""WITH {best}, x AS (SELECT turn_row_id, evidence_row_id, place, unnest(evidence_roles) AS role FROM best), y AS (SELECT turn_row_id, role, min(place) AS place, arg_min(evidence_row_id, place) AS evidence_row_id FROM x WHERE list_contains({roles}, role) GROUP BY ALL)
SELECT turn_row_id, count_if(place <= 2)::BIGINT AS n_covered, count(*) AS n_repaired, count(DISTINCT CASE WHEN place > 2 THEN evidence_row_id END) AS n_added FROM y GROUP BY turn_row_id""",
        "e_in_force": f"""SELECT evidence_row_id, e.turn_row_id FROM scored_evidence e JOIN turns t ON t.turn_row_id = e.turn_row_id WHERE {t.sql_contains_any('user_query', r.HISTORICAL)} OR e.doc_id IS NULL OR e.doc_id NOT IN (SELECT doc_id FROM legal_documents WHERE validity = 'REPEALED' AND doc_id IS NOT NULL)""",
        "e_sufficient": f"""WITH r AS (SELECT turn_row_id, count(DISTINCT role) AS n FROM (SELECT turn_row_id, unnest(evidence_roles) AS role FROM scored_evidence) WHERE list_contains({roles}, role) GROUP BY turn_row_id),
x AS (SELECT turn_row_id, count_if(coalesce(trim(content) <> '', false)) AS f, count(DISTINCT CASE WHEN legal_event <> 'UNKNOWN' THEN legal_event END) AS ev FROM scored_evidence GROUP BY turn_row_id)
SELECT x.turn_row_id, CASE WHEN f = 0 THEN 'empty' WHEN ev > 1 THEN 'mixed events' WHEN coalesce(n, 0) < {len(ROLES)} THEN 'roles missing' ELSE 'sufficient' END AS verdict FROM x LEFT JOIN r USING (turn_row_id)""",
        "e_contradicted": f"""WITH h AS (SELECT turn_row_id, flatten(list({labels('content')})) AS a, flatten(list({amounts('content')})) AS m FROM scored_evidence GROUP BY turn_row_id)
SELECT t.turn_row_id, len(list_filter({labels('assistant_response')}, lambda x: NOT list_contains(a, x)))::INT AS n_articles, len(list_filter({amounts('assistant_response')}, lambda x: NOT list_contains(m, x)))::INT AS n_amounts FROM turns t JOIN h USING (turn_row_id)""",
        "e_quotes": f"""WITH {best}, o AS (SELECT *, row_number() OVER (PARTITION BY turn_row_id, chunk_id ORDER BY place) AS again FROM best)
SELECT turn_row_id, rule_type, row_number() OVER (PARTITION BY turn_row_id, rule_type ORDER BY place)::INT AS quote_no, evidence_row_id, substring(content, 1, 120) AS quote FROM o WHERE again = 1 QUALIFY quote_no <= 3""",
        "e_overview": """WITH e AS (SELECT *, nullif(point, '') AS p FROM scored_evidence)
SELECT turn_row_id, doc_id, article_number, count(*) AS n_blocks, sum(coalesce(length(content), 0))::BIGINT AS n_chars, min(evidence_row_id) AS first_row FROM e
 WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM e w WHERE w.p IS NULL AND w.turn_row_id = e.turn_row_id AND w.doc_id = e.doc_id AND w.article_number = e.article_number AND w.clause_number = e.clause_number) GROUP BY turn_row_id, doc_id, article_number""",
    }
