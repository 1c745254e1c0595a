"""Queries over anchors, questions, conversations, jobs and the graph's chunks (R22-R26, Q2-Q17, A4-A20, H2-H11, L2-L7, G3-G12, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as t
from verdigris.operators import graph as g
from verdigris.operators import index, retrieve, rules
from verdigris.plans import retrieval_queries as r
from verdigris.plans.understanding_queries import EVENTS
from verdigris.session import written
from verdigris.sources.tables import table

LABOUR = ["lương", "lao động", "hợp đồng", "nghỉ", "tai nạn", "bảo hiểm", "công ty", "wage", "contract", "work"]
OUTSIDE = ["bóng đá", "thời tiết", "nấu ăn", "xổ số", "weather", "recipe"]
NEEDS = {"TERMINATION": ["contract_type"], "PAY": ["salary"], "OVERTIME": ["salary", "region"], "ACCIDENT": ["salary", "contract_type"], "MATERNITY": ["salary"]}
EVENT_ROLES = {"TERMINATION": ["deadline", "definition"], "ACCIDENT": ["amount", "definition"], "OVERTIME": ["amount"], "MATERNITY": ["deadline", "amount"], "PAY": ["amount", "deadline"]}
#: Facts that a turn states: (fact, words, value), and facts that words take back.
STATED = [("contract_term", ["không xác định thời hạn"], "không xác định"), ("contract_term", ["thời vụ"], "thời vụ"), ("relation", ["học nghề", "thử việc"], "thử việc"), ("relation", ["hợp đồng lao động", "chấm công"], "lao động"), ("topic", ["lương"], "tiền lương"), ("topic", ["nghỉ việc", "thôi việc"], "thôi việc"), ("accident", ["tai nạn"], "có")]
TAKEN_BACK = [("contract_term", ["học nghề", "thử việc"]), ("accident", ["không phải tai nạn"])]
MAIL = r"^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
#: Least similarity of a match that may lock, with its least margin to the next.
LOCK, MARGIN = 0.92, 0.05


# ------------------------------------------------------------------ anchors
def _matches(spark, d):
    """(query, key, ratio, containment, score, place): stored questions that match a stated one, the best first.

    The query's length sets the least numbers of shared words, share of the
    stored question's words and edit ratios; the 25 that hold most of their words
    are compared letter by letter.
    """
    e = table(spark, d, "phase5b_eval_dataset").select(F.col("row_id").alias("key"), t.search_key(F.col("question")).alias("text"), t.token_set(F.col("question")).alias("words"))
    # One row per text: copies of a question are one anchor.
    stored = e.where("size(words) > 0").groupBy("text").agg(F.min_by(F.struct("key", "words"), "key").alias("s")).select("text", "s.key", "s.words")
    # Every stated question meets every stored one, which share common words in nearly every pair: counted in blocks, without a row per pair.
    long = F.length("asked") >= 120
    asked = e.where(F.col("key") % r.EVERY == 0).select(F.col("key").alias("query"), F.col("text").alias("asked"), "words")
    bounds = asked.select("query", F.col("asked").alias("text"), "words", F.when(long, 3).otherwise(4).alias("least"), F.when(long, 550_000).otherwise(600_000).alias("least_share"))
    few = retrieve.containing(bounds, stored, 25).drop("rank")
    few = few.join(stored.select("key", "text"), "key").join(asked.select("query", "asked"), "query").withColumn("containment", F.col("share") / 1_000_000).drop("share")
    w = Window.partitionBy("query")
    ratio = F.round(1 - F.levenshtein("text", "asked") / F.greatest(F.length("text"), F.length("asked")), 6)
    scored = few.withColumn("ratio", ratio).where((F.col("ratio") >= F.when(long, 0.78).otherwise(0.86)) | ((F.col("ratio") >= F.when(long, 0.68).otherwise(0.70)) & (F.col("containment") >= 0.85)))
    scored = scored.withColumn("score", F.round(F.col("ratio") + 0.1 * F.col("containment"), 6))
    return scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "key"))).select("query", "key", "ratio", "containment", "score", "place", F.length("asked").alias("n_chars"))


def r_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).where("place <= 3").drop("n_chars")


def _nominated(spark, d):
    """(query, key, place): of the article that a query's best match expects, the two chunks that share most words with the query."""
    e = table(spark, d, "phase5b_eval_dataset")
    stated = e.where(F.col("row_id") % r.EVERY == 0)
    gold = e.select(F.col("row_id").alias("key"), "expected_doc_id", "expected_article").where("expected_doc_id IS NOT NULL AND expected_article IS NOT NULL")
    best = written(_matches(spark, d).where("place = 1").select("query", "key").join(gold, "key"))
    words = stated.select(F.col("row_id").alias("query"), t.token_set(F.col("question")).alias("asked"))
    chunks = table(spark, d, "scored_evidence").select(F.col("document_no").alias("expected_doc_id"), F.trim("article_number").try_cast("int").alias("expected_article"), "evidence_row_id", "article_title", "content")
    # At most one pair per stated question; only chunks of these articles are cut into words and shuffled.
    articles = best.select("expected_doc_id", "expected_article").distinct()
    c = chunks.join(F.broadcast(articles), ["expected_doc_id", "expected_article"], "left_semi").select("expected_doc_id", "expected_article", "evidence_row_id", t.token_set(F.concat_ws(" ", "article_title", "content")).alias("held"))
    met = best.drop("key").join(c, ["expected_doc_id", "expected_article"]).join(words, "query")
    order = Window.partitionBy("query").orderBy(F.size(F.array_intersect("asked", "held")).desc(), "evidence_row_id")
    return met.withColumn("place", F.row_number().over(order)).where("place <= 2").select("query", F.col("evidence_row_id").alias("key"), "place")


def r_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Nominated chunks first, then the BM25 ranking without them."""
    first = _nominated(spark, d).select("query", "key", F.lit(0).alias("arm"), F.col("place").alias("rank"))
    rest = r._bm25(spark, d).select("query", "key", F.lit(1).alias("arm"), "rank")
    both = retrieve.first_seen(first.unionByName(rest), "query", "arm")
    order = Window.partitionBy("query").orderBy("arm", "rank", "key")
    return both.withColumn("place", F.row_number().over(order)).select("query", F.col("key").alias("evidence_row_id"), (F.col("arm") == 0).alias("nominated"), "place")


def r_locks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stated question may be answered from its best match alone, and why not."""
    m = _matches(spark, d)
    best = m.where("place = 1").select("query", "key", "ratio", "score", "n_chars")
    second = m.where("place = 2").select("query", F.col("score").alias("second"))
    gold = table(spark, d, "phase5b_eval_dataset").select(F.col("row_id").alias("key"), "expected_doc_id", F.col("expected_article").alias("anchor"))
    top = r._bm25(spark, d, 5).join(table(spark, d, "scored_evidence").select(F.col("evidence_row_id").alias("key"), F.trim("article_number").try_cast("int").alias("article")), "key")
    x = best.join(second, "query", "left").join(gold, "key")
    agrees = x.join(top.select("query", "article"), "query", "left").groupBy("query").agg(F.bool_or(F.coalesce(F.col("anchor") == F.col("article"), F.lit(False))).alias("agrees"))
    y = x.join(agrees, "query")
    reason = (
        F.when(F.col("anchor").isNull(), "no anchors")
        .when((F.col("n_chars") < 100) & (F.col("ratio") < 0.97), "short question")
        .when(F.round(F.col("score") - F.col("second"), 6) < MARGIN, "ambiguous")
        .when(F.col("ratio") < LOCK, "not near enough")
        .when(~F.col("agrees"), "retrieval disagrees")
        .otherwise("locked")
    )
    return y.select("query", F.col("key").alias("match"), "ratio", reason.alias("reason"))


def r_retried(spark: SparkSession, d: str) -> DataFrame:
    """Where the best BM25 score of a question is poor, its expanded form is ranked too: new hits first, then the old ones not seen."""
    from verdigris.plans.text_queries import EXPANSIONS

    asked, made = r.questions(spark, d), r._index(spark, d)
    old = retrieve.bm25(asked, made, 5)
    poor = old.where("rank = 1 AND score < 40").select("query")
    again = asked.join(poor, "query").select("query", t.expand(F.col("text"), EXPANSIONS).alias("text"))
    new = retrieve.bm25(again, made, 5)
    both = new.select("query", "key", "rank", F.lit(0).alias("arm")).unionByName(old.select("query", "key", "rank", F.lit(1).alias("arm")))
    seen = retrieve.first_seen(both, "query", "arm")
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("arm", "rank", "key"))).select("query", F.col("key").alias("evidence_row_id"), "arm", "place")


# ------------------------------------------------------------------ questions
def q_scope(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question is the system's business: signals of it win over the list of other matters and plain sums."""
    q = F.col("user_query")
    sum_ = F.coalesce(q.rlike(r"^\s*\d+\s*[-+*/x]\s*\d+"), F.lit(False))
    scope = F.when(t.contains_any(q, LABOUR), "in").when(t.contains_any(q, OUTSIDE) | sum_, "out").when(F.coalesce(F.col("turn_no") > 1, F.lit(False)), "follow-up").otherwise("unclear")
    return table(spark, d, "turns").select("turn_row_id", scope.alias("scope"))


def _mapped(events, pairs):
    """The values of all labels in an array, in order, each once."""
    table_ = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.array_distinct(F.flatten(F.transform(events, lambda e: table_[e])))


def q_roles(spark: SparkSession, d: str) -> DataFrame:
    """The roles that evidence must play for a question's events; a question about an amount asks for it, one about meaning for nothing else."""
    q = F.col("user_query")
    events = rules.labels(q, EVENTS)
    roles = _mapped(events, EVENT_ROLES)
    more = F.when(t.contains_any(q, ["bao nhiêu", "mấy phần trăm"]), F.array_union(roles, F.array(F.lit("amount")))).otherwise(roles)
    final = F.when(t.contains_any(q, ["là gì", "nghĩa là"]), F.array_except(more, F.array(F.lit("amount"), F.lit("deadline")))).otherwise(more)
    return table(spark, d, "turns").select("turn_row_id", F.array_join(final, ",").alias("roles"))


def q_issue(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a question that are amounts or lengths, with their units, and how specific that makes it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("user_query", F.lit(""))), r"\d{1,2}/\d{1,2}/\d{4}", " "), r"(điều|khoản|điểm|số) +\d+(?:/\d+)*(?:/[a-zđ]+-[a-zđ]+)?", " ")
    found = lambda n: F.regexp_extract_all(bare, F.lit(r"(\d[\d.,]*) (tháng|ngày|giờ|ca|năm|triệu|đồng)"), F.lit(n))
    n = F.size(found(1))
    kind = F.when(n >= 2, "detailed").when(n == 1, "specific").when(F.size(t.article_labels(F.col("user_query"))) > 0, "reference").otherwise("general")
    return table(spark, d, "turns").select("turn_row_id", F.array_join(found(1), ";").alias("numbers"), F.array_join(F.array_distinct(found(2)), ",").alias("units"), kind.alias("specificity"))


def q_premises(spark: SparkSession, d: str) -> DataFrame:
    """Facts that a question's events need and the turn doesn't give; none missing is sufficient."""
    wanted = _mapped(rules.labels(F.col("user_query"), EVENTS), NEEDS)
    missing = F.array_except(wanted, F.coalesce(F.map_keys("facts"), F.array().cast("array<string>")))
    return table(spark, d, "turns").select("turn_row_id", F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "sufficient").otherwise("clarify").alias("verdict"))


def q_complexity(spark: SparkSession, d: str) -> DataFrame:
    """0 to 10: two for each event, one for each further question mark, number and 15 words."""
    q = t.normalize_query(F.col("user_query"))
    score = 2 * F.size(rules.labels(F.col("user_query"), EVENTS)) + F.greatest(t.count_matches(F.col("user_query"), r"\?") - 1, F.lit(0)) + t.count_matches(F.col("user_query"), r"\d+") + F.floor(F.size(F.split(q, " ")) / 15)
    return table(spark, d, "turns").select("turn_row_id", F.least(score, F.lit(10)).cast("int").alias("complexity"))


def q_overview(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for an overview, and answers to them that are too thin for one."""
    asks = t.contains_any(F.col("user_query"), ["cần giấy tờ gì", "gồm những gì", "thế nào", "ra sao"])
    words = F.when(F.coalesce(F.trim("assistant_response") == "", F.lit(True)), 0).otherwise(F.size(F.split(F.trim("assistant_response"), r"\s+")))
    items = t.count_matches(F.col("assistant_response"), r"(?:^|\n)(?:- |\d+\. )")
    return table(spark, d, "turns").select("turn_row_id", asks.alias("is_overview"), (asks & (words < 100) & (items < 2)).alias("expand"))


def q_chips(spark: SparkSession, d: str) -> DataFrame:
    """What to offer next, by the state of a case."""
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    chips = F.when(F.coalesce("needs_clarification", F.lit(False)), lit("answer", "skip")).when(F.coalesce("abstain", F.lit(False)), lit("rephrase", "contact")).when(~F.coalesce("is_fully_grounded", F.lit(False)), lit("sources", "rephrase")).otherwise(lit("sources", "example", "export"))
    return table(spark, d, "phase5_7_cases_results").select("case_row_id", F.array_join(chips, ",").alias("chips"))


# ------------------------------------------------------------------ conversations
def _ops(spark, d):
    """(conv_id, turn_no, turn_row_id, fact, value): what each turn states; a null value takes a fact back."""
    q = F.col("user_query")
    said = [F.when(t.contains_any(q, words), F.struct(F.lit(fact).alias("fact"), F.lit(value).alias("value"), F.lit(k).alias("k"))) for k, (fact, words, value) in enumerate(STATED)]
    back = [F.when(t.contains_any(q, words), F.struct(F.lit(fact).alias("fact"), F.lit(None).cast("string").alias("value"), F.lit(100 + k).alias("k"))) for k, (fact, words) in enumerate(TAKEN_BACK)]
    return table(spark, d, "turns").select("conv_id", "turn_no", "turn_row_id", F.explode(F.array_compact(F.array(*said, *back))).alias("o")).select("conv_id", "turn_no", "turn_row_id", "o.*")


def h_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a conversation, read from its questions: the last statement holds, and a later retraction takes it back."""
    last = _ops(spark, d).groupBy("conv_id", "fact").agg(F.max_by(F.struct("value"), F.struct("turn_no", "turn_row_id", "k")).alias("v"))
    return last.where("v.value IS NOT NULL").select("conv_id", "fact", "v.value")


def h_supplemented(spark: SparkSession, d: str) -> DataFrame:
    """Short questions after the first turn with the topic that earlier turns stated, where they don't name it."""
    topics = _ops(spark, d).where("fact = 'topic'").groupBy("turn_row_id").agg(F.max_by("value", "k").alias("topic"))
    turns = table(spark, d, "turns").join(topics, "turn_row_id", "left")
    w = Window.partitionBy("conv_id").orderBy("turn_no", "turn_row_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("topic", ignorenulls=True).over(w)
    q = t.normalize_query(F.col("user_query"))
    lacks = (F.size(F.split(q, " ")) <= 20) & F.col("before").isNotNull() & ~F.contains(F.lower(q), F.col("before"))
    return turns.withColumn("before", before).select("turn_row_id", F.when(lacks, F.concat(q, F.lit(" ("), F.col("before"), F.lit(")"))).otherwise(q).alias("resolved"))


def h_summary(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a turn in one line, and the last three questions clipped to 200 characters each."""
    keys = F.array_sort(F.map_keys(F.coalesce("facts", F.create_map().cast("map<string,string>"))))
    facts = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.col("facts")[k])), "; ")
    w = Window.partitionBy("conv_id").orderBy("turn_no", "turn_row_id").rowsBetween(-2, 0)
    history = F.array_join(F.collect_list(F.substring("user_query", 1, 200)).over(w), "\n")
    return table(spark, d, "turns").select("turn_row_id", facts.alias("facts_line"), F.md5(history).alias("history_md5"))


def h_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of each owner, the latest first, and how many exchanges are left when the last is taken back."""
    c = table(spark, d, "turns").groupBy("owner_id", "conv_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("n"), F.max_by("turn_row_id", F.struct("turn_no", "turn_row_id")).alias("popped"))
    order = Window.partitionBy("owner_id").orderBy(F.desc("updated_at"), "conv_id")
    return c.withColumn("place", F.row_number().over(order)).select("owner_id", "conv_id", "updated_at", "place", (F.col("n") - 1).alias("n_left"), "popped")


def h_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback as it is recorded: texts capped as the interface does, and blank without consent."""
    share = F.coalesce("share_consent", F.lit(False))
    cap = lambda c, n: F.when(share, F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)).otherwise("")
    return table(spark, d, "feedback").select("feedback_row_id", "rating", cap("reported_answer", 4000).alias("answer"), F.substring(F.trim(F.coalesce("comment", F.lit(""))), 1, 1000).alias("note"), cap("question", 1000).alias("asked"))


# ------------------------------------------------------------------ administration
def a_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the newest feedback; the size of a page is the feature."""
    f = table(spark, d, "feedback").select("feedback_row_id", "rating", "status", "created_at")
    return f.orderBy(F.desc("created_at"), F.desc("feedback_row_id")).offset(50).limit(50)


def a_periods(spark: SparkSession, d: str) -> DataFrame:
    """Salary periods of a JSON column as typed rows; places count from 1, and what can't be read is null."""
    array = F.from_json(F.get_json_object("facts", "$.salary_periods"), "array<struct<month:string,preceding_salary:string>>")
    p = table(spark, d, "wave2_calculator_benchmark").select("bench_row_id", F.posexplode(array).alias("n", "p"))
    return p.select("bench_row_id", (F.col("n") + 1).alias("place"), F.try_to_date(F.concat("p.month", F.lit("-01")), "yyyy-MM-dd").alias("month"))


def a_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How the status of a feedback changed between deliveries; it may only move on."""
    steps = F.create_map(F.lit("pending"), F.lit(0), F.lit("reviewing"), F.lit(1), F.lit("resolved"), F.lit(2))
    w = Window.partitionBy("id").orderBy("ingested_at", "feedback_row_id")
    f = table(spark, d, "feedback").select(F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before IS NOT NULL AND after IS NOT NULL")
    return f.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("allowed", F.coalesce(steps[F.col("after")] >= steps[F.col("before")], F.lit(False)))


def a_restored(spark: SparkSession, d: str) -> DataFrame:
    """Titles of generation 2 brought back from generation 1 where chunk and text are the same."""
    latest = index.latest(table(spark, d, "scored_evidence"), ["chunk_id", "index_version"], ["ingested_at", "evidence_row_id"])
    of = lambda v: latest.where(F.col("index_version") == v).withColumn("sha", F.sha2("content", 256))
    old = of(1).select("chunk_id", "sha", F.col("article_title").alias("kept_title"))
    return of(2).join(old, ["chunk_id", "sha"], "left").select("chunk_id", F.coalesce("kept_title", "article_title").alias("title"), (F.col("kept_title").isNotNull() & ~F.col("kept_title").eqNullSafe(F.col("article_title"))).alias("restored"))


def a_resumable(spark: SparkSession, d: str) -> DataFrame:
    """The three oldest open jobs of each kind, and whether they are stale."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "error", "click"))
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    stale = F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp") - F.expr("INTERVAL 10 MINUTES")
    return e.withColumn("place", F.row_number().over(w)).where("place <= 3").select("event_type", "place", "event_id", stale.alias("stale"))


def a_panels(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the panels: the scale of a chart rounded up to fives, the last good run, kinds of action."""
    per_kind = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
    return per_kind.agg(F.count("*").alias("n_kinds"), (F.ceil(F.max("n") / 5) * 5).alias("chart_max"), F.max(F.when(F.col("event_type") == "purchase", F.col("last_id"))).alias("last_purchase"))


def a_selected(spark: SparkSession, d: str) -> DataFrame:
    """Filters as a service takes them: one of a list, and equal to a value."""
    return table(spark, d, "feedback").where(F.col("status").isin("pending", "reviewing") & (F.col("rating") == "down")).select("feedback_row_id", "status")


# ------------------------------------------------------------------ datasets
def l_alpaca(spark: SparkSession, d: str) -> DataFrame:
    """Instruction records of grounded answers."""
    c = table(spark, d, "phase5_7_cases_results").where("is_fully_grounded AND trim(full_answer) <> '' AND query IS NOT NULL")
    record = F.to_json(F.struct(F.col("query").alias("instruction"), F.lit("").alias("input"), F.col("full_answer").alias("output")))
    return c.select("case_row_id", F.md5(record).alias("record_md5"))


def l_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with each chunk's newest row; ids whose newest row has no text are dropped."""
    e = table(spark, d, "scored_evidence")
    newest = e.groupBy("chunk_id").agg(F.max_by(F.struct("evidence_row_id", "content"), F.struct("index_version", "evidence_row_id")).alias("x"), F.count("*").alias("n_rows"))
    return newest.where("coalesce(trim(x.content), '') <> ''").select("chunk_id", "x.evidence_row_id", "n_rows")


# ------------------------------------------------------------------ graph
def _mentions(spark, d):
    """(key, document_no, article): articles of its own document that a chunk names."""
    e = table(spark, d, "scored_evidence")
    named = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"khoản \d+ Điều (\d+)"), F.lit(1))
    return e.select(F.col("evidence_row_id").alias("key"), "document_no", F.explode(F.array_distinct(named)).alias("article")).where("document_no IS NOT NULL")


def g_chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    """References as edges between chunks: every chunk of the named article, not the chunk itself."""
    members = table(spark, d, "scored_evidence").select(F.col("evidence_row_id").alias("dst"), "document_no", F.trim("article_number").alias("article"))
    return _mentions(spark, d).join(members, ["document_no", "article"]).where("key <> dst").select(F.col("key").alias("src"), "dst")


def g_article_step(spark: SparkSession, d: str) -> DataFrame:
    """Articles that the BM25 rankings' chunks refer to, per query, with the best score that leads there."""
    ranked = r._bm25(spark, d, 8).select("query", "key", "score")
    reached = ranked.join(_mentions(spark, d), "key").groupBy("query", "document_no", "article").agg(F.max("score").alias("score"))
    own = ranked.join(table(spark, d, "scored_evidence").select(F.col("evidence_row_id").alias("key"), "document_no", F.trim("article_number").alias("article")), "key").select("query", "document_no", "article").distinct()
    return reached.join(own, ["query", "document_no", "article"], "left_anti").select("query", "document_no", "article", F.round(F.col("score").cast("double") * 0.9, 6).alias("score"))


def g_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of nodes that aren't unique or are missing, per kind of node."""
    e, law = table(spark, d, "scored_evidence"), table(spark, d, "legal_documents")
    one = lambda df, kind, key: df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n")).agg(
        F.count_if((F.col("n") > 1) & F.col("k").isNotNull()).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_missing")
    ).select(F.lit(kind).alias("kind"), "n_repeated", "n_missing")
    return one(e, "chunk", "chunk_id").unionByName(one(law, "document", "doc_id")).unionByName(one(law, "number", "document_no"))


def g_context(spark: SparkSession, d: str) -> DataFrame:
    """Per document of the registry what the graph says of its chunks: the first three, clipped to 150 characters."""
    w = Window.partitionBy("document_no").orderBy("evidence_row_id")
    c = table(spark, d, "scored_evidence").where("content <> ''").withColumn("n", F.row_number().over(w)).where("n <= 3")
    line = F.concat(F.lit("- Điều "), F.trim("article_number"), F.lit(": "), F.substring("content", 1, 150))
    lines = c.select("document_no", "n", line.alias("line")).where("line IS NOT NULL").groupBy("document_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return table(spark, d, "legal_documents").select("document_no").distinct().join(lines, "document_no", "left").select("document_no", F.md5(F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<n:int,line:string>>")), lambda x: x["line"]), "\n")).alias("context_md5"), F.coalesce(F.size("l"), F.lit(0)).alias("n_lines"))


# ------------------------------------------------------------------ small tools
def u_articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents and articles that cases cite, read from the ids."""
    c = table(spark, d, "phase5_7_cases_results").select(F.explode("cited_chunk_ids").alias("c"))
    part = lambda n: F.regexp_extract("c", r"^([A-Z0-9_]+)#d(\d+)", n)
    return c.where(F.col("c").rlike(r"^[A-Z0-9_]+#d\d+")).groupBy(part(1).alias("doc_id"), part(2).try_cast("int").alias("article")).agg(F.count("*").alias("n"))


def u_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Three notions of what is relevant to a question's gold, counted over all evidence: document, article, and the preamble where article 1 is expected."""
    e = table(spark, d, "scored_evidence").groupBy(F.col("document_no").alias("doc"), F.trim("article_number").try_cast("int").alias("article")).agg(F.count("*").alias("n"))
    q = table(spark, d, "phase5b_eval_dataset").where("expected_doc_id IS NOT NULL").select("row_id", F.col("expected_doc_id").alias("doc"), "expected_article")
    j = q.join(e, "doc", "left")
    same = F.col("article") == F.col("expected_article")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return j.groupBy("row_id").agg(count(F.lit(True)).alias("n_document"), count(same).alias("n_article"), count(same | ((F.col("expected_article") == 1) & F.col("article").isNull())).alias("n_with_preamble"))


def u_suite(spark: SparkSession, d: str) -> DataFrame:
    """A suite's summary: latency over all cases, measures of answers only over those that gave one."""
    c = table(spark, d, "phase5_7_cases_results")
    gave = F.coalesce(F.trim("full_answer") != "", F.lit(False))
    return c.agg(
        F.count("*").alias("n"), F.count_if(gave).alias("n_answers"), F.round(F.avg("retrieval_latency_ms"), 6).alias("retrieval_ms"),
        F.round(F.avg(F.when(gave, F.col("llm_latency_ms"))), 6).alias("answer_ms"), F.round(F.avg(F.when(gave, F.coalesce("is_fully_grounded", F.lit(False)).cast("double"))), 6).alias("grounded"),
        F.sum(F.coalesce(F.size("rejected_chunk_ids"), F.lit(0))).alias("n_rejected"),
    )


def u_terminal(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end before any retrieval, and how."""
    q = t.normalize_query(F.col("user_query"))
    greet = rules.remainder(F.col("user_query"), ["xin chao", "chao ban", "cam on", "hello", "thanks"]) == ""
    how = F.when(q == "", "empty").when(greet, "small talk").when(~t.contains_any(F.col("user_query"), LABOUR) & t.contains_any(F.col("user_query"), OUTSIDE), "out of scope").otherwise("retrieve")
    return table(spark, d, "turns").select("turn_row_id", how.alias("result"))


def u_pointer(spark: SparkSession, d: str) -> DataFrame:
    """The generation to serve: the newest whose texts are filled to nine tenths, and the health of all."""
    e = table(spark, d, "scored_evidence").groupBy("index_version").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.trim("content") != "", F.lit(False)).cast("double")), 6).alias("filled"))
    top = e.where("filled >= 0.9").agg(F.max("index_version").alias("active"))
    return e.join(top, F.col("index_version") == F.col("active"), "left").select("index_version", "n", "filled", F.col("active").isNotNull().alias("active"))


def u_skips(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the registry that have no chunk yet."""
    return table(spark, d, "legal_documents").select("doc_id", "title").join(table(spark, d, "scored_evidence").select("doc_id").distinct(), "doc_id", "left_anti")


def u_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Forum posts as scenarios: links, blanks and empty lines gone, the first question apart."""
    text = F.regexp_replace(F.regexp_replace(F.col("text"), r"https?://[^ \n]+", ""), r"[ \t]+", " ")
    clean = F.trim(F.regexp_replace(text, r" *\n\s*", "\n"))
    return table(spark, d, "documents").where("genre = 'forum' AND text IS NOT NULL").select("doc_id", F.length(clean).alias("n_chars"), F.regexp_extract(clean, r"([^.?!\n]*\?)", 1).alias("question"))


def u_routes(spark: SparkSession, d: str) -> DataFrame:
    """Folders of documents by the kind in their number; what has no folder is told."""
    low = F.coalesce("document_no", F.lit(""))
    folder = F.when(low.like("%NĐ-CP"), "decrees").when(low.like("%/TT-%"), "circulars").when(low.like("%/QH-%"), "laws").when(low.like("%/QĐ-%"), "decisions").otherwise("unknown")
    return table(spark, d, "legal_documents").select("doc_id", folder.alias("folder"))


def u_valid(spark: SparkSession, d: str) -> DataFrame:
    """Formats: ids of owners, ids of feedback, and whether a comment's last word is an e-mail address."""
    last = F.element_at(F.split(F.trim(F.coalesce("comment", F.lit(""))), " "), -1)
    return table(spark, d, "feedback").select("feedback_row_id", F.coalesce(F.col("owner_id").rlike(r"^u\d{7}$"), F.lit(False)).alias("owner_ok"), F.coalesce(F.length("id") > 3, F.lit(False)).alias("id_ok"), last.rlike(MAIL).alias("ends_in_mail"))


def u_sections(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a turn as an answer of sections, one for each rule type, its lines in the order of rows."""
    e = table(spark, d, "scored_evidence").where("content <> ''").select("turn_row_id", F.coalesce("rule_type", F.lit("OTHER")).alias("rule_type"), "evidence_row_id", F.substring("content", 1, 80).alias("line"))
    section = e.groupBy("turn_row_id", "rule_type").agg(F.array_sort(F.collect_list(F.struct("evidence_row_id", "line"))).alias("l"))
    text = F.concat(F.lit("## "), F.col("rule_type"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    whole = section.select("turn_row_id", "rule_type", text.alias("s")).groupBy("turn_row_id").agg(F.array_sort(F.collect_list(F.struct("rule_type", "s"))).alias("s"))
    return whole.select("turn_row_id", F.size("s").alias("n_sections"), F.md5(F.array_join(F.transform("s", lambda x: x["s"]), "\n\n")).alias("text_md5"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] in ("r_", "q_", "h_", "a_", "l_", "g_", "u_") and callable(f)}


def oracle_sql() -> dict:
    from verdigris.plans.text_queries import EXPANSIONS

    bm = r.oracle_sql()["bm25_topk"]
    bm = bm[len("WITH ") : bm.rindex(" SELECT query, key AS")]
    q_cte = "q AS (SELECT row_id AS query, question AS text FROM phase5b_eval_dataset WHERE row_id % 50 = 0)"
    key = lambda c: f"trim(regexp_replace({t.sql_fold(c)}, '[^a-z0-9]+', ' ', 'g'))"
    has = t.sql_contains_any
    words = lambda c: f"list_distinct({t.sql_tokens(c)})"
    matches = f"""ev AS (SELECT row_id AS key, {key('question')} AS text, {words('question')} AS ws FROM phase5b_eval_dataset),
st AS (SELECT text, key, ws FROM ev WHERE len(ws) > 0 QUALIFY row_number() OVER (PARTITION BY text ORDER BY key) = 1), aq AS (SELECT key AS query, text AS asked, ws AS qws FROM ev WHERE key % 50 = 0),
sh AS (SELECT query, key, asked, text, len(list_intersect(qws, ws)) AS overlap, round(len(list_intersect(qws, ws)) / len(ws), 6) AS containment FROM aq, st WHERE text <> asked),
fw AS (SELECT * FROM sh WHERE overlap >= CASE WHEN length(asked) >= 120 THEN 3 ELSE 4 END AND containment >= CASE WHEN length(asked) >= 120 THEN 0.55 ELSE 0.60 END QUALIFY row_number() OVER (PARTITION BY query ORDER BY containment DESC, key) <= 25),
ra AS (SELECT *, round(1 - levenshtein(text, asked) / greatest(length(text), length(asked)), 6) AS ratio FROM fw),
ma AS (SELECT query, key, ratio, containment, round(ratio + 0.1::DOUBLE * containment, 6) AS score, length(asked) AS n_chars, row_number() OVER (PARTITION BY query ORDER BY round(ratio + 0.1::DOUBLE * containment, 6) DESC, key)::INT AS place FROM ra
 WHERE ratio >= CASE WHEN length(asked) >= 120 THEN 0.78 ELSE 0.86 END OR (ratio >= CASE WHEN length(asked) >= 120 THEN 0.68 ELSE 0.70 END AND containment >= 0.85))"""
    nominated = f"""no AS (SELECT ma.query, e.evidence_row_id AS key, row_number() OVER (PARTITION BY ma.query ORDER BY len(list_intersect({words('q.question')}, {words("concat_ws(' ', e.article_title, e.content)")})) DESC, e.evidence_row_id)::INT AS place
 FROM ma JOIN phase5b_eval_dataset a ON a.row_id = ma.key JOIN phase5b_eval_dataset q ON q.row_id = ma.query JOIN scored_evidence e ON e.document_no = a.expected_doc_id AND try_cast(trim(e.article_number) AS INT) = a.expected_article WHERE ma.place = 1)"""
    extras = ", ".join(f"CASE WHEN {has('text', tr)} AND NOT contains(lower(coalesce(text, '')), '{more}') THEN '{more}' END" for tr, more in EXPANSIONS)
    again = bm.replace(q_cte, f"q AS (SELECT query, concat_ws(' ', text, array_to_string(list_filter([{extras}], lambda x: x IS NOT NULL), ' ')) AS text FROM (SELECT row_id AS query, question AS text FROM phase5b_eval_dataset WHERE row_id % 50 = 0) WHERE query IN (SELECT query FROM poor))", 1)

    def cond(rule):
        return has("user_query", rule["any"]) + "".join(f" AND NOT {has('user_query', [w])}" for w in rule.get("none", []))

    events = "list_filter([" + ", ".join(f"CASE WHEN {cond(x)} THEN '{x['name']}' END" for x in EVENTS) + "], lambda x: x IS NOT NULL)"
    first = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"

    def mapped(pairs):
        whole = "flatten([" + ", ".join(f"CASE WHEN {cond(x)} THEN [{', '.join(repr(y) for y in pairs[x['name']])}] ELSE [] END" for x in EVENTS) + "])"
        return first(whole)

    ops = " UNION ALL ".join(
        [f"SELECT conv_id, turn_no, turn_row_id, '{f}' AS fact, '{v}' AS value, {k} AS k FROM turns WHERE {has('user_query', ws)}" for k, (f, ws, v) in enumerate(STATED)]
        + [f"SELECT conv_id, turn_no, turn_row_id, '{f}', NULL, {100 + k} FROM turns WHERE {has('user_query', ws)}" for k, (f, ws) in enumerate(TAKEN_BACK)]
    )
    norm = t.sql_normalize_query("user_query")
    latest = "l AS (SELECT * FROM scored_evidence QUALIFY row_number() OVER (PARTITION BY chunk_id, index_version ORDER BY ingested_at DESC NULLS LAST, evidence_row_id DESC) = 1)"
    mentions = "mn AS (SELECT DISTINCT evidence_row_id AS key, document_no, unnest(regexp_extract_all(coalesce(content, ''), 'khoản \\d+ Điều (\\d+)', 1)) AS article FROM scored_evidence WHERE document_no IS NOT NULL)"
    bare = "regexp_replace(regexp_replace(lower(coalesce(user_query, '')), '\\d{1,2}/\\d{1,2}/\\d{4}', ' ', 'g'), '(điều|khoản|điểm|số) +\\d+(?:/\\d+)*(?:/[a-zđ]+-[a-zđ]+)?', ' ', 'g')"
    found = lambda n: f"regexp_extract_all({bare}, '(\\d[\\d.,]*) (tháng|ngày|giờ|ca|năm|triệu|đồng)', {n})"
    greet = f"concat(' ', {key('user_query')}, ' ')"
    for phrase in sorted(["xin chao", "chao ban", "cam on", "hello", "thanks"], key=lambda p: (-len(p), p)):
        greet = f"replace({greet}, ' {phrase} ', ' ')"
    unique = lambda kind, column, source: f"""SELECT '{kind}' AS kind, count_if(n > 1 AND k IS NOT NULL)::BIGINT AS n_repeated, coalesce(sum(CASE WHEN k IS NULL THEN n END), 0)::BIGINT AS n_missing FROM (SELECT {column}::VARCHAR AS k, count(*) AS n FROM {source} GROUP BY 1)"""
    return {
        "r_matches": f"WITH {matches} SELECT query, key, ratio, containment, score, place FROM ma WHERE place <= 3",
        "r_anchored": f"""WITH {bm}, {matches}, {nominated}, u AS (SELECT query, key, 0 AS arm, place AS rank FROM no WHERE place <= 2 UNION ALL SELECT query, key, 1, rank FROM bmr WHERE rank <= 10),
once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY arm, rank) = 1)
SELECT query, key AS evidence_row_id, arm = 0 AS nominated, row_number() OVER (PARTITION BY query ORDER BY arm, rank, key)::INT AS place FROM once""",
        "r_locks": f"""WITH {bm}, {matches}, x AS (SELECT b.query, b.key, b.ratio, b.score, b.n_chars, s.score AS second, e.expected_article AS anchor FROM ma b LEFT JOIN ma s ON s.query = b.query AND s.place = 2 JOIN phase5b_eval_dataset e ON e.row_id = b.key WHERE b.place = 1),
t5 AS (SELECT query, try_cast(trim(article_number) AS INT) AS article FROM bmr JOIN scored_evidence ON evidence_row_id = key WHERE rank <= 5)
SELECT query, key AS match, ratio, CASE WHEN anchor IS NULL THEN 'no anchors' WHEN n_chars < 100 AND ratio < 0.97 THEN 'short question' WHEN round(score - second, 6) < {MARGIN} THEN 'ambiguous' WHEN ratio < {LOCK} THEN 'not near enough'
 WHEN NOT EXISTS (SELECT 1 FROM t5 WHERE t5.query = x.query AND t5.article = x.anchor) THEN 'retrieval disagrees' ELSE 'locked' END AS reason FROM x""",
        "r_retried": f"""WITH old AS (WITH {bm} SELECT * FROM bmr WHERE rank <= 5), poor AS (SELECT query FROM old WHERE rank = 1 AND score < 40), new AS (WITH {again} SELECT * FROM bmr WHERE rank <= 5),
u AS (SELECT query, key, rank, 0 AS arm FROM new UNION ALL SELECT query, key, rank, 1 FROM old), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY arm, rank) = 1)
SELECT query, key AS evidence_row_id, arm, row_number() OVER (PARTITION BY query ORDER BY arm, rank, key)::INT AS place FROM f""",
        "q_scope": f"""SELECT turn_row_id, CASE WHEN {has('user_query', LABOUR)} THEN 'in' WHEN {has('user_query', OUTSIDE)} OR coalesce(regexp_matches(user_query, '^\\s*\\d+\\s*[-+*/x]\\s*\\d+'), false) THEN 'out' WHEN turn_no > 1 THEN 'follow-up' ELSE 'unclear' END AS scope FROM turns""",
        "q_roles": f"""WITH x AS (SELECT turn_row_id, {mapped(EVENT_ROLES)} AS roles, {has('user_query', ['bao nhiêu', 'mấy phần trăm'])} AS a, {has('user_query', ['là gì', 'nghĩa là'])} AS m FROM turns),
y AS (SELECT turn_row_id, m, CASE WHEN a AND NOT list_contains(roles, 'amount') THEN list_append(roles, 'amount') ELSE roles END AS roles FROM x)
SELECT turn_row_id, array_to_string(CASE WHEN m THEN list_filter(roles, lambda x: x NOT IN ('amount', 'deadline')) ELSE roles END, ',') AS roles FROM y""",
        "q_issue": f"""SELECT turn_row_id, array_to_string({found(1)}, ';') AS numbers, array_to_string({first(found(2))}, ',') AS units,
 CASE WHEN len({found(1)}) >= 2 THEN 'detailed' WHEN len({found(1)}) = 1 THEN 'specific' WHEN regexp_matches(lower(coalesce(user_query, '')), 'điều\\s+(\\d+[a-zđ]?)') THEN 'reference' ELSE 'general' END AS specificity FROM turns""",
        "q_premises": f"""WITH x AS (SELECT turn_row_id, list_filter({mapped(NEEDS)}, lambda x: NOT list_contains(coalesce(map_keys(facts), []), x)) AS missing FROM turns)
SELECT turn_row_id, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'sufficient' ELSE 'clarify' END AS verdict FROM x""",
        "q_complexity": f"""SELECT turn_row_id, least(10, 2 * len({events}) + greatest(len(regexp_extract_all(coalesce(user_query, ''), '\\?')) - 1, 0) + len(regexp_extract_all(coalesce(user_query, ''), '\\d+')) + len(string_split({norm}, ' ')) // 15)::INT AS complexity FROM turns""",
        "q_overview": f"""WITH x AS (SELECT turn_row_id, {has('user_query', ['cần giấy tờ gì', 'gồm những gì', 'thế nào', 'ra sao'])} AS o, CASE WHEN coalesce(trim(assistant_response), '') = '' THEN 0 ELSE len(regexp_split_to_array(trim(assistant_response), '\\s+')) END AS w,
 len(regexp_extract_all(coalesce(assistant_response, ''), '(?:^|\\n)(?:- |\\d+\\. )')) AS i FROM turns) SELECT turn_row_id, o AS is_overview, o AND w < 100 AND i < 2 AS expand FROM x""",
        "q_chips": """SELECT case_row_id, CASE WHEN needs_clarification THEN 'answer,skip' WHEN abstain THEN 'rephrase,contact' WHEN NOT coalesce(is_fully_grounded, false) THEN 'sources,rephrase' ELSE 'sources,example,export' END AS chips FROM phase5_7_cases_results""",
        "h_extracted": f"""WITH o AS ({ops}), x AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conv_id, fact ORDER BY turn_no DESC NULLS LAST, turn_row_id DESC, k DESC) = 1) SELECT conv_id, fact, value FROM x WHERE value IS NOT NULL""",
        "h_supplemented": f"""WITH o AS ({ops}), tp AS (SELECT turn_row_id, arg_max(value, k) AS topic FROM o WHERE fact = 'topic' GROUP BY turn_row_id),
x AS (SELECT t.turn_row_id, {norm} AS q, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no NULLS FIRST, t.turn_row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns t LEFT JOIN tp ON tp.turn_row_id = t.turn_row_id)
SELECT turn_row_id, CASE WHEN len(string_split(q, ' ')) <= 20 AND before IS NOT NULL AND NOT contains(lower(q), before) THEN concat(q, ' (', before, ')') ELSE q END AS resolved FROM x""",
        "h_summary": """SELECT turn_row_id, coalesce(array_to_string(list_transform(list_sort(map_keys(facts)), lambda k: concat(k, ': ', facts[k])), '; '), '') AS facts_line,
 md5(coalesce(string_agg(substring(user_query, 1, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn_no NULLS FIRST, turn_row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '')) AS history_md5 FROM turns""",
        "h_sessions": """WITH c AS (SELECT owner_id, conv_id, max(created_at) AS updated_at, count(*) AS n, arg_max(turn_row_id, (turn_no, turn_row_id)) AS popped FROM turns GROUP BY owner_id, conv_id)
SELECT owner_id, conv_id, updated_at, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, conv_id)::INT AS place, n - 1 AS n_left, popped FROM c""",
        "h_feedback": """SELECT feedback_row_id, rating, CASE WHEN share_consent THEN substring(trim(coalesce(reported_answer, '')), 1, 4000) ELSE '' END AS answer, substring(trim(coalesce(comment, '')), 1, 1000) AS note,
 CASE WHEN share_consent THEN substring(trim(coalesce(question, '')), 1, 1000) ELSE '' END AS asked FROM feedback""",
        "a_page": "SELECT feedback_row_id, rating, status, created_at FROM feedback ORDER BY created_at DESC NULLS LAST, feedback_row_id DESC LIMIT 50 OFFSET 50",
        "a_periods": """WITH x AS (SELECT bench_row_id, json_extract(facts, '$.salary_periods[*]') AS a FROM wave2_calculator_benchmark WHERE json_valid(facts) AND json_type(facts, '$.salary_periods') = 'ARRAY')
SELECT bench_row_id, generate_subscripts(a, 1)::INT AS place, try_cast((json_extract_string(unnest(a), '$.month') || '-01') AS DATE) AS month FROM x""",
        "a_transitions": """WITH f AS (SELECT lag(status) OVER (PARTITION BY id ORDER BY ingested_at, feedback_row_id) AS before, status AS after FROM feedback), s AS (SELECT * FROM (VALUES ('pending', 0), ('reviewing', 1), ('resolved', 2)) v(name, step))
SELECT before, after, count(*) AS n, coalesce(any_value(b.step) >= any_value(a.step), false) AS allowed FROM f LEFT JOIN s a ON a.name = before LEFT JOIN s b ON b.name = after WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY before, after""",
        "a_restored": f"""WITH {latest} SELECT n.chunk_id, coalesce(o.article_title, n.article_title) AS title, o.article_title IS NOT NULL AND o.article_title IS DISTINCT FROM n.article_title AS restored
FROM (FROM l WHERE index_version = 2) n LEFT JOIN (FROM l WHERE index_version = 1) o ON o.chunk_id = n.chunk_id AND o.content = n.content""",
        "a_resumable": """SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS place, event_id, ts < TIMESTAMP '2024-01-15 11:50:00' AS stale FROM events WHERE event_type IN ('signup', 'error', 'click') QUALIFY place <= 3""",
        "a_panels": """WITH k AS (SELECT event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY event_type)
SELECT count(*) AS n_kinds, (ceil(max(n) / 5) * 5)::BIGINT AS chart_max, max(CASE WHEN event_type = 'purchase' THEN last_id END) AS last_purchase FROM k""",
        "a_selected": "SELECT feedback_row_id, status FROM feedback WHERE status IN ('pending', 'reviewing') AND rating = 'down'",
        "l_alpaca": """SELECT case_row_id, md5(to_json({'instruction': query, 'input': '', 'output': full_answer})::VARCHAR) AS record_md5 FROM phase5_7_cases_results WHERE is_fully_grounded AND trim(full_answer) <> '' AND query IS NOT NULL""",
        "l_replaced": """WITH x AS (SELECT chunk_id, evidence_row_id, content, count(*) OVER (PARTITION BY chunk_id) AS n_rows FROM scored_evidence QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY index_version DESC NULLS LAST, evidence_row_id DESC) = 1)
SELECT chunk_id, evidence_row_id, n_rows FROM x WHERE coalesce(trim(content), '') <> ''""",
        "g_chunk_edges": f"WITH {mentions} SELECT mn.key AS src, e.evidence_row_id AS dst FROM mn JOIN scored_evidence e ON e.document_no = mn.document_no AND trim(e.article_number) = mn.article WHERE mn.key <> e.evidence_row_id",
        "g_article_step": f"""WITH {bm}, {mentions}, k AS (SELECT query, key, score FROM bmr WHERE rank <= 8), rc AS (SELECT query, document_no, article, max(score) AS score FROM k JOIN mn USING (key) GROUP BY ALL),
own AS (SELECT DISTINCT query, document_no, trim(article_number) AS article FROM k JOIN scored_evidence ON evidence_row_id = key)
SELECT query, document_no, article, round(score::DOUBLE * 0.9::DOUBLE, 6) AS score FROM rc WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.query = rc.query AND own.document_no = rc.document_no AND own.article = rc.article)""",
        "g_violations": " UNION ALL ".join([unique("chunk", "chunk_id", "scored_evidence"), unique("document", "doc_id", "legal_documents"), unique("number", "document_no", "legal_documents")]),
        "g_context": """WITH c AS (SELECT document_no, row_number() OVER (PARTITION BY document_no ORDER BY evidence_row_id) AS n, '- Điều ' || trim(article_number) || ': ' || substring(content, 1, 150) AS line FROM scored_evidence WHERE content <> '' QUALIFY n <= 3),
l AS (SELECT document_no, string_agg(line, chr(10) ORDER BY n) AS s, count(line) AS k FROM c GROUP BY document_no)
SELECT DISTINCT d.document_no, md5(coalesce(s, '')) AS context_md5, coalesce(k, 0)::INT AS n_lines FROM legal_documents d LEFT JOIN l ON l.document_no = d.document_no""",
        "u_articles": """WITH c AS (SELECT unnest(cited_chunk_ids) AS c FROM phase5_7_cases_results) SELECT regexp_extract(c, '^([A-Z0-9_]+)#d(\\d+)', 1) AS doc_id, regexp_extract(c, '^([A-Z0-9_]+)#d(\\d+)', 2)::INT AS article, count(*) AS n FROM c WHERE regexp_matches(c, '^[A-Z0-9_]+#d\\d+') GROUP BY ALL""",
        "u_relevance": """WITH e AS (SELECT document_no AS doc, try_cast(trim(article_number) AS INT) AS article, count(*) AS n FROM scored_evidence GROUP BY ALL)
SELECT row_id, coalesce(sum(n), 0)::BIGINT AS n_document, coalesce(sum(CASE WHEN article = expected_article THEN n END), 0)::BIGINT AS n_article,
 coalesce(sum(CASE WHEN article = expected_article OR (expected_article = 1 AND article IS NULL) THEN n END), 0)::BIGINT AS n_with_preamble FROM phase5b_eval_dataset q LEFT JOIN e ON e.doc = q.expected_doc_id WHERE expected_doc_id IS NOT NULL GROUP BY row_id""",
        "u_suite": """WITH c AS (SELECT *, coalesce(trim(full_answer) <> '', false) AS gave FROM phase5_7_cases_results) SELECT count(*) AS n, count_if(gave)::BIGINT AS n_answers, round(avg(retrieval_latency_ms), 6) AS retrieval_ms,
 round(avg(llm_latency_ms) FILTER (gave), 6) AS answer_ms, round(avg(coalesce(is_fully_grounded, false)::INT::DOUBLE) FILTER (gave), 6) AS grounded, sum(coalesce(len(rejected_chunk_ids), 0))::BIGINT AS n_rejected FROM c""",
        "u_terminal": f"""SELECT turn_row_id, CASE WHEN {norm} = '' THEN 'empty' WHEN user_query IS NOT NULL AND trim({greet}) = '' THEN 'small talk' WHEN NOT {has('user_query', LABOUR)} AND {has('user_query', OUTSIDE)} THEN 'out of scope' ELSE 'retrieve' END AS result FROM turns""",
        "u_pointer": """WITH e AS (SELECT index_version, count(*) AS n, round(avg(coalesce(trim(content) <> '', false)::INT::DOUBLE), 6) AS filled FROM scored_evidence GROUP BY index_version)
SELECT index_version, n, filled, coalesce(index_version = (SELECT max(index_version) FROM e WHERE filled >= 0.9), false) AS active FROM e""",
        "u_skips": "SELECT doc_id, title FROM legal_documents l WHERE NOT EXISTS (SELECT 1 FROM scored_evidence e WHERE e.doc_id = l.doc_id)",
        "u_scenarios": """WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\n]+', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n\\s*', chr(10), 'g')) AS s FROM documents WHERE genre = 'forum' AND text IS NOT NULL)
SELECT doc_id, length(s)::INT AS n_chars, regexp_extract(s, '([^.?!\\n]*\\?)', 1) AS question FROM c""",
        "u_routes": """SELECT doc_id, CASE WHEN document_no LIKE '%NĐ-CP' THEN 'decrees' WHEN document_no LIKE '%/TT-%' THEN 'circulars' WHEN document_no LIKE '%/QH-%' THEN 'laws' WHEN document_no LIKE '%/QĐ-%' THEN 'decisions' ELSE 'unknown' END AS folder FROM legal_documents""",
        "u_valid": f"""SELECT feedback_row_id, coalesce(regexp_matches(owner_id, '^u\\d{{7}}$'), false) AS owner_ok, coalesce(length(id) > 3, false) AS id_ok, regexp_matches(string_split(trim(coalesce(comment, '')), ' ')[-1], '{MAIL}') AS ends_in_mail FROM feedback""",
        "u_sections": """WITH s AS (SELECT turn_row_id, coalesce(rule_type, 'OTHER') AS rt, '## ' || coalesce(rule_type, 'OTHER') || chr(10) || string_agg(substring(content, 1, 80), chr(10) ORDER BY evidence_row_id) AS s FROM scored_evidence WHERE content <> '' GROUP BY turn_row_id, rule_type)
SELECT turn_row_id, count(*)::INT AS n_sections, md5(string_agg(s, chr(10) || chr(10) ORDER BY rt)) AS text_md5 FROM s GROUP BY turn_row_id""",
    }
