"""Queries over conversations, datasets, time and the star schema (H, L, categories of 2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as t
from verdigris.operators import datasets as ds
from verdigris.operators import history as h
from verdigris.operators import timeline as tl
from verdigris.sources.tables import table

ORDER = ["turn_no", "turn_row_id"]
SYSTEM = "Bạn là trợ lý pháp luật lao động."


def h_memory(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "turns", "turn_row_id", "conv_id", "turn_no")
    return turns.select("turn_row_id", F.array_join(h.memory(turns, "conv_id", ORDER, F.col("turn_row_id").cast("string")), ",").alias("remembered"))


def h_facts(spark: SparkSession, d: str) -> DataFrame:
    return h.last_facts(table(spark, d, "turns"), "conv_id", "facts", ORDER)


def h_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next of its conversation, and the minutes between."""
    f = h.followed(table(spark, d, "turns"), "conv_id", ORDER, {"turn_row_id": "next_turn", "created_at": "next_at"})
    return f.select("turn_row_id", "next_turn", F.floor((F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 60_000_000).alias("minutes"))


def h_followups(spark: SparkSession, d: str) -> DataFrame:
    """Short questions after the first turn that lean on what came before."""
    q = t.normalize_query(F.col("user_query"))
    words = F.size(F.split(q, " "))
    lead = F.lower(q).rlike("^(vậy|thế|còn|nếu vậy|em|what about|and)([ ,]|$)")
    return table(spark, d, "turns").select("turn_row_id", ((F.col("turn_no") > 1) & ((words <= 8) | (lead & (words <= 40)))).alias("is_followup"))


def h_cache(spark: SparkSession, d: str) -> DataFrame:
    c = h.cache_hits(table(spark, d, "turns"), t.search_key(F.col("user_query")), "created_at", ["created_at", "turn_row_id"])
    return c.select("turn_row_id", "cache_key", "hit")


def h_cache_kept(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "turns").withColumn("cache_key", F.sha2(t.search_key(F.col("user_query")), 256))
    return h.kept_in_cache(keyed, "cache_key", "created_at")


def h_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Cases as of two dates: which came, went or changed."""
    c = table(spark, d, "phase5_7_cases_results")
    columns = ["strategy", "retrieval_method", "is_fully_grounded", "run_at"]
    pick = lambda df: df.groupBy("case_id").agg(F.max_by(F.struct(*columns), F.struct("run_at", "case_row_id")).alias("r")).select("case_id", "r.*")
    return h.snapshot_diff(pick(c.where("run_at < TIMESTAMP '2031-07-01'")), pick(c), "case_id", columns)


def h_export(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as one text, in the order of its turns; its digest and length."""
    line = F.concat(F.lit("## "), F.coalesce("user_query", F.lit("")), F.lit("\n"), F.coalesce("assistant_response", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn_no", "turn_row_id", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")
    return table(spark, d, "turns").groupBy("conv_id").agg(F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


def l_chat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "phase5_7_cases_results").where("full_answer IS NOT NULL")
    return c.select("case_row_id", F.md5(ds.chat_record(F.col("query"), F.col("full_answer"), SYSTEM, F.col("expected_topic"))).alias("record_md5"))


def l_split(spark: SparkSession, d: str) -> DataFrame:
    return ds.split(table(spark, d, "phase5b_eval_dataset", "row_id", "question_id"), "question_id").select("row_id", "split")


def l_split_exact(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the questions, at least 80, at most a fifth, are for validation."""
    return ds.split_exact(table(spark, d, "phase5b_eval_dataset", "row_id", "question_id"), "question_id").select("row_id", "split")


def l_merge(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "phase5b_eval_dataset", "row_id", "question_id")
    return ds.merged(q.where("row_id % 3 <> 0"), q.where("row_id % 3 = 0"), "question_id")


def l_sub_questions(spark: SparkSession, d: str) -> DataFrame:
    return ds.sub_questions(table(spark, d, "turns", "turn_row_id", "user_query"), "turn_row_id", "user_query")


def l_patched(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose expected document comes from a newer delivery."""
    q = table(spark, d, "phase5b_eval_dataset")
    newest = q.groupBy("question_id").agg(F.max_by("expected_doc_id", F.struct("loaded_at", "row_id")).alias("expected_doc_id"), F.max_by("expected_article", F.struct("loaded_at", "row_id")).alias("expected_article"))
    return ds.patched(q.select("row_id", "question_id", "expected_doc_id", "expected_article"), newest, "question_id", ["expected_doc_id", "expected_article"])


def l_errors(spark: SparkSession, d: str) -> DataFrame:
    """Chat records of all turns, checked."""
    said = F.coalesce("assistant_response", F.lit(""))
    record = F.when(F.col("turn_row_id") % 97 == 0, F.lit("{broken")).otherwise(ds.chat_record(F.col("user_query"), said, SYSTEM))
    return table(spark, d, "turns").select("turn_row_id", F.array_join(ds.chat_errors(record), ",").alias("errors")).where("errors <> ''")


def l_titles(spark: SparkSession, d: str) -> DataFrame:
    """One title per document, the last delivered."""
    e = table(spark, d, "scored_evidence")
    return e.groupBy("doc_id").agg(F.max_by("document_title", F.struct("ingested_at", "evidence_row_id")).alias("title"), F.count_distinct("document_title").alias("n_titles"))


def x_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return tl.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"], "value")


def x_sliding(spark: SparkSession, d: str) -> DataFrame:
    return tl.tumbling(table(spark, d, "events"), "ts", "2 days", [], "value", "1 day")


def x_sessions(spark: SparkSession, d: str) -> DataFrame:
    return tl.sessions(table(spark, d, "events"), "ts", 120, "user_id")


def x_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the value of the user's last view."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = tl.as_of(left, e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", "event_id")
    return out.select("event_id", F.col("as_of").alias("last_view_value"))


def x_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region and year of ship date: a chain of equi-joins, then a roll-up."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return joined.rollup("r_name", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.sum(money).cast("decimal(28,4)").alias("revenue"))


def x_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a late line, by priority: a semi-join."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    late = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag").where("l_returnflag = 'R'")
    return o.join(late, o.o_orderkey == late.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def x_idle_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a balance and no urgent orders, by segment: an anti-join."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return c.where("c_acctbal > 0").join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(28,2)").alias("balance"))


def x_top_parts(spark: SparkSession, d: str) -> DataFrame:
    """The three best-selling parts of every brand, a top-k report."""
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity")
    p = table(spark, d, "part", "p_partkey", "p_brand")
    sold = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity"))
    ranked = sold.join(p, sold.l_partkey == p.p_partkey).withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("quantity"), "l_partkey")))
    return ranked.where("place <= 3").select("p_brand", "place", "l_partkey", "quantity")


def x_sets(spark: SparkSession, d: str) -> DataFrame:
    """Users who bought and clicked, and users who viewed but never bought."""
    e = table(spark, d, "events", "user_id", "event_type")
    of = lambda k: e.where(F.col("event_type") == k).select("user_id")
    both = of("purchase").intersect(of("click")).withColumn("kind", F.lit("bought_and_clicked"))
    never = of("view").subtract(of("purchase")).withColumn("kind", F.lit("viewed_only"))
    return both.unionByName(never).groupBy("kind").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"))


def x_pricing(spark: SparkSession, d: str) -> DataFrame:
    """The pricing summary: one pass, conditional and plain aggregates."""
    li = table(spark, d, "lineitem")
    dec = lambda c: c.cast("decimal(18,4)")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(dec(F.col("l_quantity"))).cast("decimal(28,4)").alias("sum_qty"),
        F.sum(dec(price)).cast("decimal(28,4)").alias("sum_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] in ("h_", "l_", "x_") and callable(f)}


def oracle_sql() -> dict:
    key = f"trim(regexp_replace({t.sql_fold('user_query')}, '[^a-z0-9]+', ' ', 'g'))"
    q = t.sql_normalize_query("user_query")
    last = "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY run_at DESC, case_row_id DESC) = 1"
    return {
        "h_memory": "SELECT turn_row_id, array_to_string(list(turn_row_id) OVER (PARTITION BY conv_id ORDER BY turn_no, turn_row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS remembered FROM turns",
        "h_facts": """WITH e AS (SELECT conv_id, turn_no, turn_row_id, unnest(map_entries(facts)) AS f FROM turns)
SELECT conv_id, f.key AS fact, f.value AS value FROM e WHERE f.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, f.key ORDER BY turn_no DESC, turn_row_id DESC) = 1""",
        "h_pairs": """SELECT turn_row_id, lead(turn_row_id) OVER w AS next_turn, floor((epoch_us(lead(created_at) OVER w) - epoch_us(created_at)) / 60000000)::BIGINT AS minutes FROM turns
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no, turn_row_id)""",
        "h_followups": f"""WITH x AS (SELECT turn_row_id, turn_no, {q} AS q FROM turns)
SELECT turn_row_id, turn_no > 1 AND (len(string_split(q, ' ')) <= 8 OR regexp_matches(lower(q), '^(vậy|thế|còn|nếu vậy|em|what about|and)([ ,]|$)') AND len(string_split(q, ' ')) <= 40) AS is_followup FROM x""",
        "h_cache": f"""WITH RECURSIVE x AS (SELECT turn_row_id, created_at, sha256({key}) AS cache_key, row_number() OVER (PARTITION BY sha256({key}) ORDER BY created_at, turn_row_id) AS rn FROM turns WHERE created_at IS NOT NULL),
s AS (SELECT turn_row_id, cache_key, rn, created_at AS stored, false AS hit FROM x WHERE rn = 1
 UNION ALL SELECT x.turn_row_id, x.cache_key, x.rn, CASE WHEN x.created_at - s.stored <= INTERVAL 6 HOUR THEN s.stored ELSE x.created_at END, x.created_at - s.stored <= INTERVAL 6 HOUR FROM s JOIN x ON x.cache_key = s.cache_key AND x.rn = s.rn + 1)
SELECT turn_row_id, cache_key, hit FROM s UNION ALL SELECT turn_row_id, sha256({key}), false FROM turns WHERE created_at IS NULL""",
        "h_cache_kept": f"SELECT sha256({key}) AS cache_key, max(created_at) AS last_used, count(*) AS n_uses FROM turns GROUP BY 1 ORDER BY last_used DESC, cache_key LIMIT 256",
        "h_snapshots": f"""WITH o AS (SELECT * FROM phase5_7_cases_results WHERE run_at < TIMESTAMP '2031-07-01' {last}), n AS (SELECT * FROM phase5_7_cases_results {last})
SELECT coalesce(o.case_id, n.case_id) AS case_id, CASE WHEN o.case_id IS NULL THEN 'added' WHEN n.case_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.case_id = n.case_id
 WHERE (o.strategy, o.retrieval_method, o.is_fully_grounded, o.run_at) IS DISTINCT FROM (n.strategy, n.retrieval_method, n.is_fully_grounded, n.run_at)""",
        "h_export": """WITH x AS (SELECT conv_id, string_agg('## ' || coalesce(user_query, '') || chr(10) || coalesce(assistant_response, ''), chr(10) || chr(10) ORDER BY turn_no, turn_row_id) AS text FROM turns GROUP BY conv_id)
SELECT conv_id, md5(text) AS text_md5, length(text)::INT AS n_chars FROM x""",
        "l_chat": f"""WITH x AS (SELECT case_row_id, query, CASE WHEN expected_topic IS NOT NULL AND NOT contains(full_answer, expected_topic) THEN full_answer || chr(10) || chr(10) || 'Nguồn: ' || expected_topic ELSE full_answer END AS said FROM phase5_7_cases_results WHERE full_answer IS NOT NULL)
SELECT case_row_id, md5(to_json({{'messages': [{{'role': 'system', 'content': '{SYSTEM}'}}, {{'role': 'user', 'content': query}}, {{'role': 'assistant', 'content': said}}]}})::VARCHAR) AS record_md5 FROM x""",
        "l_split": """SELECT row_id, CASE WHEN ('0x' || substr(md5(question_id || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM phase5b_eval_dataset""",
        "l_split_exact": """WITH k AS (SELECT DISTINCT question_id, ('0x' || substr(md5(question_id || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS share FROM phase5b_eval_dataset WHERE question_id IS NOT NULL),
n AS (SELECT least(greatest(80, floor(count(*) * 0.1)), floor(count(*) / 5)) AS n FROM k), v AS (SELECT question_id FROM k QUALIFY row_number() OVER (ORDER BY share, question_id) <= (SELECT n FROM n))
SELECT row_id, CASE WHEN question_id IN (SELECT question_id FROM v) THEN 'val' ELSE 'train' END AS split FROM phase5b_eval_dataset""",
        "l_merge": """SELECT row_id, question_id FROM phase5b_eval_dataset WHERE row_id % 3 <> 0 OR question_id NOT IN (SELECT question_id FROM phase5b_eval_dataset WHERE row_id % 3 <> 0)""",
        "l_sub_questions": """WITH x AS (SELECT turn_row_id, trim(user_query, ' ') AS q, list_filter(list_transform(regexp_split_to_array(user_query, '[?\\n]'), lambda p: trim(p, ' ')), lambda p: length(p) >= 20) AS p FROM turns WHERE user_query IS NOT NULL),
y AS (SELECT turn_row_id, list_concat([q], CASE WHEN len(p) > 1 THEN p ELSE [] END) AS a FROM x) SELECT turn_row_id, generate_subscripts(a, 1)::INT - 1 AS part_no, unnest(a) AS part FROM y""",
        "l_patched": """WITH n AS (SELECT question_id, expected_doc_id AS nd, expected_article AS na FROM phase5b_eval_dataset QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY loaded_at DESC, row_id DESC) = 1)
SELECT row_id, question_id, coalesce(nd, expected_doc_id) AS expected_doc_id, coalesce(na, expected_article) AS expected_article FROM phase5b_eval_dataset JOIN n USING (question_id)""",
        "l_errors": """SELECT turn_row_id, CASE WHEN turn_row_id % 97 = 0 THEN 'unreadable' ELSE 'empty_content' END AS errors FROM turns
 WHERE turn_row_id % 97 = 0 OR trim(coalesce(assistant_response, '')) = '' OR coalesce(trim(user_query) = '', true)""",
        "l_titles": "SELECT doc_id, arg_max(document_title, row(ingested_at, evidence_row_id)) AS title, count(DISTINCT document_title) AS n_titles FROM scored_evidence GROUP BY doc_id",
        "x_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "x_sessions": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 120 MINUTE, true)::INT AS is_new FROM events),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, sid""",
        "x_as_of": """SELECT p.event_id, v.value AS last_view_value FROM (FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
        "x_revenue": """SELECT r_name, year(l_shipdate)::INT AS year, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DECIMAL(28,4) AS revenue
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, year(l_shipdate))""",
        "x_priorities": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1",
        "x_idle_customers": """SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DECIMAL(28,2) AS balance FROM customer
 WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1""",
        "x_top_parts": """WITH s AS (SELECT l_partkey, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,2) AS quantity FROM lineitem GROUP BY 1)
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY quantity DESC, l_partkey)::INT AS place, l_partkey, quantity FROM s JOIN part ON p_partkey = l_partkey QUALIFY place <= 3""",
        "x_sets": """WITH b AS (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'click'),
v AS (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'),
u AS (SELECT user_id, 'bought_and_clicked' AS kind FROM b UNION ALL SELECT user_id, 'viewed_only' FROM v) SELECT kind, count(*) AS n, min(user_id) AS first_user FROM u GROUP BY kind""",
        "x_pricing": """SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DECIMAL(28,4) AS sum_qty, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DECIMAL(28,4) AS sum_price,
 round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
        "x_sliding": """WITH x AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, value FROM events)
SELECT start::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1""",
    }
