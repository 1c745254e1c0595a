"""Queries over the index and the rankings (X, R, M1-M9).

The chunks are all evidence rows; the stated query set is every evaluation
question whose row id is divisible by 50, ranked against all rows. The rankings
with a dense arm take all questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import encode
from verdigris.functions import text as t
from verdigris.operators import index, metrics, retrieve
from verdigris.sources.tables import table

META = ["article_number", "source_role", "rule_type"]
# A document's number in a question, its year or its kind given; dates aren't numbers.
DOCUMENT = r"(?iu)(?<![\d/])(\d{1,4}/(?:\d{4}(?:/[0-9A-ZĐ]+(?:-[A-ZĐ]+)*)?|[A-ZĐ]+(?:-[A-ZĐ]+)*))"
HISTORICAL = ["trước đây", "hết hiệu lực", "cũ", "formerly"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_evidence")


#: Every so many questions are a query of the stated set.
EVERY = 50


def questions(spark: SparkSession, d: str, every: int = EVERY) -> DataFrame:
    q = table(spark, d, "phase5b_eval_dataset").where(F.col("row_id") % every == 0)
    return q.select(F.col("row_id").alias("query"), F.col("question").alias("text"))


def _index(spark, d):
    return index.Index(chunks(spark, d), "evidence_row_id", "content")


def _bm25(spark, d, k=10, every=EVERY):
    return retrieve.bm25(questions(spark, d, every), _index(spark, d), k)


def _dense(spark, d, k=10, every=EVERY):
    """The ranking by cosine of hashed token vectors; scores from 0 to 1."""
    near = retrieve.cosine_of_counts(encode.packed(questions(spark, d, every), "query", "text"), encode.packed(chunks(spark, d), "evidence_row_id", "content"), k)
    return near.withColumn("score", F.greatest("score", F.lit(0.0)))


def _both(spark, d, k=10):
    """Both rankings from one index."""
    made, q = _index(spark, d), questions(spark, d)
    return retrieve.bm25(q, made, k), retrieve.overlap(q, made, k)


def _depth(k):
    """Candidates of each arm of a fused ranking of k."""
    return max(4 * k, 20)


def _fused(spark, d, k=10):
    return retrieve.fuse(*_both(spark, d, _depth(k)), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query", F.col("key").alias("evidence_row_id"), "rank", "score")


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.overlap(questions(spark, d), _index(spark, d)).select("query", F.col("key").alias("evidence_row_id"), "rank", "score")


def hybrid_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranking of every question."""
    made, q = _index(spark, d), questions(spark, d, 1)
    return retrieve.fuse(retrieve.bm25(q, made, _depth(10)), retrieve.overlap(q, made, _depth(10)), 10).select("query", "key", "rank", "score")


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query", F.col("key").alias("evidence_row_id"), "rank", "score", "rank_a", "rank_b")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit and reciprocal rank of the fused ranking, per question type and over all; one article is expected, so recall at k is the hit at k."""
    q = table(spark, d, "phase5b_eval_dataset").where(F.col("row_id") % 50 == 0)
    gold = q.select(F.col("row_id").alias("query"), "query_type", "expected_doc_id", "expected_article")
    hit = _fused(spark, d).join(chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "document_no", "article_number"), "key")
    relevant = metrics.relevant("document_no", "article_number", "expected_doc_id", "expected_article")
    ranked = hit.join(gold, "query").select("query", "rank", relevant.alias("relevant"))
    return metrics.by_type(metrics.per_query(gold, ranked, scorable=F.col("expected_doc_id").isNotNull()), "query_type")


def dense_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and the dense ranking of every question fused, as deep candidates as ``rrf_hybrid`` takes."""
    depth = _depth(10)
    fused = retrieve.fuse(_bm25(spark, d, depth, 1), _dense(spark, d, depth, 1), 10)
    return fused.select("query", F.col("key").alias("evidence_row_id"), "rank", "score", "rank_a", "rank_b")


def one_arm(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranking while the dense arm is out of reach: BM25 alone keeps its order."""
    fused = retrieve.fuse_available([_bm25(spark, d, _depth(10)), None], 10)
    return fused.select("query", F.col("key").alias("evidence_row_id"), "rank", "score")


def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    """``retrieval_metrics`` of the ranking with the dense arm, over every question."""
    q = table(spark, d, "phase5b_eval_dataset").where(F.col("row_id").isNotNull())
    gold = q.select(F.col("row_id").alias("query"), "query_type", "expected_doc_id", "expected_article")
    hit = dense_hybrid(spark, d).join(chunks(spark, d).select("evidence_row_id", "document_no", "article_number"), "evidence_row_id")
    relevant = metrics.relevant("document_no", "article_number", "expected_doc_id", "expected_article")
    ranked = hit.join(gold, "query").select("query", "rank", relevant.alias("relevant"))
    return metrics.by_type(metrics.per_query(gold, ranked, scorable=F.col("expected_doc_id").isNotNull()), "query_type")


def case_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of what a case cites, the share that the BM25 ranking of its query holds at 5 and 10: chunks, and different articles."""
    c = table(spark, d, "phase5_7_cases_results").where(F.col("case_row_id") % EVERY == 0)
    gold = c.select(F.col("case_row_id").alias("query"), "retrieval_method", F.array_distinct(F.array_compact("cited_chunk_ids")).alias("gold")).where("size(gold) > 0")
    ranked = retrieve.bm25(c.select(F.col("case_row_id").alias("query"), F.col("query").alias("text")), _index(spark, d), 10)
    held = ranked.join(chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "chunk_id"), "key").select("query", "rank", "chunk_id")
    return metrics.recall_by(gold, held, "retrieval_method")


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of the fused top 50, chunks of the document a question names come first, in their old order; 10 are kept."""
    named = questions(spark, d).select("query", F.lower(F.regexp_extract("text", DOCUMENT, 1)).alias("named"))
    facts = chunks(spark, d).select(F.col("evidence_row_id").alias("key"), F.lower("document_no").alias("document"))
    ranked = _fused(spark, d, 50).join(facts, "key").join(named, "query")
    bucket = F.when((F.col("named") != "") & F.col("document").startswith(F.col("named")), 0).otherwise(1)
    return retrieve.reorder(ranked, bucket, 10).select("query", F.col("key").alias("evidence_row_id"), "rank", "new_rank")


def three_ways(spark: SparkSession, d: str) -> DataFrame:
    """Framework law first, then guidance, penalties last with the newer index generation before the older."""
    facts = chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "source_role", "index_version")
    ranked = _bm25(spark, d, 50).join(facts, "key")
    bucket = F.when(F.col("source_role") == "FRAMEWORK_LAW", 0).when(F.col("source_role") == "PENALTY", 2).otherwise(1)
    newer = F.when(F.col("source_role") == "PENALTY", -F.col("index_version")).otherwise(0)
    out = retrieve.reorder(ranked.withColumn("bucket", bucket), F.struct("bucket", newer), 10)
    return out.select("query", F.col("key").alias("evidence_row_id"), "bucket", "rank", "new_rank")


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours among the vectors of one label only."""
    v = table(spark, d, "embeddings")
    q = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = retrieve.cosine_top_k(q, v.where("label = 3").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), 5)
    return near.select("query", F.col("key").alias("vec_id"), "rank", F.round("score", 4).alias("cosine"))


def index_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether an index of each generation still holds for the newest one."""
    latest = index.latest(chunks(spark, d), ["chunk_id", "index_version"], ["ingested_at", "evidence_row_id"])
    of = lambda v: latest.where(F.col("index_version") == v)
    return reduce(DataFrame.unionByName, [index.validity(of(v), of(4), "chunk_id", "content").withColumn("index_version", F.lit(v)) for v in (1, 2, 3, 4)])


def index_applied(spark: SparkSession, d: str) -> DataFrame:
    """Generation 1 brought to generation 2 by its changes: rows that come out, and whether they had to be made anew."""
    latest = index.latest(chunks(spark, d), ["chunk_id", "index_version"], ["ingested_at", "evidence_row_id"])
    of = lambda v: latest.where(F.col("index_version") == v)
    return index.apply_changes(of(1), of(2), "chunk_id", "content", META).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), *META, "kept")


def demoted(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of repealed documents go down, unless the question asks about the past."""
    registry = table(spark, d, "legal_documents").groupBy("doc_id").agg(F.max(F.col("validity") == "REPEALED").alias("repealed"))
    facts = chunks(spark, d).select(F.col("evidence_row_id").alias("key"), "doc_id").join(registry, "doc_id", "left").select("key", "repealed")
    asks = questions(spark, d).select("query", t.contains_any(F.col("text"), HISTORICAL).alias("historical"))
    ranked = _bm25(spark, d).join(facts, "key").join(asks, "query")
    out = retrieve.demote(ranked, F.coalesce("repealed", F.lit(False)) & ~F.col("historical"))
    return out.select("query", F.col("key").alias("evidence_row_id"), "rank", "new_rank", "new_score")


def exact_reference(spark: SparkSession, d: str) -> DataFrame:
    """Of the BM25 top 50, chunks of the article and document a question names come first, then of the article, then the rest, in their old order; 10 are kept."""
    article, document = F.regexp_extract(F.lower("text"), r"điều\s+(\d+)", 1), F.lower(F.regexp_extract("text", DOCUMENT, 1))
    named = questions(spark, d).select("query", article.alias("named"), document.alias("named_document"))
    facts = chunks(spark, d).select(F.col("evidence_row_id").alias("key"), F.trim("article_number").alias("article"), F.lower("document_no").alias("document"))
    ranked = _bm25(spark, d, 50).join(facts, "key").join(named, "query")
    of_article = (F.col("named") != "") & (F.col("article") == F.col("named"))
    of_document = (F.col("named_document") != "") & F.col("document").startswith(F.col("named_document"))
    bucket = F.when(of_article & of_document, 0).when(of_article, 1).otherwise(2)
    return retrieve.reorder(ranked, bucket, 10).select("query", F.col("key").alias("evidence_row_id"), "rank", "new_rank")


def first_seen_union(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of several methods as one list, each chunk where it came first."""
    first, second = _both(spark, d)
    both = first.select("query", "key", "rank", F.lit(1).alias("arm")).unionByName(second.select("query", "key", "rank", F.lit(2).alias("arm")))
    return retrieve.first_seen(both, "query", "arm").select("query", F.col("key").alias("evidence_row_id"), "arm", "rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest neighbours of every vector whose id is divisible by 50, itself included."""
    v = table(spark, d, "embeddings")
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    near = retrieve.cosine_top_k(q, v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")))
    return near.select("query", F.col("key").alias("vec_id"), "rank", F.round("score", 4).alias("cosine"))


def dense_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of neighbours with the query's label."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    near = dense_topk(spark, d).where("vec_id <> query")
    joined = near.join(v, "vec_id").join(v.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")), "query")
    return joined.groupBy("query_label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("same_label"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = index.corpus_statistics(chunks(spark, d), "content")
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    made = _index(spark, d)
    df, n = made.term_statistics(), F.lit(made.n)
    return df.select("term", "df", F.round(F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def chunk_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return index.fingerprint(chunks(spark, d), "evidence_row_id", ["chunk_id", "doc_id", "content", "index_version"])


def generation_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between index generations 1 and 2, by kind."""
    latest = index.latest(chunks(spark, d), ["chunk_id", "index_version"], ["ingested_at", "evidence_row_id"])
    of = lambda v: latest.where(F.col("index_version") == v)
    return index.changes(of(1), of(2), "chunk_id", "content", META).groupBy("change").agg(F.count("*").alias("n"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the registry with and without chunks, and chunks without a document."""
    registry = table(spark, d, "legal_documents").select("doc_id").distinct().withColumn("listed", F.lit(True))
    have = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return have.join(registry, "doc_id", "full_outer").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("listed", F.lit(False)).alias("listed"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that one generation holds more than once."""
    n = chunks(spark, d).groupBy("chunk_id", "index_version").agg(F.count("*").alias("n"), F.count_distinct("content").alias("n_contents"))
    return n.where("n > 1")


def parent_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Each point with the newest text of the clause it belongs to."""
    c = chunks(spark, d).withColumn("point", F.nullif("point", F.lit("")))
    keys = ["doc_id", "article_number", "clause_number"]
    clause = c.where("point IS NULL AND clause_number IS NOT NULL").groupBy(*keys).agg(F.max_by("evidence_row_id", F.struct("index_version", "evidence_row_id")).alias("parent_row_id"))
    return c.where("point IS NOT NULL").join(clause, keys, "left").select("evidence_row_id", "parent_row_id")


def near_questions(spark: SparkSession, d: str) -> DataFrame:
    """The stored question nearest to each stated one by edit ratio, with the margin to the next; every stored question is compared."""
    stored = table(spark, d, "phase5b_eval_dataset").select(F.col("row_id").alias("key"), t.search_key(F.col("question")).alias("text"))
    scored = retrieve.nearest_texts(questions(spark, d).select("query", t.search_key(F.col("text")).alias("text")), stored)
    best = scored.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("key"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("ratio"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    margin = F.round(F.col("ratio") - F.coalesce("second", F.lit(0.0)), 6)
    reason = F.when(F.col("ratio") < 0.86, "too_far").when(margin < 0.05, "ambiguous").otherwise("accepted")
    return best.select("query", "best", "ratio", margin.alias("margin"), reason.alias("reason"))


def queries() -> dict:
    names = """bm25_topk overlap_topk rrf_hybrid retrieval_metrics demoted exact_reference first_seen_union dense_topk dense_accuracy corpus_stats
    dense_hybrid one_arm dense_metrics case_recall document_lookup three_ways dense_filtered index_validity index_applied
    term_idf chunk_fingerprints generation_changes coverage duplicate_keys parent_clauses near_questions""".split()
    return {name: globals()[name] for name in names}


def oracle_sql() -> dict:
    q = "q AS (SELECT row_id AS query, question AS text FROM phase5b_eval_dataset WHERE row_id % 50 = 0)"
    everyone = "q AS (SELECT row_id AS query, question AS text FROM phase5b_eval_dataset WHERE row_id IS NOT NULL)"
    bm = f"""{q}, w AS (SELECT evidence_row_id AS key, {t.sql_tokens('content')} AS ws FROM scored_evidence),
f AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS avgdl FROM w WHERE len(ws) > 0),
p AS (SELECT key, len(ws) AS dl, unnest(ws) AS term FROM w), tf AS (SELECT key, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({t.sql_tokens('text')}) AS term FROM q) GROUP BY ALL),
parts AS (SELECT query, key, qtf * round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 8)::DECIMAL(18,8) AS part
 FROM qt JOIN tf USING (term) JOIN df USING (term), f),
bm AS (SELECT query, key, sum(part)::DECIMAL(28,8) AS score FROM parts GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM bm)"""
    ov = f"""qd AS (SELECT query, list_distinct({t.sql_tokens('text')}) AS words FROM q),
cd AS (SELECT evidence_row_id AS key, unnest(list_distinct({t.sql_tokens('content')})) AS term FROM scored_evidence),
qx AS (SELECT query, len(words) AS nw, unnest(words) AS term FROM qd),
ov AS (SELECT query, key, round(count(*) / any_value(nw), 6) AS score FROM qx JOIN cd USING (term) GROUP BY query, key),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM ov)"""
    def fused(second: str, k: int) -> str:
        """Reciprocal ranks of the BM25 ranking and another, each with four candidates for every rank of the result, 20 at least."""
        depth = max(4 * k, 20)
        return f"""fu AS (SELECT query, key, a.rank AS rank_a, b.rank AS rank_b,
 round(coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0), 10) AS score
 FROM (FROM bmr WHERE rank <= {depth}) a FULL JOIN (FROM {second} WHERE rank <= {depth}) b USING (query, key)),
fur AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank_a NULLS LAST, rank_b NULLS LAST, key)::INT AS rank FROM fu)"""

    fu = f"{bm}, {ov}, {fused('ovr', 10)}"
    hashed = lambda name, key, text, source: f"""{name}h AS (SELECT key, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM (SELECT {key} AS key, unnest({t.sql_tokens(text)}) AS term FROM {source})),
{name}s AS (SELECT key, h % 64 AS j, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v FROM {name}h GROUP BY ALL),
{name}n AS (SELECT key, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}s GROUP BY key HAVING sum(v * v) > 0)"""  # noqa: E731
    de = f"""{hashed('qe', 'query', 'text', 'q')}, {hashed('ce', 'evidence_row_id', 'content', 'scored_evidence')},
dot AS (SELECT x.key AS query, y.key AS key, sum(x.v * y.v)::DOUBLE AS d FROM qes x JOIN ces y ON x.j = y.j GROUP BY ALL),
cos AS (SELECT qn.key AS query, cn.key AS key, greatest(round(coalesce(d, 0.0) / (qn.norm * cn.norm), 6), 0.0) AS score, round(coalesce(d, 0.0) / (qn.norm * cn.norm), 6) AS raw
 FROM qen qn CROSS JOIN cen cn LEFT JOIN dot ON dot.query = qn.key AND dot.key = cn.key),
der AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY raw DESC, key)::INT AS rank FROM cos)"""
    dfu = f"{bm.replace(q, everyone, 1)}, {de}, {fused('der', 10)}"
    document = "(?i)(?:^|[^0-9/])([0-9]{1,4}/(?:[0-9]{4}(?:/[0-9a-zđ]+(?:-[a-zđ]+)*)?|[a-zđ]+(?:-[a-zđ]+)*))"
    metric = lambda ranked, which="row_id % 50 = 0": f"""g AS (SELECT row_id AS query, query_type, expected_doc_id, expected_article FROM phase5b_eval_dataset WHERE {which}),
r AS (SELECT g.query, rank, coalesce(document_no = expected_doc_id AND (expected_article IS NULL OR try_cast(trim(article_number) AS INT) = expected_article), false) AS rel
 FROM {ranked} JOIN scored_evidence e ON e.evidence_row_id = {ranked}.key JOIN g ON g.query = {ranked}.query WHERE rank <= 10),
m AS (SELECT g.query, query_type, expected_doc_id IS NOT NULL AS scorable, min(CASE WHEN rel THEN rank END) AS first_rank FROM g LEFT JOIN r USING (query) GROUP BY ALL)
SELECT CASE WHEN grouping(query_type) = 1 THEN 'ALL' ELSE query_type END AS query_type, count(*) AS n, count_if(scorable)::BIGINT AS n_scorable,
 round(avg(CASE WHEN scorable THEN coalesce(first_rank <= 1, false)::INT::DOUBLE END), 6) AS hit_1, round(avg(CASE WHEN scorable THEN coalesce(first_rank <= 3, false)::INT::DOUBLE END), 6) AS hit_3,
 round(avg(CASE WHEN scorable THEN coalesce(first_rank <= 5, false)::INT::DOUBLE END), 6) AS hit_5, round(avg(CASE WHEN scorable THEN coalesce(first_rank <= 10, false)::INT::DOUBLE END), 6) AS hit_10,
 round(avg(CASE WHEN scorable THEN coalesce(1.0::DOUBLE / first_rank, 0.0) END), 6) AS mrr FROM m GROUP BY GROUPING SETS ((query_type), ()) HAVING count(*) > 0"""  # noqa: E731
    sim = """dv AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM dv QUALIFY rank <= 10)"""
    latest = """l AS (SELECT * FROM scored_evidence QUALIFY row_number() OVER (PARTITION BY chunk_id, index_version ORDER BY ingested_at DESC NULLS LAST, evidence_row_id DESC) = 1)"""
    part = lambda c: f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    key = lambda c: f"trim(regexp_replace({t.sql_fold(c)}, '[^a-z0-9]+', ' ', 'g'))"
    hist = t.sql_contains_any("text", HISTORICAL)
    return {
        "bm25_topk": f"WITH {bm} SELECT query, key AS evidence_row_id, rank, score FROM bmr WHERE rank <= 10",
        "overlap_topk": f"WITH {q}, {ov} SELECT query, key AS evidence_row_id, rank, score FROM ovr WHERE rank <= 10",
        "rrf_hybrid": f"WITH {fu} SELECT query, key AS evidence_row_id, rank, score, rank_a, rank_b FROM fur WHERE rank <= 10",
        "retrieval_metrics": f"WITH {fu}, {metric('fur')}",
        "dense_metrics": f"WITH {dfu}, {metric('fur', 'row_id IS NOT NULL')}",
        "dense_hybrid": f"WITH {dfu} SELECT query, key AS evidence_row_id, rank, score, rank_a, rank_b FROM fur WHERE rank <= 10",
        "one_arm": f"WITH {bm} SELECT query, key AS evidence_row_id, rank, round(1.0::DOUBLE / (60 + rank), 10) AS score FROM bmr WHERE rank <= 10",
        "case_recall": f"""WITH c AS (SELECT case_row_id AS query, query AS text, retrieval_method, cited_chunk_ids FROM phase5_7_cases_results WHERE case_row_id % 50 = 0),
{bm.replace(q, "q AS (SELECT query, text FROM c)", 1)}, h AS (SELECT query, rank, chunk_id FROM bmr JOIN scored_evidence ON evidence_row_id = key WHERE rank <= 10),
g AS (SELECT DISTINCT query, retrieval_method, unnest(cited_chunk_ids) AS gold FROM c), gg AS (SELECT * FROM g WHERE gold IS NOT NULL),
ga AS (SELECT DISTINCT query, retrieval_method, regexp_extract(gold, '^[^#]+#d[0-9]+') AS gold FROM gg),
pc AS (SELECT gg.query, any_value(retrieval_method) AS retrieval_method, count(DISTINCT gold) AS n, count(DISTINCT CASE WHEN rank <= 5 THEN gold END) AS a5, count(DISTINCT CASE WHEN rank <= 10 THEN gold END) AS a10
 FROM gg LEFT JOIN h ON h.query = gg.query AND (chunk_id = gold OR starts_with(chunk_id, gold || '-')) GROUP BY gg.query),
pa AS (SELECT ga.query, count(DISTINCT gold) AS n, count(DISTINCT CASE WHEN rank <= 5 THEN gold END) AS a5, count(DISTINCT CASE WHEN rank <= 10 THEN gold END) AS a10
 FROM ga LEFT JOIN h ON h.query = ga.query AND regexp_extract(chunk_id, '^[^#]+#d[0-9]+') = gold AND gold <> '' GROUP BY ga.query)
SELECT retrieval_method, count(*) AS n, round(avg(pa.a5 / pa.n), 6) AS recall_5, round(avg(pa.a10 / pa.n), 6) AS recall_10, round(avg(pc.a5 / pc.n), 6) AS chunk_recall_5, round(avg(pc.a10 / pc.n), 6) AS chunk_recall_10
 FROM pc JOIN pa USING (query) GROUP BY retrieval_method""",
        "document_lookup": f"""WITH {bm}, {ov}, {fused('ovr', 50)}, x AS (SELECT fur.query, key, rank, CASE WHEN named <> '' AND starts_with(lower(document_no), named) THEN 0 ELSE 1 END AS bucket
 FROM fur JOIN scored_evidence e ON e.evidence_row_id = key JOIN (SELECT query, lower(regexp_extract(text, '{document}', 1)) AS named FROM q) n ON n.query = fur.query WHERE rank <= 50)
SELECT query, key AS evidence_row_id, rank, row_number() OVER (PARTITION BY query ORDER BY bucket, rank, key)::INT AS new_rank FROM x QUALIFY new_rank <= 10""",
        "three_ways": f"""WITH {bm}, x AS (SELECT query, key, rank, CASE source_role WHEN 'FRAMEWORK_LAW' THEN 0 WHEN 'PENALTY' THEN 2 ELSE 1 END AS bucket, CASE WHEN source_role = 'PENALTY' THEN -index_version ELSE 0 END AS newer
 FROM bmr JOIN scored_evidence e ON e.evidence_row_id = key WHERE rank <= 50)
SELECT query, key AS evidence_row_id, bucket, rank, row_number() OVER (PARTITION BY query ORDER BY bucket, newer NULLS FIRST, rank, key)::INT AS new_rank FROM x QUALIFY new_rank <= 10""",
        "dense_filtered": f"""WITH dv AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label = 3)
SELECT query, key AS vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank, round(score, 4) AS cosine FROM dv QUALIFY rank <= 5""",
        "index_validity": f"""WITH {latest}, f AS (SELECT index_version, count(*) AS n, list_sort(list(coalesce(chunk_id, '') || chr(1) || coalesce(content, chr(2)))) AS all_rows FROM l WHERE index_version IN (1, 2, 3, 4) GROUP BY index_version)
SELECT a.index_version::INT AS index_version, a.n AS n_old, b.n AS n_new, a.all_rows = b.all_rows AS is_valid FROM f a, f b WHERE b.index_version = 4""",
        "index_applied": f"""WITH {latest}, o AS (FROM l WHERE index_version = 1), n AS (FROM l WHERE index_version = 2)
SELECT n.chunk_id, md5(n.content) AS content_md5, n.article_number, n.source_role, n.rule_type,
 o.chunk_id IS NOT NULL AND o.content IS NOT DISTINCT FROM n.content AND (o.article_number, o.source_role, o.rule_type) IS NOT DISTINCT FROM (n.article_number, n.source_role, n.rule_type) AS kept
FROM n LEFT JOIN o ON o.chunk_id = n.chunk_id""",
        "demoted": f"""WITH {bm}, b AS (FROM bmr WHERE rank <= 10), x AS (SELECT b.query, key, rank,
 round(CASE WHEN coalesce(repealed, false) AND NOT {hist} THEN score::DOUBLE * 0.12::DOUBLE ELSE score::DOUBLE END, 8) AS new_score
 FROM b JOIN scored_evidence e ON e.evidence_row_id = key LEFT JOIN (SELECT doc_id, bool_or(validity = 'REPEALED') AS repealed FROM legal_documents GROUP BY doc_id) v USING (doc_id) JOIN q ON q.query = b.query)
SELECT query, key AS evidence_row_id, rank, row_number() OVER (PARTITION BY query ORDER BY new_score DESC, rank, key)::INT AS new_rank, new_score FROM x""",
        "exact_reference": f"""WITH {bm}, n AS (SELECT query, regexp_extract(lower(text), 'điều\\s+(\\d+)', 1) AS named, lower(regexp_extract(text, '{document}', 1)) AS document FROM q),
x AS (SELECT bmr.query, key, rank, CASE WHEN named <> '' AND trim(article_number) = named THEN CASE WHEN document <> '' AND starts_with(lower(document_no), document) THEN 0 ELSE 1 END ELSE 2 END AS bucket
 FROM bmr JOIN scored_evidence e ON e.evidence_row_id = key JOIN n ON n.query = bmr.query WHERE rank <= 50)
SELECT query, key AS evidence_row_id, rank, row_number() OVER (PARTITION BY query ORDER BY bucket, rank, key)::INT AS new_rank FROM x QUALIFY new_rank <= 10""",
        "first_seen_union": f"""WITH {bm}, {ov}, u AS (SELECT query, key, rank, 1 AS arm FROM bmr WHERE rank <= 10 UNION ALL SELECT query, key, rank, 2 FROM ovr WHERE rank <= 10)
SELECT query, key AS evidence_row_id, arm, rank FROM u QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY arm, rank) = 1""",
        "dense_topk": f"WITH {sim} SELECT query, key AS vec_id, rank, round(score, 4) AS cosine FROM dr",
        "dense_accuracy": f"""WITH {sim} SELECT b.label AS query_label, count(*) AS n, round(avg((a.label = b.label)::INT::DOUBLE), 6) AS same_label
 FROM dr JOIN embeddings a ON a.vec_id = key JOIN embeddings b ON b.vec_id = query WHERE key <> query GROUP BY b.label""",
        "corpus_stats": f"WITH w AS (SELECT len({t.sql_tokens('content')}) AS dl FROM scored_evidence) SELECT count(*) AS n, round(sum(dl) / count(*), 6) AS avgdl FROM w WHERE dl > 0",
        "term_idf": f"""WITH w AS (SELECT evidence_row_id, {t.sql_tokens('content')} AS ws FROM scored_evidence), n AS (SELECT count(*) AS n FROM w WHERE len(ws) > 0),
p AS (SELECT DISTINCT evidence_row_id, unnest(ws) AS term FROM w), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT term, df, round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d, n""",
        "chunk_fingerprints": f"SELECT evidence_row_id, sha256({' || '.join(part(c) for c in ('chunk_id', 'doc_id', 'content', 'index_version'))}) AS digest FROM scored_evidence",
        "generation_changes": f"""WITH {latest}, x AS (SELECT CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'removed' WHEN o.content IS DISTINCT FROM n.content THEN 'text'
 WHEN (o.article_number, o.source_role, o.rule_type) IS DISTINCT FROM (n.article_number, n.source_role, n.rule_type) THEN 'metadata' ELSE 'same' END AS change
 FROM (FROM l WHERE index_version = 1) o FULL JOIN (FROM l WHERE index_version = 2) n ON o.chunk_id = n.chunk_id) SELECT change, count(*) AS n FROM x GROUP BY change""",
        "coverage": """WITH h AS (SELECT doc_id, count(*) AS n FROM scored_evidence GROUP BY doc_id), r AS (SELECT DISTINCT doc_id FROM legal_documents)
SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, coalesce(n, 0) AS n_chunks, r.doc_id IS NOT NULL AS listed FROM h FULL JOIN r ON h.doc_id = r.doc_id""",
        "duplicate_keys": "SELECT chunk_id, index_version, count(*) AS n, count(DISTINCT content) AS n_contents FROM scored_evidence GROUP BY ALL HAVING count(*) > 1",
        "parent_clauses": """WITH c AS (SELECT *, nullif(point, '') AS pt FROM scored_evidence), p AS (SELECT doc_id, article_number, clause_number, evidence_row_id AS parent_row_id FROM c
 WHERE pt IS NULL AND clause_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, article_number, clause_number ORDER BY index_version DESC NULLS LAST, evidence_row_id DESC) = 1)
SELECT evidence_row_id, parent_row_id FROM c LEFT JOIN p USING (doc_id, article_number, clause_number) WHERE pt IS NOT NULL""",
        "near_questions": f"""WITH {q}, qd AS (SELECT query, {key('text')} AS text FROM q WHERE text IS NOT NULL), cd AS (SELECT row_id AS key, {key('question')} AS other FROM phase5b_eval_dataset WHERE question IS NOT NULL),
s AS (SELECT query, key, round(1 - levenshtein(text, other) / greatest(length(text), length(other), 1), 6) AS score FROM qd, cd WHERE key <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s),
b AS (SELECT query, max(CASE WHEN rank = 1 THEN key END) AS best, max(CASE WHEN rank = 1 THEN score END) AS ratio, max(CASE WHEN rank = 2 THEN score END) AS second FROM r WHERE rank <= 2 GROUP BY query)
SELECT query, best, ratio, round(ratio - coalesce(second, 0.0), 6) AS margin,
 CASE WHEN ratio < 0.86 THEN 'too_far' WHEN round(ratio - coalesce(second, 0.0), 6) < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS reason FROM b""",
    }
