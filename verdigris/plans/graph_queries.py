"""Queries over the reference graph (G, R12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import graph as g
from verdigris.plans.retrieval_queries import _bm25
from verdigris.sources.tables import table


def _edges(spark, d):
    return g.mined(table(spark, d, "scored_evidence"), "document_no", "content")


def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One node per document, its first row by id, with its integer articles."""
    e = table(spark, d, "scored_evidence")
    article = F.trim("article_number").try_cast("int")
    return e.groupBy("document_no").agg(F.min_by("document_title", "evidence_row_id").alias("title"), F.count_distinct(article).alias("n_articles"), F.count("*").alias("n_chunks"))


def g_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def g_known_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.known_only(_edges(spark, d), table(spark, d, "scored_evidence"), "document_no")


def g_degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(_edges(spark, d))


def g_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours, both ways, of every document of the registry."""
    seeds = table(spark, d, "legal_documents").select(F.col("document_no").alias("seed"))
    return g.step(seeds, _edges(spark, d), "both")


def g_branches(spark: SparkSession, d: str) -> DataFrame:
    """Decrees and circulars that name each document of the registry."""
    e = _edges(spark, d)
    decree, circular = F.col("src").like("%NĐ-CP"), F.col("src").like("%/TT-%")
    return g.two_branches(table(spark, d, "legal_documents"), "document_no", e.where(decree), e.where(circular))


def g_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Document, article and clause of every point, from columns."""
    e = table(spark, d, "scored_evidence").where("point <> ''")
    return e.select("evidence_row_id", F.concat_ws(" > ", "document_no", F.trim("article_number"), F.col("clause_number").cast("string"), "point").alias("lineage"))


def g_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the graph adds to each BM25 ranking."""
    members = table(spark, d, "scored_evidence").select(F.col("evidence_row_id").alias("key"), "document_no")
    ranked = _bm25(spark, d, 8).join(members, "key")
    return g.expand_ranking(ranked, "document_no", _edges(spark, d), members).withColumnRenamed("key", "evidence_row_id")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("g_")}


def oracle_sql() -> dict:
    from verdigris.plans import retrieval_queries as r

    edges = f"""x AS (SELECT document_no AS src, unnest(regexp_extract_all(coalesce(content, ''), '{g.NUMBER}', 1)) AS dst FROM scored_evidence),
edges AS (SELECT src, dst, count(*) AS n_mentions FROM x WHERE src IS NOT NULL AND src <> dst GROUP BY ALL)"""
    both = "both_ways AS (SELECT src AS seed, dst AS node FROM edges UNION SELECT dst, src FROM edges)"
    bm = r.oracle_sql()["bm25_topk"]
    bm = bm[len("WITH ") : bm.rindex(" SELECT query, key AS")]
    return {
        "g_nodes": """SELECT document_no, arg_min(document_title, evidence_row_id) AS title, count(DISTINCT try_cast(trim(article_number) AS INT)) AS n_articles, count(*) AS n_chunks
 FROM scored_evidence GROUP BY document_no""",
        "g_edges": f"WITH {edges} SELECT * FROM edges",
        "g_known_edges": f"WITH {edges} SELECT * FROM edges WHERE dst IN (SELECT document_no FROM scored_evidence)",
        "g_degrees": f"""WITH {edges}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM e GROUP BY node""",
        "g_neighbours": f"WITH {edges}, {both} SELECT DISTINCT seed, node FROM both_ways WHERE seed IN (SELECT document_no FROM legal_documents) AND seed <> node",
        "g_branches": f"""WITH {edges}, b AS (SELECT DISTINCT dst, 'guides' AS branch, src FROM edges WHERE src LIKE '%NĐ-CP' UNION ALL SELECT DISTINCT dst, 'penalties', src FROM edges WHERE src LIKE '%/TT-%')
SELECT document_no, branch, src, CASE WHEN src IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY document_no, branch) END AS n_branch FROM (SELECT DISTINCT document_no FROM legal_documents) l LEFT JOIN b ON b.dst = l.document_no""",
        "g_lineage": "SELECT evidence_row_id, concat_ws(' > ', document_no, trim(article_number), clause_number::VARCHAR, point) AS lineage FROM scored_evidence WHERE point <> ''",
        "g_expanded": f"""WITH {bm}, {edges}, {both}, rk AS (SELECT query, key, score, document_no FROM bmr JOIN scored_evidence ON evidence_row_id = key WHERE rank <= 8),
sd AS (SELECT query, document_no AS seed, max(score) AS seed_score FROM rk GROUP BY ALL),
re AS (SELECT query, node AS document_no, max(seed_score) AS seed_score FROM sd JOIN both_ways USING (seed) WHERE seed <> node GROUP BY ALL),
nw AS (SELECT re.query, e.evidence_row_id AS key, re.document_no, seed_score FROM re JOIN scored_evidence e USING (document_no) WHERE (re.query, e.evidence_row_id) NOT IN (SELECT (query, key) FROM rk)
 QUALIFY row_number() OVER (PARTITION BY re.query, re.document_no ORDER BY e.evidence_row_id) <= 3)
SELECT query, key AS evidence_row_id, document_no, row_number() OVER (PARTITION BY query ORDER BY seed_score DESC, document_no, key)::INT AS place, round(seed_score::DOUBLE * 0.9::DOUBLE, 6) AS score
 FROM nw QUALIFY place <= 6""",
    }
