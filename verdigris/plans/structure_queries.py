"""Queries over lines, chunks and scans (P, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import structure as s
from verdigris.sources.tables import table

NOISE = r"^(-?\s*\d{1,4}\s*-?|[-_=*]{3,}|Trang \d+.*)$"


def _lines(spark, d):
    return s.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def st_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(s.kind_of(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def st_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every clause and point with the headings it stands under."""
    c = s.carried(_lines(spark, d), "doc_id").where("kind IN ('clause', 'point')")
    return c.select("doc_id", "pos", "kind", "chapter", "section", "article", "clause", "point")


def st_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = s.chunks(_lines(spark, d), "doc_id")
    return c.select("doc_id", "chunk_no", "chunk_id", "kind", "first_pos", "last_pos", "n_lines", F.md5("text").alias("text_md5"))


def st_cleaned(spark: SparkSession, d: str) -> DataFrame:
    c = s.cleaned(_lines(spark, d), "doc_id", NOISE)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def st_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    return s.unwrapped(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def st_quality(spark: SparkSession, d: str) -> DataFrame:
    return s.quality(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def st_low_text(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose texts are so short on average that their scans should be read anew."""
    n = table(spark, d, "documents", "source", "text").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.length("text"), F.lit(0))), 4).alias("mean_chars"))
    return n.withColumn("route", F.when(F.col("mean_chars") < 120, "ocr").otherwise("text"))


def st_islands(spark: SparkSession, d: str) -> DataFrame:
    return s.islands(_lines(spark, d), "doc_id", r"^(Hỏi đáp về|Điều \d+\.|Chương \d+\.|Phần \d+:)")


def st_date_intervals(spark: SparkSession, d: str) -> DataFrame:
    return s.date_intervals(table(spark, d, "scored_evidence", "evidence_row_id", "content"), "evidence_row_id", "content")


def st_facts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, shares, days and months that a question states, each once."""
    families = {"amount": r"(\d[\d.,]*\s*(?:đồng|triệu|tỷ))", "share": r"(\d+(?:[.,]\d+)?\s*%)", "days": r"(\d+)\s+ngày", "months": r"(\d+)\s+tháng", "article": r"(điều\s+\d+)"}
    q = table(spark, d, "turns", "turn_row_id", "user_query").withColumn("q", F.lower("user_query"))

    def stated(family, pattern):
        values = F.regexp_extract_all("q", F.lit(pattern), F.lit(1))
        return F.transform(values, lambda x: F.struct(F.lit(family).alias("family"), x.alias("value")))

    found = F.array(*[stated(n, p) for n, p in families.items()])
    return q.select("turn_row_id", F.explode(F.array_distinct(F.flatten(found))).alias("f")).select("turn_row_id", "f.family", "f.value")


def st_dq(spark: SparkSession, d: str) -> DataFrame:
    """The corpus in one pass: empty, short, long, unnumbered, repeated."""
    e = table(spark, d, "scored_evidence")
    n = F.length("content")
    return e.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.trim("content") == "", F.lit(True))).alias("n_empty"),
        F.count_if(n.between(1, 14)).alias("n_short"),
        F.count_if(n > 1200).alias("n_long"),
        F.count_if(F.trim("article_number").try_cast("int").isNull()).alias("n_unnumbered"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("n_repeated"),
        F.count_if(F.col("ingested_at") - F.col("created_at") > F.expr("INTERVAL 1 DAY")).alias("n_late"),
    )


def st_registry(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of chunks from the registry, which overrides; what it lacks needs checking."""
    law = table(spark, d, "legal_documents").groupBy("doc_id").agg(F.min("title").alias("law_title"), F.min("validity").alias("validity"), F.min("effective_from").alias("effective_from"))
    e = table(spark, d, "scored_evidence", "evidence_row_id", "doc_id", "document_title")
    title = F.coalesce("law_title", "document_title")
    return e.join(law, "doc_id", "left").select("evidence_row_id", title.alias("title"), F.coalesce("validity", F.lit("needs_verification")).alias("validity"), (~title.eqNullSafe(F.col("document_title"))).alias("changed"), F.col("effective_from"))


def st_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scope of a document by its text: excluded, inside, or unknown."""
    x = table(spark, d, "documents", "doc_id", "text")
    out = F.when(t.contains_any(F.col("text"), ["phụ lục 9"]), "excluded").when(t.contains_any(F.col("text"), ["lao động", "tiền lương", "overtime"]), "inside").otherwise("unknown")
    return x.select("doc_id", out.alias("scope"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("st_")}


def oracle_sql() -> dict:
    lines = "lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INT - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
    esc = lambda p: p.replace("'", "''")
    kind = "CASE " + " ".join(f"WHEN regexp_matches(line, '{esc(p)}') THEN '{k}'" for k, p in s.GRAMMAR) + " ELSE 'text' END"
    number = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '{esc(p)}', 1)" for k, p in s.GRAMMAR[1:]) + " END"
    levels = [*s.LEVELS, "clause"]
    w = "PARTITION BY doc_id ORDER BY pos"
    runs = ", ".join(f"sum((kind IN ({', '.join(repr(x) for x in levels[: i + 1])}))::INT) OVER ({w}) AS run_{lv}" for i, lv in enumerate(levels))
    last = []
    for i, lv in enumerate([*levels, "point"]):
        part = f", run_{levels[i - 1]}" if i else ""
        last.append(f"last_value(CASE WHEN kind = '{lv}' THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id{part} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS {lv}")
    carried = f"""{lines}, k AS (SELECT *, {kind} AS kind FROM lines), kn AS (SELECT *, {number} AS number FROM k), kr AS (SELECT *, {runs} FROM kn),
carried AS (SELECT doc_id, pos, line, kind, {', '.join(last)} FROM kr)"""
    starts = ", ".join(repr(x) for x in [*s.LEVELS, "clause", "point"])
    fams = {"amount": "(\\d[\\d.,]*\\s*(?:đồng|triệu|tỷ))", "share": "(\\d+(?:[.,]\\d+)?\\s*%)", "days": "(\\d+)\\s+ngày", "months": "(\\d+)\\s+tháng", "article": "(điều\\s+\\d+)"}
    facts = " UNION ".join(f"SELECT turn_row_id, '{n}' AS family, unnest(regexp_extract_all(lower(user_query), '{p}', 1)) AS value FROM turns" for n, p in fams.items())
    fresh, ended = s.FRESH.replace("'", "''"), s.ENDED.replace("'", "''")
    return {
        "st_unwrapped": f"""WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM p),
m AS (SELECT *, CASE WHEN n = 1 OR regexp_matches(lag(line) OVER w, '{ended}') OR regexp_matches(line, '{fresh}') THEN 1 ELSE 0 END AS begins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM m),
t AS (SELECT doc_id, grp, n, CASE WHEN n > min(n) OVER w THEN ltrim(line, ' ') ELSE line END AS line, n = max(n) OVER w AS is_last FROM g WINDOW w AS (PARTITION BY doc_id, grp)),
j AS (SELECT doc_id, grp, string_agg(CASE WHEN is_last THEN line ELSE rtrim(line, ' ') END, ' ' ORDER BY n) AS line, count(*) AS k FROM t GROUP BY doc_id, grp)
SELECT doc_id, string_agg(line, chr(10) ORDER BY grp) AS text, sum(k)::INT AS n_before, count(*)::INT AS n_after FROM j GROUP BY doc_id""",
        "st_line_kinds": f"WITH {lines} SELECT {kind} AS kind, count(*) AS n FROM lines GROUP BY 1",
        "st_headings": f"WITH {carried} SELECT doc_id, pos, kind, chapter, section, article, clause, point FROM carried WHERE kind IN ('clause', 'point')",
        "st_chunks": f"""WITH {carried}, c AS (SELECT *, sum((kind IN ({starts}))::INT) OVER ({w})::BIGINT AS chunk_no FROM carried),
g AS (SELECT doc_id, chunk_no, arg_min(kind, pos) AS kind, {', '.join(f'first({lv} ORDER BY pos) AS {lv}' for lv in [*levels, 'point'])}, min(pos) AS first_pos, max(pos) AS last_pos,
 count_if(kind <> 'blank')::BIGINT AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kind <> 'blank'), '') AS text FROM c GROUP BY doc_id, chunk_no),
b AS (SELECT *, doc_id || '#' || concat_ws('-', CASE WHEN chunk_no = 0 THEN 'preamble' END, 'p' || appendix, 'c' || chapter, 'm' || section, 'd' || article, 'k' || clause, point) AS base FROM g WHERE n_lines > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY chunk_no) AS n FROM b)
SELECT doc_id, chunk_no, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS chunk_id, kind, first_pos, last_pos, n_lines, md5(text) AS text_md5 FROM n""",
        "st_cleaned": f"""WITH {lines}, c AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \\t\\x{{a0}}]+', ' ', 'g')) AS line FROM lines), k AS (SELECT * FROM c WHERE NOT regexp_matches(line, '{NOISE}')),
g AS (SELECT *, lag(line) OVER ({w}) AS before FROM k) SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM g WHERE before IS NULL OR before <> line GROUP BY doc_id""",
        "st_quality": """WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), y AS (SELECT *, length(regexp_replace(low, '[^a-zà-ỹđ]', '', 'g')) AS n, length(regexp_replace(low, '[^à-ỹđ]', '', 'g')) AS m FROM x),
z AS (SELECT *, CASE WHEN n > 0 THEN round(m / n, 6) ELSE 0.0::DOUBLE END AS r, (length(low) - length(replace(low, chr(65533), '')))::INT AS bad FROM y)
SELECT doc_id, length(low)::INT AS n_chars, r AS marked_ratio, bad AS n_bad, concat_ws(',', CASE WHEN length(low) < 40 THEN 'short' END, CASE WHEN r < 0.08 THEN 'few_marks' END, CASE WHEN bad > 0 THEN 'replacement' END) AS reasons FROM z""",
        "st_low_text": """SELECT source, count(*) AS n, round(avg(coalesce(length(text), 0)), 4) AS mean_chars, CASE WHEN round(avg(coalesce(length(text), 0)), 4) < 120 THEN 'ocr' ELSE 'text' END AS route FROM documents GROUP BY source""",
        "st_islands": f"""WITH {lines}, g AS (SELECT *, sum(regexp_matches(line, '^(Hỏi đáp về|Điều \\d+\\.|Chương \\d+\\.|Phần \\d+:)')::INT) OVER ({w})::BIGINT AS group_no FROM lines)
SELECT doc_id, group_no, arg_min(line, pos) AS header, count(*) - 1 AS n_lines FROM g WHERE group_no > 0 GROUP BY ALL""",
        "st_date_intervals": """WITH s AS (SELECT evidence_row_id, unnest(p) AS s, generate_subscripts(p, 1)::INT - 1 AS sentence_no FROM (SELECT evidence_row_id, regexp_split_to_array(content, '[.!?]\\s+|\\n') AS p FROM scored_evidence)),
r AS (SELECT evidence_row_id, sentence_no, regexp_extract_all(s, '(\\d{2}/\\d{2}/\\d{4})', 1) AS d FROM s), x AS (SELECT evidence_row_id, sentence_no, generate_subscripts(d, 1)::INT - 1 AS n, try_strptime(unnest(d), '%d/%m/%Y')::DATE AS day FROM r),
g AS (SELECT *, lead(day) OVER (PARTITION BY evidence_row_id, sentence_no ORDER BY n) - day AS days FROM x) SELECT evidence_row_id, sentence_no, n, days::INT AS days FROM g WHERE days >= 0""",
        "st_facts": facts,
        "st_dq": """SELECT count(*) AS n, count_if(coalesce(trim(content) = '', true))::BIGINT AS n_empty, count_if(length(content) BETWEEN 1 AND 14)::BIGINT AS n_short, count_if(length(content) > 1200)::BIGINT AS n_long,
 count_if(try_cast(trim(article_number) AS INT) IS NULL)::BIGINT AS n_unnumbered, count(chunk_id) - count(DISTINCT chunk_id) AS n_repeated, count_if(ingested_at - created_at > INTERVAL 1 DAY)::BIGINT AS n_late FROM scored_evidence""",
        "st_registry": """WITH l AS (SELECT doc_id, min(title) AS law_title, min(validity) AS validity, min(effective_from) AS effective_from FROM legal_documents GROUP BY doc_id)
SELECT evidence_row_id, coalesce(law_title, document_title) AS title, coalesce(validity, 'needs_verification') AS validity, coalesce(law_title, document_title) IS DISTINCT FROM document_title AS changed, effective_from
 FROM scored_evidence LEFT JOIN l USING (doc_id)""",
        "st_labels": f"""SELECT doc_id, CASE WHEN {t.sql_contains_any('text', ['phụ lục 9'])} THEN 'excluded' WHEN {t.sql_contains_any('text', ['lao động', 'tiền lương', 'overtime'])} THEN 'inside' ELSE 'unknown' END AS scope FROM documents""",
    }
