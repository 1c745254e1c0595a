"""Queries over headings, citations, tables and drafts (P3-P12, T1-T27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as t
from verdigris.operators import repair
from verdigris.operators import structure as s
from verdigris.plans import structure_queries as st
from verdigris.plans.text_queries import EXPANSIONS, SLANG
from verdigris.sources.tables import table

# A heading: its kind, its number and what else stands on its line.
HEAD = r"^\s*(Phần|Chương|Mục|Điều)\s+(\d+[a-zđ]?(?:\.\d+)?)[.:]?\s*(.*)$"
# What a reference in running text goes on with, and a title doesn't.
GOES_ON = r"^(của|thuộc|theo|tại|và|hoặc|với|sau|này)( |$)"
AMOUNT = r"(\d[\d.,]*) (triệu đồng|đồng|%)"
MAPPED = [(["nợ lương", "nợ tôi"], "chậm trả lương tiền lương"), (["bị đuổi", "cho nghỉ"], "chấm dứt hợp đồng đơn phương"), (["tai nạn"], "tai nạn lao động bồi thường"), (["trừ"], "khấu trừ tiền lương")]
PARAGRAPHS = [(r"[ \t]+\n", "\n"), (r"([.:;!?])\n([^\n])", "$1\n\n$2"), (r"\n(\*\*[^\n*]+\*\*)\n", "\n\n$1\n\n"), (r"\n{3,}", "\n\n")]
DRAFT = [(r"<[^<>]*>", ""), (r"```[a-z]*", ""), (r"\*\*|__", ""), (r"(^|\n)#+ *", "$1"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")]


def _heads(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = st._lines(spark, d).withColumn("next", F.lead("line").over(w))
    part = lambda n: F.regexp_extract("line", HEAD, n)
    return lines.where(F.col("line").rlike(HEAD)).select("doc_id", "pos", "line", "next", part(1).alias("kind"), part(2).alias("number"), F.trim(part(3)).alias("title"))


def st_titled(spark: SparkSession, d: str) -> DataFrame:
    """Headings with their title, from the next line where their own has none and the next is no heading itself."""
    free = F.col("next").isNotNull() & (F.trim("next") != "") & ~F.col("next").rlike(HEAD)
    title = F.when(F.col("title") != "", F.col("title")).when(free, F.trim("next"))
    return _heads(spark, d).select("doc_id", "pos", "kind", "number", title.alias("full_title"), ((F.col("title") == "") & F.coalesce(free, F.lit(False))).alias("from_next"))


def st_citations(spark: SparkSession, d: str) -> DataFrame:
    """Which lines that look like a heading are a reference in running text."""
    goes_on = F.lower("title").rlike(GOES_ON) | F.rtrim("line").rlike("[;,]$") | F.lower("title").rlike("(luật|nghị định|thông tư) này")
    return _heads(spark, d).select("doc_id", "pos", "kind", "number", goes_on.alias("is_citation"))


def st_article_guard(spark: SparkSession, d: str) -> DataFrame:
    """Article headings against the highest article known of their statute, and whether that has been reached."""
    known = table(spark, d, "scored_evidence").groupBy(F.col("doc_id").alias("statute_id")).agg(F.max(F.trim("article_number").try_cast("int")).alias("max_allowed"))
    documents = table(spark, d, "documents", "doc_id", "statute_id")
    heads = _heads(spark, d).where("kind = 'Điều'").select("doc_id", "pos", F.col("number").try_cast("int").alias("article")).where("article IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = heads.join(documents, "doc_id").join(known, "statute_id", "left")
    reached = F.max(F.coalesce(F.col("article") == F.col("max_allowed"), F.lit(False))).over(w)
    return joined.select("doc_id", "pos", "article", "max_allowed", ((F.col("article") > 0) & F.coalesce(F.col("article") <= F.col("max_allowed"), F.lit(True))).alias("accepted"), reached.alias("reached"))


def st_kept_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, without those of an article's heading alone whose clauses follow."""
    following = F.lead("kind").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    bare = (F.col("kind") == "article") & (F.col("n_lines") == 1) & F.coalesce(following == "clause", F.lit(False))
    return st.st_chunks(spark, d).withColumn("dropped", bare).where("NOT dropped").select("doc_id", "chunk_no", "chunk_id", "kind")


def st_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with their unit, in the order of the text; a content without any has one row of place 0."""
    content = F.coalesce("content", F.lit(""))
    found = lambda n: F.regexp_extract_all(content, F.lit(AMOUNT), F.lit(n))
    rows = F.arrays_zip(found(1).alias("amount"), found(2).alias("unit"))
    out = table(spark, d, "scored_evidence", "evidence_row_id", "content").select("evidence_row_id", F.posexplode_outer(rows).alias("n", "r"))
    return out.select("evidence_row_id", F.coalesce(F.col("n") + 1, F.lit(0)).alias("place"), F.regexp_replace("r.amount", "[.,]+$", "").alias("amount"), "r.unit")


def st_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    """Kept page texts against the present ones, by hash and number of lines: two of three documents are kept, every tenth in another state."""
    now = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"), F.size(F.split("text", "\n")).alias("n_lines"))
    state = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    kept = table(spark, d, "documents", "doc_id", "text").where("doc_id % 3 <> 0").select("doc_id", F.sha2(state, 256).alias("kept_digest"), F.size(F.split("text", "\n")).alias("kept_lines"))
    same = F.col("digest").eqNullSafe(F.col("kept_digest")) & F.col("n_lines").eqNullSafe(F.col("kept_lines"))
    return now.join(kept.withColumn("held", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("held").isNull(), "missing").when(same, "valid").otherwise("stale").alias("state"))


def t_nfc(spark: SparkSession, d: str) -> DataFrame:
    """Questions composed to NFC and then normalised."""
    composed = t.composed(table(spark, d, "phase5b_eval_dataset"), "row_id", "question")
    return composed.select("row_id", t.normalize_query(F.col("text")).alias("normalized"))


def t_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Answers without accents, their case kept."""
    return table(spark, d, "turns").select("turn_row_id", F.md5(t.stripped(F.col("assistant_response"))).alias("stripped_md5"))


def t_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the words of every mapping whose phrase they hold, each word once, in order."""
    return table(spark, d, "turns").select("turn_row_id", t.mapped(F.col("user_query"), MAPPED).alias("mapped"))


def t_prepared(spark: SparkSession, d: str) -> DataFrame:
    """A question made ready for retrieval: normalised, slang rewritten, mapped, expanded."""
    # A column for each step: every step names its text many times, and steps put into each other would work it out anew each time.
    q = table(spark, d, "turns").select("turn_row_id", t.normalize_query(F.col("user_query")).alias("q"))
    for step, given in ((t.rewrite, SLANG), (t.mapped, MAPPED), (t.expand, EXPANSIONS)):
        q = q.select("turn_row_id", step(F.col("q"), given).alias("q"))
    return q.withColumnRenamed("q", "prepared")


def t_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Answers laid out in paragraphs."""
    text = F.trim(t.replaced_all(F.col("assistant_response"), PARAGRAPHS))
    return table(spark, d, "turns").select("turn_row_id", F.md5(text).alias("text_md5"), F.size(F.split(text, "\n\n")).alias("n_paragraphs"))


def t_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Answers without marks of layout."""
    return table(spark, d, "turns").select("turn_row_id", t.replaced_all(F.col("assistant_response"), DRAFT).alias("plain"))


def t_repaired(spark: SparkSession, d: str) -> DataFrame:
    """What can be read of each payload, and how."""
    return repair.repaired_json(table(spark, d, "phase5b_failed_queries_diagnostics"), "raw_id", "payload")


def t_sources(spark: SparkSession, d: str) -> DataFrame:
    """Titles of sources replaced by the registry's, by document."""
    registry = table(spark, d, "legal_documents").groupBy("doc_id").agg(F.max("title").alias("listed"))
    e = table(spark, d, "scored_evidence").select("evidence_row_id", "doc_id", "document_title", "document_no")
    joined = e.join(registry, "doc_id", "left")
    return joined.select("evidence_row_id", F.concat_ws(" - ", "document_no", F.coalesce("listed", "document_title")).alias("source"), (F.col("listed").isNotNull() & ~F.col("listed").eqNullSafe(F.col("document_title"))).alias("patched"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("st_", "t_")) and callable(f)}


def oracle_sql() -> dict:
    lines = "lines AS (SELECT doc_id, generate_subscripts(p, 1)::INT - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"
    heads = f"""{lines}, nx AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM lines),
heads AS (SELECT doc_id, pos, line, next, regexp_extract(line, '{HEAD}', 1) AS kind, regexp_extract(line, '{HEAD}', 2) AS number, trim(regexp_extract(line, '{HEAD}', 3)) AS title FROM nx WHERE regexp_matches(line, '{HEAD}'))"""
    chunks = st.oracle_sql()["st_chunks"]

    def chain(column, rules):
        for pattern, new in rules:
            new = new.replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '")
            pattern = pattern.replace("\\n", "\n").replace("\n", "\\n")
            column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
        return column

    def mapped(column):
        hits = ", ".join(f"CASE WHEN {t.sql_contains_any(column, words)} THEN '{more}' END" for words, more in MAPPED)
        words = f"string_split(array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ' '), ' ')"
        return f"list_filter({words}, lambda x, i: list_position({words}, x) = i AND x <> '')"

    rewritten = f"concat(' ', lower(coalesce({t.sql_normalize_query('user_query')}, '')), ' ')"
    edge = f"[^{t.LETTERS}0-9_]"
    for old, new in SLANG:
        rewritten = f"regexp_replace({rewritten}, '(^|{edge}){old}($|{edge})', '\\1{new}\\2', 'g')"
    extras = ", ".join(f"CASE WHEN {t.sql_contains_any('q', tr)} AND NOT contains(lower(q), '{more}') THEN '{more}' END" for tr, more in EXPANSIONS)
    paragraphs = f"trim({chain('assistant_response', PARAGRAPHS)})"
    return {
        "st_titled": f"""WITH {heads}, f AS (SELECT *, coalesce(next IS NOT NULL AND trim(next) <> '' AND NOT regexp_matches(next, '{HEAD}'), false) AS free FROM heads)
SELECT doc_id, pos, kind, number, CASE WHEN title <> '' THEN title WHEN free THEN trim(next) END AS full_title, title = '' AND free AS from_next FROM f""",
        "st_citations": f"""WITH {heads} SELECT doc_id, pos, kind, number, regexp_matches(lower(title), '{GOES_ON}') OR regexp_matches(rtrim(line), '[;,]$') OR regexp_matches(lower(title), '(luật|nghị định|thông tư) này') AS is_citation FROM heads""",
        "st_article_guard": f"""WITH {heads}, k AS (SELECT doc_id AS statute_id, max(try_cast(trim(article_number) AS INT)) AS max_allowed FROM scored_evidence GROUP BY doc_id),
a AS (SELECT h.doc_id, pos, try_cast(number AS INT) AS article, max_allowed FROM heads h JOIN documents d ON d.doc_id = h.doc_id LEFT JOIN k ON k.statute_id = d.statute_id WHERE kind = 'Điều' AND try_cast(number AS INT) IS NOT NULL)
SELECT doc_id, pos, article, max_allowed, article > 0 AND coalesce(article <= max_allowed, true) AS accepted, max(coalesce(article = max_allowed, false)) OVER (PARTITION BY doc_id ORDER BY pos) AS reached FROM a""",
        "st_kept_chunks": f"""WITH c AS ({chunks}), f AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS following FROM c)
SELECT doc_id, chunk_no, chunk_id, kind FROM f WHERE NOT (kind = 'article' AND n_lines = 1 AND coalesce(following = 'clause', false))""",
        "st_amounts": f"""WITH x AS (SELECT evidence_row_id, regexp_extract_all(coalesce(content, ''), '{AMOUNT}', 1) AS a, regexp_extract_all(coalesce(content, ''), '{AMOUNT}', 2) AS u FROM scored_evidence)
SELECT evidence_row_id, generate_subscripts(a, 1)::INT AS place, regexp_replace(unnest(a), '[.,]+$', '') AS amount, unnest(u) AS unit FROM x WHERE len(a) > 0 UNION ALL SELECT evidence_row_id, 0, NULL, NULL FROM x WHERE len(a) = 0""",
        "st_cache_valid": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 10 = 0 AND text IS NOT NULL THEN 'stale' ELSE 'valid' END AS state FROM documents""",
        "t_nfc": f"WITH x AS (SELECT row_id, nfc_normalize(question) AS question FROM phase5b_eval_dataset) SELECT row_id, {t.sql_normalize_query('question')} AS normalized FROM x",
        "t_stripped": f"""SELECT turn_row_id, md5(translate(regexp_replace(assistant_response, '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '{t.MARKED}{t.UPPER[0]}', '{t.BASE}{t.UPPER[1]}')) AS stripped_md5 FROM turns""",
        "t_mapped": f"""SELECT turn_row_id, CASE WHEN len({mapped('user_query')}) > 0 THEN trim(concat(user_query, ' ', array_to_string({mapped('user_query')}, ' '))) ELSE user_query END AS mapped FROM turns""",
        "t_prepared": f"""WITH r AS (SELECT turn_row_id, trim({rewritten}) AS p FROM turns), m AS (SELECT turn_row_id, CASE WHEN len({mapped('p')}) > 0 THEN trim(concat(p, ' ', array_to_string({mapped('p')}, ' '))) ELSE p END AS q FROM r)
SELECT turn_row_id, concat_ws(' ', q, array_to_string(list_filter([{extras}], lambda x: x IS NOT NULL), ' ')) AS prepared FROM m""",
        "t_paragraphs": f"SELECT turn_row_id, md5({paragraphs}) AS text_md5, len(string_split({paragraphs}, chr(10) || chr(10)))::INT AS n_paragraphs FROM turns",
        "t_drafts": f"SELECT turn_row_id, {chain('assistant_response', DRAFT)} AS plain FROM turns",
        "t_sources": """WITH l AS (SELECT doc_id, max(title) AS listed FROM legal_documents GROUP BY doc_id)
SELECT evidence_row_id, concat_ws(' - ', document_no, coalesce(listed, document_title)) AS source, listed IS NOT NULL AND listed IS DISTINCT FROM document_title AS patched FROM scored_evidence e LEFT JOIN l ON l.doc_id = e.doc_id""",
    }
