"""Queries over text: normalising, folding, tokens, rewrites, labels (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import index
from verdigris.sources.tables import table

SLANG = [("cty", "công ty"), ("hđlđ", "hợp đồng lao động"), ("bhxh", "bảo hiểm xã hội"), ("em", "tôi"), ("sdt", "số điện thoại"), ("đt", "điện thoại")]
EXPANSIONS = [
    (["nghỉ việc", "thôi việc"], "chấm dứt hợp đồng lao động"),
    (["tai nạn"], "tai nạn lao động bồi thường"),
    (["lương"], "tiền lương"),
    (["thai"], "chế độ thai sản"),
    (["đêm", "làm thêm"], "phụ cấp ca đêm làm thêm giờ"),
]
KEYWORDS = {
    "about_pay": ["lương", "phụ cấp", "tiền", "wages", "pay"],
    "about_leave": ["nghỉ", "leave"],
    "about_accident": ["tai nạn", "accident"],
    "about_contract": ["hợp đồng", "contract"],
}
ASKING = ["thì", "sao", "thế nào", "ai", "không", "đâu", "gì"]


def t_normalized(spark: SparkSession, d: str) -> DataFrame:
    q = t.normalize_query(F.col("question"))
    return table(spark, d, "phase5b_eval_dataset").select("row_id", q.alias("normalized"), F.length(q).alias("n_chars"))


def t_folded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").select("turn_row_id", t.search_key(F.col("user_query")).alias("search_key"))


def t_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and chunks per token over all evidence."""
    # Counted where a chunk is, so that only one row per token and partition is shuffled.
    counted = index.postings(table(spark, d, "scored_evidence"), "evidence_row_id", "content").where(F.col("term") != index.ALL)
    return counted.groupBy(F.col("term").alias("token")).agg(F.sum("tf").alias("n_occurrences"), F.count("*").alias("n_chunks"))


def t_token_sets(spark: SparkSession, d: str) -> DataFrame:
    s = t.token_set(F.col("question"))
    return table(spark, d, "phase5b_eval_dataset").select("row_id", F.size(s).alias("n_tokens"), F.array_join(F.array_sort(s), " ").alias("token_set"))


def t_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").select("turn_row_id", t.rewrite(t.normalize_query(F.col("user_query")), SLANG).alias("rewritten"))


def t_expanded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "phase5b_eval_dataset").select("row_id", t.expand(t.normalize_query(F.col("question")), EXPANSIONS).alias("expanded"))


def t_keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = [t.contains_any(F.col("user_query"), words).alias(name) for name, words in KEYWORDS.items()]
    return table(spark, d, "turns").select("turn_row_id", *flags)


def t_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Long or many-sided questions, told by length, question marks and asking words."""
    q = t.normalize_query(F.col("user_query"))
    words = F.size(F.split(q, " "))
    marks = t.count_matches(F.col("user_query"), r"\?")
    asking = sum((t.contains_any(F.col("user_query"), [w]).cast("int") for w in ASKING[1:]), t.contains_any(F.col("user_query"), ASKING[:1]).cast("int"))
    rule = ((words >= 25) & (F.length(q) >= 130)) | (F.length(q) >= 160) | (marks >= 2)
    return table(spark, d, "turns").select(
        "turn_row_id", words.alias("n_words"), marks.alias("n_marks"), asking.alias("n_asking"), rule.alias("is_scenario")
    )


def t_article_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_evidence").select("evidence_row_id", F.array_join(t.article_labels(F.col("content")), ",").alias("labels"))


def t_citation_parts(spark: SparkSession, d: str) -> DataFrame:
    """Document number, article and clause that a question names first."""
    low = F.lower(F.coalesce("question", F.lit("")))
    number = F.regexp_extract(low, r"(\d+(?:/\d+)?/[a-zđ]+-[a-zđ]+)", 1)
    return table(spark, d, "phase5b_eval_dataset").select(
        "row_id",
        F.nullif(number, F.lit("")).alias("named_document"),
        F.regexp_extract(low, r"điều\s+(\d+)", 1).try_cast("int").alias("named_article"),
        F.regexp_extract(low, r"khoản\s+(\d+)", 1).try_cast("int").alias("named_clause"),
    )


def t_diacritics(spark: SparkSession, d: str) -> DataFrame:
    """Texts that have lost their accents and are to be restored."""
    ratio = t.diacritic_ratio(F.col("assistant_response"))
    letters = F.length(F.regexp_replace(F.lower("assistant_response"), "[^a-zà-ỹđ]", ""))
    return table(spark, d, "turns").select(
        "turn_row_id", F.round(ratio, 4).alias("ratio"), F.coalesce((letters > 20) & (ratio < 0.08), F.lit(False)).alias("restore")
    )


def t_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title of a conversation, from its first question."""
    turns = table(spark, d, "turns")
    first = turns.groupBy("conv_id").agg(F.min_by("user_query", F.struct("turn_no", "turn_row_id")).alias("q"))
    return first.select("conv_id", t.title_of(F.col("q")).alias("title"))


def t_csv_safe(spark: SparkSession, d: str) -> DataFrame:
    comment = F.concat(F.when(F.col("feedback_row_id") % 3 == 0, F.lit(" =")).when(F.col("feedback_row_id") % 3 == 1, F.lit("@")).otherwise(F.lit("")), F.col("comment"))
    return table(spark, d, "feedback").select("feedback_row_id", t.csv_safe(comment).alias("cell"))


def t_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_evidence").select(
        "evidence_row_id", t.sanitized(F.col("chunk_id")).alias("parameter"), t.read_only(F.col("article_title")).alias("read_only")
    )


def t_previews(spark: SparkSession, d: str) -> DataFrame:
    """Clipped previews, sizes and provision badges of search results."""
    return table(spark, d, "scored_evidence").select(
        "evidence_row_id",
        t.clip(F.col("content"), 250).alias("preview"),
        t.file_size(F.octet_length("content").cast("bigint")).alias("size"),
        F.concat_ws(" · ", F.concat(F.lit("Điều "), F.trim("article_number")), F.concat(F.lit("Khoản "), F.col("clause_number").cast("string")), F.concat(F.lit("Điểm "), F.nullif("point", F.lit("")))).alias("badge"),
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("t_") and callable(f)}


def oracle_sql() -> dict:
    q = t.sql_normalize_query("user_query")
    rewritten = f"concat(' ', lower(coalesce({t.sql_normalize_query('user_query')}, '')), ' ')"
    edge = f"[^{t.LETTERS}0-9_]"
    for old, new in SLANG:
        rewritten = f"regexp_replace({rewritten}, '(^|{edge}){old}($|{edge})', '\\1{new}\\2', 'g')"
    nq = t.sql_normalize_query("question")
    extras = ", ".join(
        f"CASE WHEN {t.sql_contains_any(nq, tr)} AND NOT contains(lower({nq}), '{more}') THEN '{more}' END" for tr, more in EXPANSIONS
    )
    asking = " + ".join(f"{t.sql_contains_any('user_query', [w])}::INT" for w in ASKING)
    return {
        "t_normalized": f"SELECT row_id, {nq} AS normalized, length({nq})::INT AS n_chars FROM phase5b_eval_dataset",
        "t_folded": f"SELECT turn_row_id, trim(regexp_replace({t.sql_fold('user_query')}, '[^a-z0-9]+', ' ', 'g')) AS search_key FROM turns",
        "t_token_counts": f"""WITH w AS (SELECT evidence_row_id, unnest({t.sql_tokens('content')}) AS token FROM scored_evidence)
SELECT token, count(*) AS n_occurrences, count(DISTINCT evidence_row_id) AS n_chunks FROM w GROUP BY token""",
        "t_token_sets": f"""SELECT row_id, len(list_distinct({t.sql_tokens('question')}))::INT AS n_tokens,
 array_to_string(list_sort(list_distinct({t.sql_tokens('question')})), ' ') AS token_set FROM phase5b_eval_dataset""",
        "t_rewritten": f"SELECT turn_row_id, trim({rewritten}) AS rewritten FROM turns",
        "t_expanded": f"""SELECT row_id, concat_ws(' ', {nq}, array_to_string(list_filter([{extras}], lambda x: x IS NOT NULL), ' ')) AS expanded
 FROM phase5b_eval_dataset""",
        "t_keyword_flags": "SELECT turn_row_id, "
        + ", ".join(f"{t.sql_contains_any('user_query', w)} AS {n}" for n, w in KEYWORDS.items())
        + " FROM turns",
        "t_scenarios": f"""WITH x AS (SELECT turn_row_id, {q} AS q, user_query FROM turns)
SELECT turn_row_id, len(string_split(q, ' '))::INT AS n_words, len(regexp_extract_all(coalesce(user_query, ''), '\\?'))::INT AS n_marks,
 ({asking})::INT AS n_asking,
 (len(string_split(q, ' ')) >= 25 AND length(q) >= 130) OR length(q) >= 160 OR len(regexp_extract_all(coalesce(user_query, ''), '\\?')) >= 2 AS is_scenario FROM x""",
        "t_article_labels": """WITH x AS (SELECT evidence_row_id, regexp_extract_all(lower(coalesce(content, '')), 'điều\\s+(\\d+[a-zđ]?)', 1) AS l FROM scored_evidence)
SELECT evidence_row_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS labels FROM x""",
        "t_citation_parts": """WITH x AS (SELECT row_id, lower(coalesce(question, '')) AS q FROM phase5b_eval_dataset)
SELECT row_id, nullif(regexp_extract(q, '(\\d+(?:/\\d+)?/[a-zđ]+-[a-zđ]+)', 1), '') AS named_document,
 try_cast(nullif(regexp_extract(q, 'điều\\s+(\\d+)', 1), '') AS INT) AS named_article, try_cast(nullif(regexp_extract(q, 'khoản\\s+(\\d+)', 1), '') AS INT) AS named_clause FROM x""",
        "t_diacritics": """WITH x AS (SELECT turn_row_id, length(regexp_replace(lower(assistant_response), '[^a-zà-ỹđ]', '', 'g')) AS n,
 length(regexp_replace(lower(assistant_response), '[^à-ỹđ]', '', 'g')) AS m FROM turns)
SELECT turn_row_id, round(CASE WHEN n > 0 THEN m / n END, 4) AS ratio, coalesce(n > 20 AND m / n < 0.08, false) AS restore FROM x""",
        "t_titles": f"""WITH f AS (SELECT conv_id, user_query FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_no, turn_row_id) = 1),
x AS (SELECT conv_id, string_split({t.sql_normalize_query('user_query')}, ' ') AS p FROM f)
SELECT conv_id, array_to_string(p[1:6], ' ') || CASE WHEN len(p) > 6 THEN '…' ELSE '' END AS title FROM x""",
        "t_csv_safe": """WITH x AS (SELECT feedback_row_id, CASE feedback_row_id % 3 WHEN 0 THEN ' =' WHEN 1 THEN '@' ELSE '' END || comment AS c FROM feedback)
SELECT feedback_row_id, CASE WHEN regexp_matches(regexp_replace(c, '^[\\s\\x{a0}]+', ''), '^[=+\\-@]') THEN '''' || c ELSE c END AS cell FROM x""",
        "t_sanitized": """SELECT evidence_row_id, regexp_replace(chunk_id, '[^A-Za-z0-9_ .:#/-]', '', 'g') AS parameter,
 NOT regexp_matches(upper(article_title), '(^|[^A-Z])(CREATE|MERGE|DELETE|SET|REMOVE|DROP|CALL|LOAD)([^A-Z]|$)') AS read_only FROM scored_evidence""",
        "t_previews": """SELECT evidence_row_id, CASE WHEN length(content) <= 250 THEN content ELSE rtrim(substring(content, 1, 249)) || '…' END AS preview,
 CASE WHEN strlen(content) < 1024 THEN strlen(content) || ' B' WHEN strlen(content) < 1048576 THEN round(strlen(content) / 1024, 1)::DECIMAL(18,1) || ' KB'
  WHEN content IS NOT NULL THEN round(strlen(content) / 1048576, 1)::DECIMAL(18,1) || ' MB' END AS size,
 concat_ws(' · ', 'Điều ' || trim(article_number), 'Khoản ' || clause_number::VARCHAR, 'Điểm ' || nullif(point, '')) AS badge FROM scored_evidence""",
    }
