"""Pages and lines to a hierarchy of numbered chunks (P, S11-S15).

The grammar is an ordered list of (kind, pattern); the first that fits a line
names it. Headings are carried down by windows over the document's lines, lower
levels resetting where a higher one begins. A document is the unit of a window;
documents are spread by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How the numbered parts of a statute begin.
GRAMMAR = [
    ("blank", r"^\s*$"),
    ("appendix", r"^\s*PHỤ LỤC\s+(\d+)"),
    ("part", r"^\s*Phần\s+(\d+)"),
    ("chapter", r"^\s*Chương\s+(\d+)"),
    ("section", r"^\s*Mục\s+(\d+(?:\.\d+)?)"),
    ("article", r"^\s*Điều\s+(\d+[a-zđ]?)\."),
    ("clause", r"^\s*(\d+)\.\s"),
    ("point", r"^\s*([a-zđ])\)\s"),
]
LEVELS = ["appendix", "part", "chapter", "section", "article"]


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line), pos from 0; a null text has no line."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def kind_of(line: Column, grammar=None) -> Column:
    """The kind of a line by the grammar, else text."""
    grammar = GRAMMAR if grammar is None else grammar
    out = None
    for kind, pattern in grammar:
        out = F.when(line.rlike(pattern), kind) if out is None else out.when(line.rlike(pattern), kind)
    return out.otherwise("text")


def number_of(line: Column, kind: Column, grammar=None) -> Column:
    """The number a heading line carries."""
    out = None
    for name, pattern in [g for g in (grammar or GRAMMAR) if "(" in g[1].replace("(?:", "")]:
        value = F.regexp_extract(line, pattern, 1)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def carried(df: DataFrame, key: str) -> DataFrame:
    """Adds to each line the numbers of the headings above it and of its clause and point."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = df.withColumn("kind", kind_of(F.col("line"))).withColumn("number", number_of(F.col("line"), F.col("kind")))
    # One running count per level, of headings at this level or a higher one.
    levels = [*LEVELS, "clause"]
    for depth, level in enumerate(levels):
        named = named.withColumn(f"_run_{level}", F.sum(F.when(F.col("kind").isin(*levels[: depth + 1]), 1).otherwise(0)).over(w))
    for depth, level in enumerate([*levels, "point"]):
        above = [f"_run_{levels[depth - 1]}"] if depth else []
        inside = Window.partitionBy(key, *above).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        named = named.withColumn(level, F.last(F.when(F.col("kind") == level, F.col("number")), ignorenulls=True).over(inside))
    return named.drop(*[f"_run_{level}" for level in levels])


def chunks(df: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no, chunk_id, kind, first_pos, last_pos, n_lines, text): a new chunk at every heading, clause and point.

    Ids follow the numbering; the n-th repeat of one in a document gets ``-n``.
    Lines before the first heading are the preamble. Blank lines belong to the
    chunk above and leave no trace in its text.
    """
    starts = ["article", "clause", "point", *LEVELS[:-1]]
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = carried(df, key).withColumn("chunk_no", F.sum(F.when(F.col("kind").isin(*starts), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "blank", F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    grouped = c.groupBy(key, "chunk_no").agg(
        F.min_by("kind", "pos").alias("kind"),
        *[F.min_by(level, "pos").alias(level) for level in [*LEVELS, "clause", "point"]],
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count_if(F.col("kind") != "blank").alias("n_lines"),
        text.alias("text"),
    )
    parts = F.concat_ws(
        "-",
        F.when(F.col("chunk_no") == 0, "preamble"),
        F.concat(F.lit("p"), "appendix"),
        F.concat(F.lit("c"), "chapter"),
        F.concat(F.lit("m"), "section"),
        F.concat(F.lit("d"), "article"),
        F.concat(F.lit("k"), "clause"),
        "point",
    )
    base = F.concat(F.col(key).cast("string"), F.lit("#"), parts)
    again = F.row_number().over(Window.partitionBy(key, "_base").orderBy("chunk_no"))
    out = grouped.where("n_lines > 0").withColumn("_base", base).withColumn("_n", again)
    chunk_id = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))
    return out.select(key, "chunk_no", chunk_id.alias("chunk_id"), "kind", "first_pos", "last_pos", "n_lines", "text")


def cleaned(df: DataFrame, key: str, noise: str) -> DataFrame:
    """Lines that aren't noise, blanks squeezed, runs of blank lines made one, repeats in a row dropped."""
    w = Window.partitionBy(key).orderBy("pos")
    tidy = df.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t ]+", " "))).where(~F.col("line").rlike(noise))
    return tidy.withColumn("_before", F.lag("line").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


# What begins a line of its own, and what ends one.
FRESH = r"^\s*(?:$|[-•*]\s|\d+[.)]\s|[a-zđ]\)\s|Điều\s|Chương\s|Mục\s|Phần\s|PHỤ LỤC)"
ENDED = r"(?:[.!?:;…”\"]|^)\s*$"


def unwrapped(df: DataFrame, key: str, text: str) -> DataFrame:
    """Broken lines of running text joined again, row by row and without a shuffle.

    A line goes on in the next unless it ends a sentence, a heading or a list
    item, or the next begins one. The places where lines begin are found first,
    then each stretch of lines is joined once.
    """
    split = df.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_parts"))
    place = F.sequence(F.lit(0), F.size("_parts") - 1)
    begins = F.filter(place, lambda i: (i == 0) | F.get("_parts", i - 1).rlike(ENDED) | F.get("_parts", i).rlike(FRESH))
    placed = split.select(key, "_parts", begins.alias("_begins"))

    def joined(start, k):
        stretch = F.slice("_parts", start + 1, F.coalesce(F.get("_begins", k + 1), F.size("_parts")) - start)
        last = F.size(stretch) - 1
        bare = F.transform(stretch, lambda line, i: F.when(i == 0, line).otherwise(F.ltrim(line)))
        return F.array_join(F.transform(bare, lambda line, i: F.when(i == last, line).otherwise(F.rtrim(line))), " ")

    whole = F.array_join(F.transform("_begins", joined), "\n")
    return placed.select(key, whole.alias("text"), F.size("_parts").alias("n_before"), F.size("_begins").alias("n_after"))


def quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """Scan quality: characters, share of marked letters, replacement signs, and the reasons against it."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    letters = F.length(F.regexp_replace(low, "[^a-zà-ỹđ]", ""))
    marked = F.length(F.regexp_replace(low, "[^à-ỹđ]", ""))
    ratio = F.when(letters > 0, F.round(marked / letters, 6)).otherwise(F.lit(0.0))
    bad = F.length(low) - F.length(F.replace(low, F.lit("�"), F.lit("")))
    reasons = F.array_compact(F.array(F.when(F.length(low) < 40, "short"), F.when(ratio < 0.08, "few_marks"), F.when(bad > 0, "replacement")))
    return df.select(key, F.length(low).alias("n_chars"), ratio.alias("marked_ratio"), bad.alias("n_bad"), F.array_join(reasons, ",").alias("reasons"))


def islands(df: DataFrame, key: str, header: str) -> DataFrame:
    """Groups of lines, each opened by a header line: (key, group_no, header, n_lines). Lines before the first header are left out."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.withColumn("group_no", F.sum(F.col("line").rlike(header).cast("int")).over(w)).where("group_no > 0")
    return grouped.groupBy(key, "group_no").agg(F.min_by("line", "pos").alias("header"), (F.count("*") - 1).alias("n_lines"))


def date_intervals(df: DataFrame, key: str, text: str) -> DataFrame:
    """Days between consecutive dates of one sentence, where they don't go backwards."""
    sentences = df.select(key, F.posexplode(F.split(F.col(text), r"[.!?]\s+|\n")).alias("sentence_no", "s"))
    dates = sentences.select(key, "sentence_no", F.posexplode(F.regexp_extract_all("s", F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1))).alias("n", "raw"))
    parsed = dates.withColumn("date", F.try_to_date(F.col("raw"), "dd/MM/yyyy"))
    w = Window.partitionBy(key, "sentence_no").orderBy("n")
    gaps = parsed.withColumn("next", F.lead("date").over(w)).withColumn("days", F.datediff("next", "date"))
    return gaps.where("days >= 0").select(key, "sentence_no", "n", "days")
