"""Rule tables applied to texts: labels, first matches, routes, splits (Q).

A rule is data: a name, words of which one must be in the lower-cased text, and
words none of which may be. Rules become one constant expression, so texts
aren't joined with anything and nothing leaves the JVM. Null texts match no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import fold, normalize_query


def holds(text: Column, any_of: list[str], none_of: list[str] | None = None) -> Column:
    """Whether the lower-cased text holds one of the words and none of the others."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in any_of:
        hit = hit | F.contains(low, F.lit(word))
    for word in none_of or []:
        hit = hit & ~F.contains(low, F.lit(word))
    return hit


def labels(text: Column, rules: list[dict]) -> Column:
    """The names of all rules that match, in their order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(holds(text, r["any"], r.get("none")), F.lit(r["name"])) for r in rules])))


def first_match(text: Column, rules: list[dict], otherwise: str) -> Column:
    """The name of the first rule that matches."""
    out = None
    for rule in rules:
        condition = holds(text, rule["any"], rule.get("none"))
        out = F.when(condition, rule["name"]) if out is None else out.when(condition, rule["name"])
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def remainder(text: Column, phrases: list[str]) -> Column:
    """What is left of the folded text without the phrases, longest first; empty for pure small talk."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), F.lit(" "))
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, f" {phrase}(?= )", "")
    return F.trim(out)


def decomposed(df: DataFrame, key: str, text: str, least: int = 12) -> DataFrame:
    """(key, part_no, part): the questions a text asks, split at marks, else at its semicolons; a text that doesn't split is one part."""
    q = normalize_query(F.col(text))
    by_marks = F.filter(F.transform(F.split(F.col(text), r"\?"), lambda x: normalize_query(x)), lambda x: F.length(x) >= least)
    by_signs = F.filter(F.transform(F.split(F.col(text), r";"), lambda x: normalize_query(x)), lambda x: F.length(x) >= least)
    parts = F.when(F.size(by_marks) > 1, by_marks).when(F.size(by_signs) > 1, by_signs).otherwise(F.array(q))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("part_no", "part"))


def numbers_kept(candidate: Column, *known: Column) -> Column:
    """Whether every number of the candidate is in one of the known texts."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))
    pool = numbers(known[0])
    for other in known[1:]:
        pool = F.array_union(pool, numbers(other))
    return F.size(F.array_except(numbers(candidate), pool)) == 0
