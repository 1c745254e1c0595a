"""Column expressions over text. All of them stay in the JVM.

Texts may be null (results are null, or empty arrays where stated), empty or
long. Patterns avoid word boundaries and case flags, whose meaning differs for
letters beyond ASCII; they work on lower-cased text with explicit classes.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.session import map_batches


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters; made by rule from the Unicode tables."""
    marked = [chr(p) for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in marked if c.islower() and len(unicodedata.normalize("NFD", c)) > 1]
    pairs.append(("đ", "d"))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASE = _accents()
#: The same in upper case.
UPPER = tuple("".join(x) for x in zip(*{c.upper(): b.upper() for c, b in zip(MARKED, BASE) if len(c.upper()) == 1 and c.upper() not in MARKED}.items()))
LETTERS = "a-zà-ỹđ"

# The token pattern (document numbers, dotted numbers, percentages, words).
TOKEN = r"[a-zà-ỹ0-9]+(?:/[a-zà-ỹ0-9\-_]+)+|\d+(?:\.\d+)+|\d+(?:[.,]\d+)?%|[a-zà-ỹ0-9_]+"
#: The same for the JVM, without going back over what a class has taken.
_TOKEN = r"[a-zà-ỹ0-9]++(?:/[a-zà-ỹ0-9\-_]++)++|\d++(?:\.\d++)++|\d++(?:[.,]\d++)?+%|[a-zà-ỹ0-9_]++"
# Units whose number is also one token.
UNITS = ("điều", "khoản")


def fold(text: Column) -> Column:
    """Lower case without accents; composed and decomposed input give the same."""
    return F.translate(F.regexp_replace(F.lower(text), "[̀-ͯ]", ""), MARKED, BASE)


def search_key(text: Column) -> Column:
    """Folded letters and digits, blanks squeezed."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def normalize_query(text: Column) -> Column:
    """Blanks of any kind squeezed, outer punctuation gone; null becomes empty."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s    ​‎‏﻿]+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, "[ ?!.,;:'\"`~]+$", ""), "^[ ?!.,;:'\"`~]+", "")


def tokens(text: Column) -> Column:
    """Tokens of the text in order; numbered articles and clauses come joined and apart. Null gives none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for unit in UNITS:
        low = F.regexp_replace(low, rf"(?<![a-zà-ỹ0-9_]){unit}\s++(\d++)", rf"{unit}_$1 {unit} $1")
    return F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def diacritic_ratio(text: Column) -> Column:
    """Share of marked letters among letters; null for a text without letters."""
    low = F.lower(text)
    letters = F.length(F.regexp_replace(low, "[^a-zà-ỹđ]", ""))
    marked = F.length(F.regexp_replace(low, "[^à-ỹđ]", ""))
    return F.when(letters > 0, marked / letters)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("int")


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules applied one after the other to the lower-cased text, whole words only."""
    out = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    for old, new in rules:
        out = F.regexp_replace(out, rf"(^|[^{LETTERS}0-9_]){old}($|[^{LETTERS}0-9_])", rf"$1{new}$2")
    return F.trim(out)


def expand(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The text with the expansion of every rule whose trigger it holds, each once, in the rules' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    extra = [F.when(contains_any(low, triggers) & ~F.contains(low, F.lit(more)), F.lit(more)) for triggers, more in rules]
    return F.concat_ws(" ", text, F.array_join(F.array_distinct(F.array_compact(F.array(*extra))), " "))


def article_labels(text: Column) -> Column:
    """Distinct article numbers a text names, in order of first mention."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"điều\s+(\d+[a-zđ]?)"), F.lit(1)))


def clip(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last of them an ellipsis if anything was cut."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…")))


def csv_safe(text: Column) -> Column:
    """A value that a spreadsheet won't take for a formula."""
    return F.when(F.regexp_replace(text, r"^[\s ]+", "").rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def sanitized(text: Column, allowed: str = "A-Za-z0-9_ .:#/-") -> Column:
    """Only the allowed characters of a graph parameter."""
    return F.regexp_replace(text, f"[^{allowed}]", "")


def read_only(query: Column) -> Column:
    """Whether a graph query only reads."""
    return ~F.upper(query).rlike(r"(^|[^A-Z])(CREATE|MERGE|DELETE|SET|REMOVE|DROP|CALL|LOAD)([^A-Z]|$)")


def stripped(text: Column) -> Column:
    """Without accents, the case kept; composed and decomposed input give the same."""
    return F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), MARKED + UPPER[0], BASE + UPPER[1])


def mapped(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The text with the words of every rule whose phrase it holds, each word once, in the rules' order; null stays null."""
    hits = F.array_compact(F.array(*[F.when(contains_any(text, phrases), F.lit(more)) for phrases, more in rules]))
    words = F.array_distinct(F.filter(F.split(F.array_join(hits, " "), " "), lambda w: w != ""))
    return F.when(F.size(words) > 0, F.trim(F.concat(text, F.lit(" "), F.array_join(words, " ")))).otherwise(text)


def replaced_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The patterns replaced one after the other."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


class _Compose:
    def __call__(self, batch):
        return {"row_id": batch["row_id"], "text": [None if x is None else unicodedata.normalize("NFC", x) for x in batch["text"]]}


def composed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, text) in NFC, which no built-in gives; texts of the basic range never leave the JVM."""
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    plain = F.coalesce(F.col("text").rlike("^[\\x00-\\x{2ff}]*$"), F.lit(True))
    return rows.where(plain).unionByName(map_batches(rows.where(~plain), _Compose(), "row_id bigint, text string"))


def file_size(size: Column) -> Column:
    """Bytes, kilobytes or megabytes with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.round(size / 1024, 1).cast("decimal(18,1)").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.round(size / 1048576, 1).cast("decimal(18,1)").cast("string"), F.lit(" MB")))
    )


def title_of(text: Column, words: int = 6) -> Column:
    """The first words of a normalised text as a conversation's title."""
    parts = F.split(normalize_query(text), " ")
    short = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(short, F.lit("…"))).otherwise(short)


def sql_fold(column: str) -> str:
    """``fold`` in DuckDB's SQL."""
    return f"translate(regexp_replace(lower({column}), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '{MARKED}', '{BASE}')"


def sql_tokens(column: str) -> str:
    """``tokens`` in DuckDB's SQL."""
    low = f"lower(coalesce({column}, ''))"
    for unit in UNITS:
        low = f"regexp_replace({low}, '(^|[^a-zà-ỹ0-9_]){unit}\\s+(\\d+)', '\\1{unit}_\\2 {unit} \\2', 'g')"
    return f"regexp_extract_all({low}, '{TOKEN}')"


def sql_normalize_query(column: str) -> str:
    blanks = "[\\s\\x{a0}\\x{2007}\\x{2009}\\x{202f}\\x{200b}\\x{200e}\\x{200f}\\x{feff}]+"
    edge = "[ ?!.,;:''\"`~]+"
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '{blanks}', ' ', 'g'), '{edge}$', ''), '^{edge}', '')"


def sql_contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + ")"
