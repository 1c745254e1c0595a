"""Amounts of money written as numbers, texts or objects, as whole VND.

Column expressions only; every branch stays in code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_factor(text: Column) -> Column:
    """The factor that a unit word in the text stands for, 1 without one."""
    low = F.lower(text)
    return (
        F.when(low.rlike("tỷ|tỉ|\\bty\\b|billion"), F.lit(1_000_000_000))
        .when(low.rlike("triệu|trieu|\\btr\\b|\\dtr|million"), F.lit(1_000_000))
        .when(low.rlike("nghìn|ngàn|nghin|ngan|\\bk\\b|\\dk\\b|thousand"), F.lit(1_000))
        .otherwise(F.lit(1))
        .cast("decimal(12,0)")
    )


def plain_number(text: Column) -> Column:
    """The first number of the text. A point or comma before exactly three digits,
    repeated or with no unit word, groups thousands; any other is decimal."""
    digits = F.regexp_extract(text, r"\d[\d.,\s ]*", 0)
    digits = F.regexp_replace(digits, r"[\s ]|[.,]+$", "")
    grouped = digits.rlike(r"^\d{1,3}([.,]\d{3})+$")
    both = digits.rlike(r"^\d{1,3}([.]\d{3})+,\d{1,2}$") | digits.rlike(r"^\d{1,3}(,\d{3})+[.]\d{1,2}$")
    whole = F.regexp_replace(digits, "[.,]", "")
    decimal_text = F.regexp_replace(digits, ",", ".")
    no_group = F.regexp_replace(F.regexp_replace(digits, r"[.,](?=\d{3})", ""), ",", ".")
    return F.when(both, no_group).when(grouped, whole).otherwise(decimal_text).try_cast("decimal(24,6)")


def amount_vnd(kind: Column, value: Column) -> Column:
    """Whole VND of a node's value, as digits; null where there is no amount.

    ``kind`` is the node's JSON kind. An object holds its number under amount
    or value and may name a unit; a number counts as VND.
    """
    inner = F.coalesce(F.get_json_object(value, "$.amount"), F.get_json_object(value, "$.value"))
    unit = F.coalesce(F.get_json_object(value, "$.unit"), F.lit(""))
    is_plain = inner.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    from_object = F.when(is_plain, inner.try_cast("decimal(24,6)")).otherwise(
        plain_number(inner) * unit_factor(inner)
    ) * F.when(is_plain | ~inner.rlike("(?i)[a-z]"), unit_factor(unit)).otherwise(F.lit(1).cast("decimal(12,0)"))
    amount = (
        F.when(kind == "number", value.try_cast("double").cast("decimal(24,6)"))
        .when(kind == "text", plain_number(value) * unit_factor(value))
        .when(kind == "object", from_object)
    )
    return F.round(amount, 0).cast("decimal(24,0)").cast("string")
