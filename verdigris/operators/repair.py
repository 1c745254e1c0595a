"""Damaged JSON made readable (T24).

The first balanced object or array is looked for, with quoted text passed over;
where the text breaks off, what is open is closed: an unfinished string, open
brackets, and a key that a value was to follow; a key alone goes. Trailing commas go. Repeated keys keep the
last value.

Defined results: null, blank and texts without a bracket give no value and the
state ``none``; the others are ``whole``, ``cut out`` of surrounding text,
``repaired``, or ``broken`` where nothing helps.
"""

from __future__ import annotations

import json

import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import map_batches

_comma = regex.compile(r",(?=\s*[}\]])")
_half_pair = regex.compile(r'(?:,\s*|(?<=\{)\s*)"(?:[^"\\]|\\.)*"\s*:?\s*$')
_half_value = regex.compile(r"(?<=[:,\[\s])(?:t(?:r(?:u)?)?|f(?:a(?:l(?:s)?)?)?|n(?:u(?:l)?)?|-|\d+[.eE]|\d+[eE][+-])$")


def balanced(text: str):
    """(begin, end or None, open brackets, whether a string is open) of the first object or array."""
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    opened, quoted, skip = [], False, False
    for i in range(begin, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            if c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            opened.append("}" if c == "{" else "]")
        elif c in "}]":
            if not opened or opened.pop() != c:
                return begin, None, None, False
            if not opened:
                return begin, i + 1, [], False
    return begin, None, opened, quoted


def _read(text: str):
    try:
        return json.loads(text), True
    except (ValueError, RecursionError):
        return None, False


def repaired(text: str):
    """(state, value) of a text."""
    if text is None or not text.strip():
        return "none", None
    value, ok = _read(text)
    if ok:
        return "whole", value
    found = balanced(text)
    if found is None:
        return "none", None
    begin, end, opened, quoted = found
    if end is not None:
        part = text[begin:end]
        value, ok = _read(part)
        if ok:
            return "cut out", value
        value, ok = _read(_comma.sub("", part))
        return ("repaired", value) if ok else ("broken", None)
    if opened is None:
        return "broken", None
    part = text[begin:].rstrip()
    if quoted:
        part = (part[:-1] if part.endswith("\\") else part) + '"'
    closing = "".join(reversed(opened))
    for tried in (part, _half_value.sub("null", part), part + " null", _half_pair.sub("", part)):
        value, ok = _read(_comma.sub("", tried.rstrip().rstrip(",") + closing))
        if ok:
            return "repaired", value
    return "broken", None


class _Repair:
    def __call__(self, batch):
        out: dict = {"row_id": batch["row_id"], "state": [], "json": []}
        for text in batch["text"]:
            state, value = repaired(text)
            out["state"].append(state)
            out["json"].append(None if state in ("none", "broken") else json.dumps(value, ensure_ascii=False, sort_keys=True))
        return out


def repaired_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, state, json): every text with what could be read of it. No shuffle."""
    return map_batches(df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")), _Repair(), "row_id bigint, state string, json string")
