"""Nested records to flat related tables by interval labels.

A depth-first walk numbers every node of a record: ``pre`` when it is entered,
``post`` (the last ``pre`` below it) when it is left. Node A encloses node B of
the same record exactly when ``A.pre < B.pre <= A.post``, so any ancestor link
is an interval containment and no path has to be carried along. While a record
is walked, the intervals still open at a node are those that contain it: the
innermost one is its parent, which each node carries as its key (``parent_pre``)
and place. ``contained_in`` finds the same links between written tables.

Defined results: a null, empty or incomplete JSON text gives no nodes; a text
that is itself an encoded string is decoded up to ``DECODE`` times, wherever it
holds an object or array; a byte order mark is ignored; a member that is a
single object where others send an array counts as an array of one; null
elements keep their place. Repeated keys keep the last value, as JSON readers
do. Rows with a null record id keep it (they link to no other record).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.session import map_batches

#: How often a text may be wrapped in another JSON string.
DECODE = 3

NODE = (
    "record_id bigint, node_type string, pre int, post int, level int, pos int, kind string, value string, "
    "parent_type string, parent_pre int, parent_pos int"
)


def decode(text):
    """The parsed JSON text, or None where it isn't complete JSON."""
    value = text
    for _ in range(DECODE):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value.lstrip("﻿"))
        except (ValueError, RecursionError):
            return None
    return value


def _unwrap(value):
    """An object or array that travels as text inside the record."""
    if isinstance(value, str):
        head = value.lstrip("﻿ \t\r\n")[:1]
        if head in ("{", "[", '"'):
            inner = decode(value)
            if isinstance(inner, (dict, list)):
                return inner
    return value


def _scalar(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return repr(value) if isinstance(value, float) else str(value)


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "text", dict: "object", list: "array"}[type(value)]


def label(record, wanted: frozenset) -> list:
    """(type, pre, post, level, place, kind, value) of the nodes of one parsed record whose type is in ``wanted``."""
    return [node[:7] for node in linked(record, wanted)]


def linked(record, wanted: frozenset, within: str | None = None) -> list:
    """``label``'s nodes, each with its parent's type, number and place.

    The parent is the innermost open node of the wanted types, or of the type
    ``within``; its type, number and place are null without one.

    The type of a member is its key; of an array element, the key of its array
    followed by ``[]``; of a member of such an element, both joined by a point
    (``issues[]``, ``retrieved_top_k[].chunk_id``). Places count from 1. An
    explicit stack keeps deep records from exhausting Python's.
    """
    nodes, counter, opens = [], 0, []
    # (value, type, level, place, index of its open node or None while entering)
    stack = [(record, "", 0, 1, None)]
    while stack:
        value, kind, level, pos, opened = stack.pop()
        if opened is not None:
            if opened >= 0:
                nodes[opened][2] = counter
                if opens and opens[-1] == opened:
                    opens.pop()
            continue
        counter += 1
        at = -1
        if kind in wanted:
            at = len(nodes)
            parent = nodes[opens[-1]] if opens else (None,) * 5
            nodes.append([kind, counter, counter, level, pos, _kind(value), _scalar(value), parent[0], parent[1], parent[4]])
            if isinstance(value, (dict, list)) and (within is None or kind == within):
                opens.append(at)
        if not isinstance(value, (dict, list)):
            continue
        stack.append((None, kind, level, pos, at))
        if isinstance(value, dict):
            for key, member in reversed(value.items()):
                member = _unwrap(member)
                base = key
                if f"{base}[]" in wanted or any(w.startswith(f"{base}[].") for w in wanted):
                    if isinstance(member, dict):
                        member = [member]
                name = f"{kind}.{key}" if kind.endswith("[]") and f"{kind}.{key}" in wanted else key
                stack.append((member, name, level + 1, pos, None))
        else:
            for place in range(len(value), 0, -1):
                stack.append((_unwrap(value[place - 1]), f"{kind}[]", level + 1, place, None))
    return nodes


class _Label:
    def __init__(self, wanted, within):
        self.wanted, self.within = frozenset(wanted), within

    def __call__(self, batch):
        names = [c.split()[0] for c in NODE.split(", ")]
        out = {k: [] for k in names}
        for record_id, text in zip(batch["record_id"], batch["json"]):
            record = decode(text) if text else None
            if not isinstance(record, (dict, list)):
                continue
            for node in linked(record, self.wanted, self.within):
                out["record_id"].append(record_id)
                for name, value in zip(names[1:], node):
                    out[name].append(value)
        return out


def interval_nodes(df: DataFrame, id_column: str, json_column: str, types: list[str], within: str | None = None) -> DataFrame:
    """One pass over the records, without a shuffle; one row per node of the wanted types, with its parent's key and place."""
    records = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(json_column).alias("json"))
    return map_batches(records.where(F.col("json").isNotNull()), _Label(types, within), NODE)


def node_table(nodes: DataFrame, node_type: str) -> DataFrame:
    """The flat table of one node type, with its interval as key."""
    return nodes.where(F.col("node_type") == node_type).drop("node_type")


def contained_in(children: DataFrame, ancestors: DataFrame, prefix: str = "parent_") -> DataFrame:
    """Each child with its nearest ancestor row, by containment; null columns if there is none.

    Works on written node tables, where ancestors may nest in one another.
    """
    a = ancestors.select(*[F.col(c).alias(prefix + c) for c in ancestors.columns])
    children = children.drop(*a.columns)
    joined = children.join(
        a,
        (F.col("record_id") == F.col(f"{prefix}record_id"))
        & (F.col("pre") > F.col(f"{prefix}pre"))
        & (F.col("pre") <= F.col(f"{prefix}post")),
        "left",
    )
    nearest = Window.partitionBy("record_id", "pre").orderBy(F.col(f"{prefix}pre").desc_nulls_last())
    return joined.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").drop("_n")


def place_within(nodes: DataFrame, ancestor_type: str) -> DataFrame:
    """Written nodes with ``parent_pos``: the place of the innermost node of ``ancestor_type`` that contains them, 0 without one.

    The nodes of a record meet in one window, which holds its ancestors; records
    are spread by hash. ``interval_nodes`` links without a shuffle.
    """
    seen = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.collect_list(F.when(F.col("node_type") == ancestor_type, F.struct("post", "pos"))).over(seen)
    around = F.filter(begun, lambda a: a["post"] >= F.col("pre"))
    return nodes.withColumn("parent_pos", F.when(F.size(around) > 0, F.element_at(around, -1)["pos"]).otherwise(F.lit(0)))
