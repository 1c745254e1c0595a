"""Nested records: interval labels, links, amounts, and the edge cases of problem 1."""

import json

from pyspark.sql import functions as F

from verdigris.functions.money import amount_vnd
from verdigris.operators import nested
from verdigris.plans.nested_queries import HIT, ISSUE, SOURCE


def rows(df):
    return sorted((r.record_id, r.node_type, r.parent_pos, r.pos, r.value) for r in df.collect() if r.node_type != ISSUE)


def frame(spark, records):
    data = [(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(data, "raw_id bigint, payload string")


def located(spark, records):
    nodes = nested.interval_nodes(frame(spark, records), "raw_id", "payload", [HIT, SOURCE, ISSUE])
    return nested.place_within(nodes, ISSUE)


def brute(record):
    """Straight recursion as a second opinion."""
    found = []

    def walk(value, issue):
        if isinstance(value, dict):
            for k, v in value.items():
                if k in ("retrieved_top_k", "expected_evidence"):
                    member = "chunk_id" if k == "retrieved_top_k" else "doc_id"
                    for n, e in enumerate(v if isinstance(v, list) else [v], 1):
                        if isinstance(e, dict) and e.get(member) is not None:
                            found.append((k, issue, n, e[member]))
                elif k == "issues":
                    for n, e in enumerate(v, 1):
                        walk(e, n)
                else:
                    walk(v, issue)

    walk(record, 0)
    return sorted(found)


def test_links_agree_with_recursion(spark):
    records = [
        {"retrieved_top_k": [{"chunk_id": "a"}, None, {"chunk_id": None}, {"chunk_id": "b"}], "expected_evidence": [{"doc_id": "D"}, {}]},
        {"issues": [{"retrieved_top_k": [{"chunk_id": "c"}]}, {"retrieval": {"retrieved_top_k": [{"x": 1}, {"chunk_id": "d"}]}, "expected_evidence": []}, {}]},
        {"retrieved_top_k": {"chunk_id": "single"}, "issues": [{"expected_evidence": [{"doc_id": "E"}]}]},
    ]
    got = rows(located(spark, records))
    want = sorted(
        (i, {"retrieved_top_k": HIT, "expected_evidence": SOURCE}[k], issue, n, v) for i, r in enumerate(records) for k, issue, n, v in brute(r)
    )
    assert [g for g in got if g[4] is not None] == want


def test_encodings_and_broken_texts(spark):
    inner = {"retrieved_top_k": [{"chunk_id": "a"}]}
    records = [
        "﻿" + json.dumps(inner),
        json.dumps(json.dumps(inner)),
        json.dumps({"retrieved_top_k": json.dumps(inner["retrieved_top_k"])}),
        json.dumps(inner)[:-3],
        None,
        "",
        "null",
        "3",
    ]
    assert [r[0] for r in rows(located(spark, records))] == [0, 1, 2]


def test_containment_join_gives_the_same_links(spark):
    records = [{"issues": [{"retrieved_top_k": [{"chunk_id": "c"}, {"chunk_id": "d"}]}, {"retrieved_top_k": [{"chunk_id": "e"}]}], "retrieved_top_k": [{"chunk_id": "f"}]}]
    nodes = nested.interval_nodes(frame(spark, records), "raw_id", "payload", [HIT, ISSUE])
    joined = nested.contained_in(nested.node_table(nodes, HIT), nested.node_table(nodes, ISSUE))
    by_join = sorted((r.value, r.parent_pos or 0) for r in joined.collect())
    by_window = sorted((r.value, r.parent_pos) for r in nested.place_within(nodes, ISSUE).where(F.col("node_type") == HIT).collect())
    assert by_join == by_window == [("c", 1), ("d", 1), ("e", 2), ("f", 0)]


def test_intervals_nest(spark):
    nodes = nested.label({"a": {"b": [1, {"c": 2}]}}, frozenset(["a", "b", "b[]", "c"]))
    spans = {(kind, pos): (pre, post) for kind, pre, post, _, pos, _, _ in nodes}
    assert spans[("a", 1)][0] < spans[("b", 1)][0] < spans[("b[]", 1)][0] <= spans[("b[]", 1)][1] < spans[("b[]", 2)][0]
    assert spans[("c", 2)][1] <= spans[("a", 1)][1]


def test_empty_table_repeats_and_extra_columns(spark):
    empty = frame(spark, []).withColumn("record_id", F.lit("x")).withColumn("json", F.lit(1))
    assert nested.interval_nodes(empty, "raw_id", "payload", [HIT]).count() == 0
    twice = frame(spark, [{"retrieved_top_k": [{"chunk_id": "a"}]}] * 2).withColumn("pos", F.lit("clash"))
    assert nested.interval_nodes(twice, "raw_id", "payload", [HIT]).count() == 2


def test_deep_and_long_records(spark):
    deep = "".join('{"x":' for _ in range(200)) + '{"retrieved_top_k":[{"chunk_id":"z"}]}' + "}" * 200
    wide = {"retrieved_top_k": [{"chunk_id": str(i)} for i in range(5000)]}
    got = rows(located(spark, [deep, wide]))
    assert len(got) == 5001 and got[0][4] == "z"


def test_amounts(spark):
    cases = [
        ("number", "36100000.0", "36100000"), ("number", "43000000", "43000000"), ("text", "24.500.000", "24500000"), ("text", "20,1 triệu", "20100000"),
        ("text", "4 triệu", "4000000"), ("text", "15.500.000 đồng", "15500000"), ("object", '{"amount": 45.0, "unit": "triệu"}', "45000000"),
        ("object", '{"amount": 6100000, "currency": "VND"}', "6100000"), ("object", '{"amount": "6.100.000"}', "6100000"), ("text", "không rõ", None), ("null", None, None), ("object", "{}", None),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string")
    got = [r.x for r in df.select("i", amount_vnd(F.col("kind"), F.col("value")).alias("x")).orderBy("i").collect()]
    assert got == [w for _, _, w in cases]


def test_ancestors_that_nest_in_each_other(spark):
    inner = {"issues": [{"retrieved_top_k": [{"chunk_id": "a"}]}]}
    record = {"issues": [{}, {**inner, "retrieved_top_k": [{"chunk_id": "b"}]}], "retrieved_top_k": [{"chunk_id": "c"}]}
    nodes = nested.interval_nodes(frame(spark, [record]), "raw_id", "payload", [HIT, ISSUE], within=ISSUE)
    want = {"a": 1, "b": 2, "c": None}
    assert {r.value: r.parent_pos for r in nodes.where(F.col("node_type") == HIT).collect()} == want
    later = nested.place_within(nodes, ISSUE).where(F.col("node_type") == HIT)
    assert {r.value: r.parent_pos or None for r in later.collect()} == want
    joined = nested.contained_in(nested.node_table(nodes, HIT), nested.node_table(nodes, ISSUE)).collect()
    assert {r.value: r.parent_pos for r in joined} == want
    parents = {r.value: r.parent_pre for r in nodes.collect() if r.node_type == HIT}
    assert parents == {r.value: r.parent_pre for r in joined}
