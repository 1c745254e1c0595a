"""Operators of the second round: caches, joins in time, the lasting index, dense vectors, repairs, files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import encode
from verdigris.functions import text as t
from verdigris.operators import graph, history, index, metrics, repair, restore, retrieve, structure, timeline
from verdigris import session
from verdigris.sources import files

NOON = dt.datetime(2031, 1, 1, 12)


def asks(spark, rows):
    return spark.createDataFrame(rows, "id bigint, q string, at timestamp")


def test_cache_counts_from_the_store(spark):
    rows = [(i, "a", NOON + dt.timedelta(hours=h)) for i, h in enumerate((0, 5, 10, 11, 16.5))] + [(9, "b", None), (10, None, NOON)]
    got = {r.id: r.hit for r in history.cache_hits(asks(spark, rows), F.coalesce("q", F.lit("")), "at", ["at", "id"]).collect()}
    # 10 h is past the time to live of the ask at 0 h, though not of the hit at 5 h.
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 9: False, 10: False}
    assert history.cache_hits(asks(spark, rows).limit(0), F.col("q"), "at", ["at", "id"]).count() == 0


def test_frequent_keys_jump_to_the_same_hits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), NOON + dt.timedelta(minutes=rng.choice([rng.randint(0, 9000), 720 * rng.randint(0, 9)]))) for i in range(150)]
    df = asks(spark, rows).withColumn("_ts", F.lit("clash")).withColumn("hit", F.lit("clash"))
    walked = {r.id: r.hit for r in history.cache_hits(df, F.col("q"), "at", ["at", "id"]).collect()}
    jumped = {r.id: r.hit for r in history.cache_hits(df, F.col("q"), "at", ["at", "id"], walked=0).collect()}
    stored, want = {}, {}
    for i, q, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = q in stored and at - stored[q] <= dt.timedelta(hours=6)
        if not want[i]:
            stored[q] = at
    assert walked == want and jumped == want and True in want.values()


def test_as_of_over_many_spans(spark):
    rng = random.Random(4)
    moment = lambda: NOON + dt.timedelta(hours=rng.randint(0, 400))
    left = [(i, rng.choice("ab"), moment()) for i in range(60)] + [(99, "a", None), (98, None, NOON)]
    right = [(i, rng.choice("ab"), moment(), i * 1.5) for i in range(15)] + [(50, "a", None, 9.0), (51, "a", NOON, None)]
    l, r = spark.createDataFrame(left, "id bigint, k string, at timestamp"), spark.createDataFrame(right, "id bigint, k string, at timestamp, v double")  # noqa: E741
    want = {}
    for i, k, at in left:
        before = [(b, j, v) for j, m, b, v in right if m == k and b is not None and at is not None and b <= at and v is not None]
        want[i] = max(before)[2] if before else None
    assert {x.id: x.as_of for x in timeline.as_of(l, r, "k", "at", "v", "id").collect()} == want


def test_index_outlives_its_object_and_knows_its_content(spark, tmp_path):
    rows = [(i, f"điều {i % 7} lương {'nghỉ ' * (i % 3)}") for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumn("term", F.lit("clash"))
    first = index.Index(df, "id", "body", str(tmp_path))
    stamp = max(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet"))
    again = index.Index(df.orderBy(F.desc("id")), "id", "body", str(tmp_path))
    assert again.path == first.path and max(p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")) == stamp and again.n == 60
    other = index.Index(df.where("id <> 3"), "id", "body", str(tmp_path))
    assert other.path != first.path and other.n == 59
    empty = index.Index(df.limit(0), "id", "body", str(tmp_path))
    assert empty.n == 0 and retrieve.bm25(spark.createDataFrame([(1, "lương")], "query bigint, text string"), empty).count() == 0


def test_bm25_against_brute_force(spark, tmp_path, monkeypatch):
    import math

    rng = random.Random(6)
    words = ["lương", "nghỉ", "phép", "thưởng", "12/2019/nđ-cp", "ca"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(200)] + [(900, None), (901, "phép " * 300)]
    queries = [(q, " ".join(rng.choices(words + ["lạ"], k=4))) for q in range(7)] + [(50, ""), (51, None)]
    monkeypatch.setattr(session, "BATCH_ROWS", 16)  # several blocks
    held = index.Index(spark.createDataFrame(rows, "id bigint, body string"), "id", "body", str(tmp_path))
    asked = spark.createDataFrame(queries, "query bigint, text string")
    texts = {i: s.split() for i, s in rows if s}
    n, avgdl = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in s for s in texts.values()) for w in words}
    want = {}
    for q, text in queries:
        scores = {}
        for i, s in texts.items():
            parts = [round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * s.count(w) * 2.5 / (s.count(w) + 1.5 * (0.25 + 0.75 * len(s) / avgdl)), 8) for w in (text or "").split() if w in s]
            if parts:
                scores[i] = round(sum(parts), 8)
        for rank, (score, i) in enumerate(sorted((-v, i) for i, v in scores.items())[:5], 1):
            want[q, rank] = (i, -score)
    for passes in (200_000, 5):  # all queries together, and in several passes
        monkeypatch.setattr(retrieve, "QUERY_TERMS", passes)
        got = {(r.query, r.rank): (r.key, float(r.score)) for r in retrieve.bm25(asked, held, 5).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-7 for k in want)


def test_changes_applied_give_the_new_generation(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], "k string, s string, m int")
    new = spark.createDataFrame([("b", "y", 1), ("c", "z", 2), ("d", None, 1)], "k string, s string, m int")
    got = {(r.k, r.s, r.m, r.kept) for r in index.apply_changes(old, new, "k", "s", ["m"]).collect()}
    assert got == {("b", "y", 1, True), ("c", "z", 2, False), ("d", None, 1, False)}
    assert [r.is_valid for r in index.validity(old, new, "k", "s").collect()] == [False] and index.validity(old, old, "k", "s").first().is_valid


def test_dense_vectors(spark):
    df = spark.createDataFrame([(1, "lương tháng"), (2, "tháng lương"), (3, None), (4, ""), (5, "nghỉ phép năm"), (5, "nghỉ phép năm")], "id bigint, s string").withColumn("vector", F.lit("clash"))
    got = {}
    for r in encode.encoded(df, "id", "s").collect():
        got.setdefault(r.key, []).append(r.vector)
    assert got.keys() == {1, 2, 5} and got[1] == got[2] and len(got[5]) == 2
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for vs in got.values() for v in vs)


def test_one_arm_keeps_its_order(spark):
    a = spark.createDataFrame([(1, k, r) for r, k in enumerate((7, 3, 9), 1)], "query int, key int, rank int")
    assert [r.key for r in retrieve.fuse_available([None, a]).orderBy("rank").collect()] == [7, 3, 9]
    with pytest.raises(ValueError):
        retrieve.fuse_available([None, None])


def test_recall_counts_parts_and_articles(spark):
    gold = spark.createDataFrame([(1, "x", ["A_1#d2-k1", "A_1#d3"]), (2, "x", ["B_1#d9"])], "query int, kind string, gold array<string>")
    held = spark.createDataFrame([(1, 1, "A_1#d2-k1-a"), (1, 7, "A_1#d3-k4")], "query int, rank int, chunk_id string")
    (r,) = metrics.recall_by(gold, held, "kind").collect()
    assert (r.n, r.recall_5, r.recall_10, r.chunk_recall_5, r.chunk_recall_10) == (2, 0.25, 0.5, 0.25, 0.5)


def test_branches_are_rows(spark):
    nodes = spark.createDataFrame([("n",), ("m",), ("n",)], "d string")
    e = spark.createDataFrame([("a", "n"), ("b", "n"), ("a", "n")], "src string, dst string")
    got = {(r.d, r.branch, r.src, r.n_branch) for r in graph.two_branches(nodes, "d", e, e.limit(0)).collect()}
    assert got == {("n", "guides", "a", 2), ("n", "guides", "b", 2), ("m", None, None, 0)}


def test_unwrapping_is_linear_and_keeps_rows(spark):
    long = "\n".join(["từ ngữ"] * 20_000)
    rows = [(1, "một \n hai\nBa.\nbốn\n- năm"), (1, "một \n hai"), (2, None), (3, ""), (4, "a\n\nb"), (5, long)]
    got = sorted((r.k, r.n_before, r.n_after, r.text) for r in structure.unwrapped(spark.createDataFrame(rows, "k bigint, s string").withColumn("text", F.lit("clash")), "k", "s").collect())
    assert [g[3] for g in got if g[0] == 1] == ["một hai", "một hai Ba.\nbốn\n- năm"] or [g[3] for g in got if g[0] == 1] == ["một hai Ba.\nbốn\n- năm", "một hai"]
    assert [g[1:] for g in got if g[0] in (2, 3)] == [(1, 1, "")] * 2 and [g[3] for g in got if g[0] == 4] == ["a\n\nb"] and [g[2] for g in got if g[0] == 5] == [1]


@pytest.mark.parametrize(
    "text, state, value",
    [
        (None, "none", None), ("  ", "none", None), ("chữ", "none", None), ('{"a": 1}', "whole", {"a": 1}), ('Đây: {"a": "}"} hết', "cut out", {"a": "}"}), ('{"a": [1, 2,],}', "repaired", {"a": [1, 2]}),
        ('{"a": {"b": "dở', "repaired", {"a": {"b": "dở"}}), ('{"a": 1, "b', "repaired", {"a": 1}), ('{"a": 1, "b":', "repaired", {"a": 1, "b": None}), ('{"a": tr', "repaired", {"a": None}), ('[1, {"x": 2}', "repaired", [1, {"x": 2}]),
        ('{"a": 1]', "broken", None), ('{"a": 1, "a": 2}', "whole", {"a": 2}),
    ],
)
def test_damaged_json(text, state, value):
    got = repair.repaired(text)
    assert got[0] == state and (state == "none" or got[1] == value)


def test_damaged_json_rows(spark):
    import json

    whole = json.dumps({"a": [{"b": "x\"y", "c": None}, 1.5], "d": {"e": "f"}})
    df = spark.createDataFrame([(i, whole[:i]) for i in range(1, len(whole) + 1)], "id bigint, s string").withColumn("state", F.lit(1))
    got = repair.repaired_json(df, "id", "s").collect()
    assert len(got) == len(whole) and all(r.state in ("repaired", "whole") for r in got) and repair.repaired_json(df.limit(0), "id", "s").count() == 0


def test_restoring_by_a_table_gives_what_a_dictionary_gives(spark):
    corpus = ["Người lao động được hưởng lương theo hợp đồng lao động"] * 3 + ["lao động nữ mang thai được nghỉ"] * 2 + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(corpus)], "id bigint, body string")
    bare = [(1, "Nguoi LAO DONG duoc huong luong theo hop dong lao dong"), (2, "Người lao động"), (3, None), (4, ""), (5, "the worker may ask for overtime pay"), (1, "lao dong nu mang thai duoc nghi phep"), (None, "nguoi lao dong duoc huong luong theo hop dong")]
    texts = spark.createDataFrame(bare, "row_id bigint, text string").withColumn("runs", F.lit("clash"))
    want = sorted(((r.row_id or 0, r.text) for r in restore.restored(texts, restore.dictionary(df, "body")).collect()), key=str)
    got = sorted(((r.row_id or 0, r.text) for r in restore.restored_by(texts, restore.entries(df, "body")).collect()), key=str)
    assert got == want and (1, "Người LAO ĐỘNG được hưởng lương theo hợp đồng lao động") in got
    with pytest.raises(ValueError):
        restore.dictionary(df, "body", 2)


def test_text_tools(spark):
    df = spark.createDataFrame([(1, "Nghỉ PHÉP Đúng"), (2, "Nghỉ phép"), (3, None), (4, "")], "id bigint, s string").withColumn("row_id", F.lit("clash"))
    assert {r.id: r.x for r in df.select("id", t.stripped(F.col("s")).alias("x")).collect()} == {1: "Nghi PHEP Dung", 2: "Nghi phep", 3: None, 4: ""}
    assert {r.row_id: r.text for r in t.composed(df, "id", "s").collect()} == {1: "Nghỉ PHÉP Đúng", 2: "Nghỉ phép", 3: None, 4: ""}
    rules = [(["nghỉ"], "nghỉ phép năm"), (["phép"], "phép năm hưởng lương")]
    assert {r.id: r.x for r in df.select("id", t.mapped(F.col("s"), rules).alias("x")).collect()}[1] == "Nghỉ PHÉP Đúng nghỉ phép năm hưởng lương"


def test_files_again(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit("ă"))
    path = str(tmp_path / "b")
    total = files.backup(df, path)
    assert files.restore_backup(spark, path, "id bigint, s string", total).count() == 5
    with pytest.raises(ValueError):
        files.restore_backup(spark, path, "id bigint, s string", "other")
    files.rewrite_json(spark.read.schema("id bigint, s string").json(path).where("id < 3"), path)
    assert spark.read.json(path).count() == 3
    assert [r.id for r in files.paged(df, ["id"], 1, 2).collect()] == [2, 3]
    files.metrics_csv(df, str(tmp_path / "m"), mark=True)
    assert files.csv(spark, str(tmp_path / "m")).columns == ["id", "s"]
    pages = spark.createDataFrame([(2, '<a href="?ItemID=7">hai</a>'), (1, '<a href="?ItemID=7"><b>một</b></a><a href="?ItemID=8">x</a>')], "page int, html string")
    assert {(r.item_id, r.title) for r in files.mined_links(pages, "html").collect()} == {("7", "một"), ("8", "x")}
    with pytest.raises(Exception):
        files.published(spark, str(tmp_path / "none"))


def test_percentiles_against_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 1.0, rng.uniform(-5, 900)])) for _ in range(400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("_n", F.lit(1))
    got = {r.g: (r.p50, r.p95) for r in metrics.percentiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        at = lambda p: (v[int((len(v) - 1) * p)] + (v[min(int((len(v) - 1) * p) + 1, len(v) - 1)] - v[int((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1))  # noqa: E731, B023
        want[g] = (at(0.5), at(0.95))
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_exact_split(spark):
    from verdigris.operators import datasets

    df = spark.createDataFrame([(f"k{i % 500}", i) for i in range(900)] + [(None, 1)], "k string, share int")
    out = datasets.split_exact(df, "k").where("split = 'val'")
    assert out.select("k").distinct().count() == 80 and out.where("k IS NULL").count() == 0
    assert datasets.split_exact(df.where("k IN ('k1', 'k2')"), "k").where("split = 'val'").count() == 0
    assert datasets.split_exact(df.limit(0), "k").count() == 0


def test_tables_and_graphs_are_merged(spark, tmp_path):
    from verdigris.sources import sinks

    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, gone boolean")
    sinks.upsert(rows(("a", 1, False), ("b", 1, None), (None, 1, False), ("a", 0, False)), path, ["k"], ["at"], "gone")
    sinks.upsert(rows(("b", 2, True), ("c", 2, False), ("a", 0, False)), path, ["k"], ["at"], "gone")
    assert sorted((r.k or "", r.at) for r in files.published(spark, path).collect()) == [("", 1), ("a", 1), ("c", 2)]
    nodes = spark.createDataFrame([("x", 1), ("y", 1), ("x", 2)], "id string, at int")
    edges = spark.createDataFrame([("x", "y", "r"), ("x", "y", "r")], "src string, dst string, relation string")
    for _ in range(2):
        sinks.write_graph(nodes, edges, str(tmp_path / "g"), "id", ["at"])
    n, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert sorted((r.id, r.at) for r in n.collect()) == [("x", 2), ("y", 1)] and e.count() == 1
