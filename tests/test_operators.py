"""Operators of the core on small fixtures with known results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from verdigris.functions import text as t
from verdigris.operators import admin, datasets, evidence, graph, history, index, metrics, prefix, retrieve, structure, timeline


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens_keep_numbers_whole(spark):
    text = "Theo 145/2020/NĐ-CP và 293/2025/NĐ-CP, Điều 25 khoản 1: 5.310.000 và 150%"
    got = one(spark, t.tokens(F.col("s")), s=text)
    for token in ["145/2020/nđ-cp", "293/2025/nđ-cp", "điều_25", "khoản_1", "điều", "25", "5.310.000", "150%"]:
        assert token in got
    assert one(spark, t.tokens(F.col("s")), s=None) == [] and one(spark, t.tokens(F.col("s")), s="") == []


def test_fold_ignores_composition(spark):
    assert one(spark, t.search_key(F.col("s")), s="Đường  Tiê´ng".replace("´", "́")) == "duong tieng"


def test_csv_guard(spark):
    assert one(spark, t.csv_safe(F.col("s")), s=" \t=HYPERLINK(1)") == "' \t=HYPERLINK(1)"
    assert one(spark, t.csv_safe(F.col("s")), s="a=b") == "a=b" and one(spark, t.csv_safe(F.col("s")), s=None) is None


def test_rewrite_whole_words_only(spark):
    assert one(spark, t.rewrite(F.col("s"), [("cty", "công ty")]), s="Cty abc ctyx") == "công ty abc ctyx"


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query int, key string, rank int")


def test_fusion_order_of_ties(spark):
    a = ranking(spark, [(1, "A", 1), (1, "B", 2), (1, "C", 3)])
    b = ranking(spark, [(1, "B", 1), (1, "A", 2), (1, "D", 3)])
    out = retrieve.fuse(a, b, 4).orderBy("rank").collect()
    assert [r.key for r in out] == ["A", "B", "C", "D"]
    assert abs(out[0].score - 0.0325225) < 1e-6 and out[0].score == out[1].score and abs(out[2].score - 1 / 63) < 1e-9


def test_bm25_ranks_the_chunk_that_holds_more(spark):
    chunks = spark.createDataFrame([(1, "lương tối thiểu vùng"), (2, "lương lương lương"), (3, "nghỉ phép"), (4, None), (5, "")], "id int, body string")
    q = spark.createDataFrame([(7, "lương vùng")], "query int, text string")
    made = index.Index(chunks, "id", "body")
    assert [r.key for r in retrieve.bm25(q, made).orderBy("rank").collect()] == [1, 2]
    assert [r.key for r in retrieve.overlap(q, made).orderBy("rank").collect()] == [1, 2]


def test_cosine_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key int, vector array<double>")
    q = df.where("key % 10 = 0").select(F.col("key").alias("query"), "vector")
    got = retrieve.cosine_top_k(q, df, k=5, block=7).collect()
    for query in range(0, 60, 10):
        s = np.round(v @ v[query], 6)
        want = np.lexsort((np.arange(60), -s))[:5].tolist()
        assert [r.key for r in sorted(got, key=lambda r: r.rank) if r.query == query] == want


def test_metrics_of_one_query(spark):
    gold = spark.createDataFrame([(1, "a", True), (2, "a", False)], "query int, kind string, s boolean")
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "query int, rank int, relevant boolean")
    r = {x.kind: x for x in metrics.by_type(metrics.per_query(gold, ranked, F.col("s")), "kind").collect()}
    assert r["ALL"].hit_1 == 0 and r["ALL"].hit_3 == 1 and r["ALL"].mrr == 0.5 and r["a"].n == 2 and r["a"].n_scorable == 1


def test_order_statistic(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(101)] + [("b", 5.0), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: r.x for r in metrics.order_statistic(df, "g", "v", 0.95, "x").collect()}
    assert got == {"a": sorted(float(i % 7) for i in range(101))[95], "b": 5.0}


def test_running_total_over_buckets(spark):
    rows = [(g, i // 3, i, i % 4) for g in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "g string, bucket int, i int, v int")
    got = {(r.g, r.i): r.total for r in prefix.running_total(df, ["g"], "bucket", [F.col("i")], "v", "total").collect()}
    assert all(got[("a", i)] == sum(k % 4 for k in range(i)) for i in range(20))


def test_budget_keeps_first_two(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 900), (1, 3, 10), (2, 1, 10), (2, 2, 10), (2, 3, 2000), (2, 4, 1)], "o int, position int, n int")
    kept = {(r.o, r.position) for r in evidence.within_budget(df, "o", "position", F.col("n"), 1500).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_empty_constraint_never_fires(spark):
    df = spark.createDataFrame([(1, "tai nạn bồi thường"), (2, None)], "k int, s string")
    rules = [{"name": "x", "priority": 1, "all": [["tai nạn"], ["bồi thường"]]}, {"name": "y", "priority": 0, "all": []}]
    assert [(r.k, r.rule) for r in evidence.plan_constraints(df, "k", "s", rules).collect()] == [(1, "x")]


def test_graph_steps(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "src string, dst string, n_mentions int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    both = sorted(r.node for r in graph.step(seeds, e, "both").collect())
    assert both == ["b", "c"] and [r.node for r in graph.step(seeds, e, "out").collect()] == ["b"]
    mined = graph.mined(spark.createDataFrame([("1/2020/NĐ-CP", "xem 1/2020/NĐ-CP và 45/2019/QH14"), (None, "x")], "d string, s string"), "d", "s").collect()
    assert [(r.src, r.dst) for r in mined] == [("1/2020/NĐ-CP", "45/2019/QH14")]


def test_pages_to_chunks(spark):
    text = "Mở đầu\nChương 1. Quy định\nĐiều 25. Thử việc\n1. Khoản một.\n2. Khoản hai:\na) điểm a;\n\nb) điểm b.\nĐiều 26. Lương\nNội dung.\nĐiều 25. Lặp lại"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    got = [r.chunk_id for r in structure.chunks(structure.lines(df, "doc", "text"), "doc").where("doc = 1").orderBy("chunk_no").collect()]
    assert got == ["1#preamble", "1#c1", "1#c1-d25", "1#c1-d25-k1", "1#c1-d25-k2", "1#c1-d25-k2-a", "1#c1-d25-k2-b", "1#c1-d26", "1#c1-d25-2"]


def test_unwrap(spark):
    df = spark.createDataFrame([(1, "theo khoản\n3 Điều 2 thì\nthôi.\n- mục"), (2, None)], "k int, s string")
    got = {r.k: r.text for r in structure.unwrapped(df, "k", "s").collect()}
    assert got == {1: "theo khoản 3 Điều 2 thì thôi.\n- mục", 2: ""}


def test_local_days(spark):
    stamps = ["2026-10-23 16:59:59", "2026-10-23 17:00:00", "2026-10-24 16:59:59", "2026-10-24 17:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    inside = [r.ok for r in df.select(admin.day_range("ts", "2026-10-24", "2026-10-24").alias("ok")).collect()]
    assert inside == [False, True, True, False]


def test_upsert_and_audit(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, t int")
    merged = admin.upsert(old, new, ["k"], ["t"])
    assert sorted((r.k, r.v) for r in merged.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    log = sorted((r.k, r.action, r.before, r.after) for r in admin.audit(old, merged, "k", ["v"]).collect())
    assert log == [(2, "update", "b", "c"), (3, "insert", None, "d")]


def test_changes_of_generations(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1"), ("c", None, "1"), ("d", "q", "1")], "k string, s string, m string")
    new = spark.createDataFrame([("b", "z", "1"), ("c", None, "2"), ("d", "q", "1"), ("e", "w", "1")], "k string, s string, m string")
    assert {r.k: r.change for r in index.changes(old, new, "k", "s", ["m"]).collect()} == {"a": "removed", "b": "text", "c": "metadata", "d": "same", "e": "added"}


def test_facts_last_writer_wins(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"a": "z", "b": None}), (2, 1, None)], "c int, n int, facts map<string,string>")
    assert {(r.c, r.fact): r.value for r in history.last_facts(df, "c", "facts", ["n"]).collect()} == {(1, "a"): "z", (1, "b"): "y"}


def test_split_is_stable(spark):
    df = spark.range(2000)
    s = datasets.split(df, "id", 0.1)
    assert 140 < s.where("split = 'val'").count() < 260
    assert s.repartition(7).where("split = 'val'").agg(F.sum("id")).first() == s.where("split = 'val'").agg(F.sum("id")).first()


def test_as_of_takes_equal_times(spark):
    t0 = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, 9, t0), (2, 9, t0 - timedelta(hours=1))], "e int, u int, ts timestamp")
    right = spark.createDataFrame([(3, 9, t0, 5.0), (4, 9, t0 - timedelta(minutes=5), 4.0)], "e int, u int, ts timestamp, v double")
    got = {r.e: r.as_of for r in timeline.as_of(left, right, "u", "ts", "v", "e").collect()}
    assert got == {1: 5.0, 2: None}


def test_accents_restored_on_unseen_texts(spark):
    import random

    from verdigris.operators import restore

    rng = random.Random(8)
    who = ["người lao động", "nhà máy", "kế toán viên", "lao động thời vụ", "phòng nhân sự"]
    what = ["phải nộp bảng chấm công", "được hưởng phụ cấp ca đêm", "không được khấu trừ lương", "phải ký lại hợp đồng"]
    when = ["trong vòng mười ngày", "sau khi thử việc", "trước ngày nghỉ phép"]
    made = [f"{rng.choice(who)} {rng.choice(what)} {rng.choice(when)}".capitalize() for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(made[:150])] + [(900, None), (901, "")], "id int, body string")
    known = restore.dictionary(df, "body")
    bare = spark.createDataFrame([(i, s) for i, s in enumerate(made[150:])], "row_id bigint, text string").withColumn("text", F.translate("text", t.MARKED + t.MARKED.upper(), t.BASE + t.BASE.upper()))
    out = {r.row_id: r.text for r in restore.restored(bare, known).collect()}
    assert sum(out[i] == s for i, s in enumerate(made[150:])) >= 45
    other = spark.createDataFrame([(1, "The worker may ask for overtime pay under the contract."), (2, None), (3, "")], "row_id bigint, text string")
    assert {r.row_id: r.text for r in restore.restored(other, known).collect()} == {1: "The worker may ask for overtime pay under the contract.", 2: None, 3: ""}


def test_rules(spark):
    from verdigris.operators import rules

    table = [{"name": "a", "any": ["tai nạn"], "none": ["xe"]}, {"name": "b", "any": ["tai"]}]
    assert one(spark, rules.first_match(F.col("s"), table, "z"), s="Tai nạn xe") == "b"
    assert one(spark, rules.labels(F.col("s"), table), s="Tai nạn") == ["a", "b"] and one(spark, rules.first_match(F.col("s"), table, "z"), s=None) == "z"
    assert one(spark, rules.remainder(F.col("s"), ["cam on", "chao ban"]), s="Chào bạn, cảm ơn nhé!") == "nhe"
    assert one(spark, rules.numbers_kept(F.col("a"), F.col("b")), a="12 ngày, 5 giờ", b="5 và 12") and not one(spark, rules.numbers_kept(F.col("a"), F.col("b")), a="13", b="12")


def test_blocks_give_exact_sums(spark):
    import random

    rng = random.Random(9)
    terms = [(q, f"t{i}", rng.randint(1, 3)) for q in range(20) for i in rng.sample(range(40), 8)]
    parts = [(k, f"t{i}", rng.randint(1, 9)) for k in range(300) for i in rng.sample(range(40), 6)]
    got = {}
    for r in retrieve.sparse_top_k(spark.createDataFrame(terms, "query int, term string, weight int"), spark.createDataFrame(parts, "key int, term string, part int"), 5).collect():
        got.setdefault(r.query, []).append((r.rank, r.key, r.total))
    for query in range(20):
        totals = {}
        for k, t1, p in parts:
            for q, t2, w in terms:
                if q == query and t1 == t2:
                    totals[k] = totals.get(k, 0) + w * p
        want = sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(k, t) for _, k, t in sorted(got[query])] == want


def test_most_frequent_is_bounded(spark):
    df = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"), (F.col("id") % 100).alias("n"))
    kept = prefix.most_frequent(df, "w", "n", 512, buckets=64)
    assert 64 <= kept.count() <= 512 and kept.agg(F.min("n")).first()[0] > 50
