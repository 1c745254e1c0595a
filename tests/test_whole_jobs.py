"""Operators that once did less than their whole job, each on a fixture that showed it."""

from pyspark.sql import functions as F

from verdigris.operators import retrieve
from verdigris.operators.retrieve import top_k


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_near_questions_compares_every_stored_question(spark, monkeypatch):
    """30 long questions hold all tokens of the query; the nearest one holds a token less and comes last by key."""
    from verdigris.plans import retrieval_queries as r

    long = [(i, f"muc luong toi thieu vung hai nam nay va {' '.join(str(i * 7 + j) for j in range(20))}") for i in range(1, 31)]
    rows = [(50, "muc luong toi thieu vung hai nam nay"), *long, (99, "muc luong toi thieu vung hay nam nay"), (98, "xyz"), (97, "")]
    monkeypatch.setattr(r, "table", lambda *_: spark.createDataFrame(rows, "row_id bigint, question string"))
    (got,) = r.near_questions(spark, "").collect()
    assert (got.query, got.best, got.reason) == (50, 99, "accepted")


def test_nearest_texts_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["luong", "nghi", "viec", "hop", "dong", "thai", "san", "bao", "hiem"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 7))) for i in range(700)}
    asked = {i: texts[i] for i in range(0, 700, 50)}
    got = retrieve.nearest_texts(
        spark.createDataFrame(list(asked.items()), "query bigint, text string"), spark.createDataFrame(list(texts.items()), "key bigint, text string"), 2, 100
    )
    expected = set()
    for query, text in asked.items():
        scored = sorted((-round(1 - distance(text, other) / max(len(text), len(other), 1), 6), key) for key, other in texts.items() if key != query)
        expected |= {(query, key, rank + 1, -score) for rank, (score, key) in enumerate(scored[:2])}
    assert {(r.query, r.key, r.rank, r.score) for r in got.collect()} == expected


def test_hybrid_takes_four_times_k_candidates(spark, monkeypatch):
    """The chunks at ranks 21 to 40 of both arms beat the first of either."""
    from verdigris.plans import retrieval_queries as r

    texts = ["hiem " * 10] * 20 + ["chung thuong phoi"] * 20 + ["hiem chung"] * 20 + [w for w in ("chung", "thuong", "phoi") for _ in range(200)]
    tables = {
        "scored_evidence": spark.createDataFrame(list(enumerate(texts)), "evidence_row_id bigint, content string"),
        "phase5b_eval_dataset": spark.createDataFrame([(50, "hiem chung thuong phoi")], "row_id bigint, question string"),
    }
    monkeypatch.setattr(r, "table", lambda _, __, name, *___: tables[name])
    for got, key in ((r.rrf_hybrid(spark, ""), "evidence_row_id"), (r.hybrid_of_all(spark, ""), "key")):
        assert got.orderBy("rank").first()[key] == 40


def test_exact_reference_lifts_from_below_the_first_ten(spark, monkeypatch):
    from verdigris.plans import retrieval_queries as r

    rows = [(i, "phép năm phép năm", "1", "1/2020/NĐ-CP") for i in range(15)]
    rows += [(20, "phép " + "x y z " * 5, "7", "9/2020/NĐ-CP"), (21, "phép " + "x y z " * 9, " 7", "145/2020/NĐ-CP")]
    tables = {
        "scored_evidence": spark.createDataFrame(rows, "evidence_row_id bigint, content string, article_number string, document_no string"),
        "phase5b_eval_dataset": spark.createDataFrame([(50, "Phép năm theo Điều 7 của 145/2020/nđ-cp từ 04/05/2036?")], "row_id bigint, question string"),
    }
    monkeypatch.setattr(r, "table", lambda _, __, name, *___: tables[name])
    got = r.exact_reference(spark, "").orderBy("new_rank").collect()
    assert [(x.evidence_row_id, x.rank) for x in got] == [(21, 17), (20, 16), *((i, i + 1) for i in range(8))]


def test_neighbours_of_every_registry_document(spark, monkeypatch):
    from verdigris.plans import graph_queries as q

    tables = {
        "scored_evidence": spark.createDataFrame([("145/2020/NĐ-CP", "theo 12/2019/NĐ-CP")], "document_no string, content string"),
        "legal_documents": spark.createDataFrame([("145/2020/NĐ-CP",), ("12/2019/NĐ-CP",), ("7/2019/NĐ-CP",), (None,)], "document_no string"),
    }
    monkeypatch.setattr(q, "table", lambda _, __, name, *___: tables[name])
    got = {(r.seed, r.node) for r in q.g_neighbours(spark, "").collect()}
    assert got == {("145/2020/NĐ-CP", "12/2019/NĐ-CP"), ("12/2019/NĐ-CP", "145/2020/NĐ-CP")}


def test_unwraps_documents_of_every_genre(spark, monkeypatch):
    from verdigris.plans import structure_queries as q

    rows = [(1, "người lao\nđộng", "ocr"), (2, "người lao\nđộng", None), (3, "người lao\nđộng", "news")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, genre string")
    monkeypatch.setattr(q, "table", lambda *_: documents)
    assert {r.doc_id for r in q.st_unwrapped(spark, "").collect()} == {1, 2, 3}


def test_prepared_text_is_worked_out_once_for_each_step(spark, monkeypatch):
    """Put into each other, the steps named the question's text hundreds of times in the plan."""
    from verdigris.plans import parsing_queries as p

    rows = [(1, " Cty nợ lương em, cho nghỉ? "), (2, None), (3, "Làm thêm ban đêm tại cty"), (4, "thời tiết")]
    monkeypatch.setattr(p, "table", lambda *_: spark.createDataFrame(rows, "turn_row_id bigint, user_query string"))
    made = p.t_prepared(spark, "")
    assert {r.turn_row_id: r.prepared for r in made.collect()} == {
        1: "công ty nợ lương tôi, cho nghỉ chậm trả lương tiền chấm dứt hợp đồng đơn phương tiền lương",
        2: " ",
        3: "làm thêm ban đêm tại công ty phụ cấp ca đêm làm thêm giờ",
        4: "thời tiết ",
    }
    assert made._jdf.queryExecution().optimizedPlan().toString().count("user_query") < 10


def test_a_task_sends_on_one_list_per_query(spark, monkeypatch):
    """Each block of vectors sent on k rows per query, and the vectors were written anew for every block of queries."""
    import numpy as np

    v = np.random.default_rng(4).integers(-3, 4, size=(3000, 4)) / 4.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(-1, None)], "key int, vector array<double>").coalesce(1)
    q = df.where("key % 300 = 0").select(F.col("key").alias("query"), "vector")
    sent = []
    monkeypatch.setattr(retrieve, "spread", lambda rows: rows, raising=False)
    monkeypatch.setattr(retrieve, "top_k", lambda near, k, **more: sent.append(near) or top_k(near, k, **more))
    held = retrieve.cosine_top_k(q, df, k=5, block=128).collect()
    for query in range(0, 3000, 300):
        best = np.lexsort((np.arange(3000), -np.round(v @ v[query], 6)))[:5]
        assert [r.key for r in sorted(held, key=lambda r: r.rank) if r.query == query] == best.tolist()
    assert sent[0].count() == 10 * 5
    assert retrieve.cosine_top_k(q.where("false"), df).count() == 0


def test_anchors_are_found_without_a_row_per_shared_word(spark, monkeypatch):
    """Every pair of questions with a common word was a row per such word, with both texts, on the way to the 25 nearest."""
    import random

    from verdigris.plans import upkeep_queries as u

    rng = random.Random(6)
    pool = [f"w{i}" for i in range(25)]
    texts = {i: rng.sample(pool, rng.randint(0, 12)) for i in range(1, 400)} | {50: pool[:8], 100: pool[3:11], 150: pool[:4] * 30}
    texts |= {500: texts[50], 501: texts[50], 502: pool[:7], 503: [*pool[:8], "w9"], 504: ["zz", *pool[1:8]], 505: pool[3:10], 506: [*pool[:4] * 29, "x"]}
    rows = [(i, " ".join(words)) for i, words in texts.items()] + [(600, None)]
    monkeypatch.setattr(u, "table", lambda *_: spark.createDataFrame(rows, "row_id bigint, question string"))
    made = u._matches(spark, "")
    want, first = {}, {}
    for i, words in texts.items():
        first.setdefault(" ".join(words), i)
    for query in range(50, 501, 50):
        asked = " ".join(texts.get(query, []))
        long, held = len(asked) >= 120, []
        for text, key in first.items():
            own, shared = set(text.split()), set(text.split()) & set(asked.split())
            if text != asked and len(shared) >= (3 if long else 4) and round(len(shared) / len(own), 6) >= (0.55 if long else 0.6):
                held.append((-round(len(shared) / len(own), 6), key, text))
        for share, key, text in sorted(held)[:25]:
            ratio = round(1 - distance(text, asked) / max(len(text), len(asked)), 6)
            if ratio >= (0.78 if long else 0.86) or ratio >= (0.68 if long else 0.7) and -share >= 0.85:
                want[query, key] = (ratio, -share)
    assert {(x.query, x.key): (x.ratio, x.containment) for x in made.collect()} == want
    assert want and "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_dense_metrics_ranks_without_a_list_per_block(spark, monkeypatch):
    from verdigris.plans import retrieval_queries as r

    texts = [f"điều {i % 97} lương {i}" for i in range(3000)]
    tables = {
        "scored_evidence": spark.createDataFrame([(i, x, "1/2020", str(i)) for i, x in enumerate(texts)], "evidence_row_id bigint, content string, document_no string, article_number string"),
        "phase5b_eval_dataset": spark.createDataFrame([(50 * i, texts[i], "A", "1/2020", i) for i in range(1, 4)], "row_id bigint, question string, query_type string, expected_doc_id string, expected_article int"),
    }
    monkeypatch.setattr(r, "table", lambda _, __, name, *___: tables[name])
    sent = []
    monkeypatch.setattr(retrieve, "top_k", lambda near, k, **more: sent.append(near) or top_k(near, k, **more))
    got = {x.query_type: x for x in r.dense_metrics(spark, "").collect()}
    assert got["ALL"].n_scorable == got["A"].n == 3 and got["ALL"].hit_10 == 1.0
    assert len(sent) == 2 and all(near.count() <= 3 * 40 * near.rdd.getNumPartitions() for near in sent)
    assert all(near.rdd.getNumPartitions() <= 2 for near in sent)


def test_dense_hybrid_ranks_every_question(spark, monkeypatch):
    """Only questions whose row id is divisible by 50 were ranked; several passes and blocks give the same as one."""
    import hashlib
    import math
    import random

    from verdigris.plans import retrieval_queries as r

    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words[: rng.choice((4, 30))], k=rng.randint(1, 14))) for i in range(700)} | {700: None, 701: ""}
    asked = {i: " ".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(1, 31)} | {31: "", 49: "w1 w1 w2", 50: "w3"}
    tables = {
        "scored_evidence": spark.createDataFrame(list(texts.items()), "evidence_row_id bigint, content string"),
        "phase5b_eval_dataset": spark.createDataFrame([*asked.items(), (None, "w1")], "row_id bigint, question string"),
    }
    monkeypatch.setattr(r, "table", lambda _, __, name, *___: tables[name])

    held = {i: s.split() for i, s in texts.items() if s}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = {w: sum(w in s for s in held.values()) for w in words}

    def sums(s):
        out = [0] * 64
        for w in s:
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[h % 64] += 1 if h // 64 % 2 == 0 else -1
        return out

    vectors, want = {i: sums(s) for i, s in held.items()}, {}
    for query, text in asked.items():
        lexical, dense, mine = {}, {}, sums(text.split())
        for i, s in held.items():
            parts = [round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * s.count(w) * 2.5 / (s.count(w) + 1.5 * (0.25 + 0.75 * len(s) / mean)) * 1e8) for w in text.split() if w in s]
            if parts:
                lexical[i] = sum(parts)
            if any(mine) and any(vectors[i]):
                x = sum(a * b for a, b in zip(mine, vectors[i])) / (math.sqrt(sum(a * a for a in mine)) * math.sqrt(sum(b * b for b in vectors[i]))) * 1e6
                dense[i] = math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)
        arms = [{i: rank for rank, i in enumerate(sorted(arm, key=lambda i: (-arm[i], i))[:40], 1)} for arm in (lexical, dense)]
        fused = {i: round(sum(1 / (60 + arm[i]) for arm in arms if i in arm), 10) for i in {*arms[0], *arms[1]}}
        best = sorted(fused, key=lambda i: (-fused[i], arms[0].get(i, 99), arms[1].get(i, 99), i))[:10]
        want |= {(query, rank): (i, arms[0].get(i), arms[1].get(i)) for rank, i in enumerate(best, 1)}
    assert {q for q, _ in want} >= {1, 49, 50}
    for terms, group, common in ((200_000, 10_000, 384), (40, 7, 5)):
        monkeypatch.setattr(retrieve, "QUERY_TERMS", terms)
        monkeypatch.setattr(retrieve, "QUERY_GROUP", group, raising=False)
        monkeypatch.setattr(retrieve, "COMMON", common, raising=False)
        assert {(x.query, x.rank): (x.evidence_row_id, x.rank_a, x.rank_b) for x in r.dense_hybrid(spark, "").collect()} == want


def test_dense_metrics_counts_every_question(spark, monkeypatch):
    """Only questions whose row id is divisible by 50 were counted."""
    from verdigris.plans import retrieval_queries as r

    texts = ["lương tháng", "nghỉ phép năm", "trợ cấp thôi việc", "làm thêm giờ"]
    asked = [(1, texts[0], "A", "1/2020", 0), (2, texts[1], "A", "1/2020", 3), (3, texts[2], "B", None, None), (50, texts[3], "B", "1/2020", 3), (101, "", "B", "1/2020", 1)]
    tables = {
        "scored_evidence": spark.createDataFrame([(i, x, "1/2020", str(i)) for i, x in enumerate(texts)], "evidence_row_id bigint, content string, document_no string, article_number string"),
        "phase5b_eval_dataset": spark.createDataFrame(asked, "row_id bigint, question string, query_type string, expected_doc_id string, expected_article int"),
    }
    monkeypatch.setattr(r, "table", lambda _, __, name, *___: tables[name])
    got = {x.query_type: (x.n, x.n_scorable, x.hit_1) for x in r.dense_metrics(spark, "").collect()}
    assert got == {"A": (2, 2, 0.5), "B": (3, 2, 0.5), "ALL": (5, 4, 0.5)}
