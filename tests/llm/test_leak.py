"""Spans of held-out items: their places, several blocks of items, and what removal leaves."""

import random

from pyspark.sql import functions as F

from verdigris.llm import leak

ITEM = "một hai ba bốn năm sáu bảy tám chín mười mười một mười hai mười ba"


def test_spans_stand_where_the_item_does(spark):
    docs = [(1, "Mở đầu.  " + ITEM.upper().replace(" ", ",\n", 1) + "! Hết."), (1, "khác " + ITEM), (2, "x" + ITEM.replace(" ", "") + " y"), (3, None), (4, ""), (5, ITEM + " và " + ITEM)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("text_hash", F.lit(1))
    items = spark.createDataFrame([(7, ITEM), (8, "ngắn thôi"), (9, None)], "item_id bigint, text string")
    found = leak.spans(df, items).collect()
    texts = {(r.doc_id, r.text_hash): None for r in found}
    assert len(found) == 5 and len(texts) == 4 and all(r.item_id == 7 and r.coverage > 0.99 for r in found)
    marked = sorted((r.doc_id, r.start_pos, r.end_pos) for r in found)
    assert [docs[0][1][a:b] for d, a, b in marked if d == 1 and a > 6] == [ITEM.upper().replace(" ", ",\n", 1)]
    out = sorted((r.doc_id, r.n_removed, r.cleaned) for r in leak.cleaned(df, leak.spans(df, items)).collect() if r.doc_id != 3)
    assert [c for d, _, c in out if d == 1] == ["khác ", "Mở đầu.  ! Hết."] and ("  và " .strip() in out[-1][2]) and out[-1][1] == 2 * len(ITEM)
    sizes = {r.item_id: r.n_words for r in leak.item_words(items).collect()}
    assert sizes == {7: 16, 8: 2, 9: 0}


def test_blocks_give_the_same_spans(spark):
    rng = random.Random(11)
    vocabulary = [f"từ{c}" for c in "abcdefghij"]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)]
    docs = [(d, " ".join(rng.choices(vocabulary, k=20) + rng.choice(items)[1].split()[rng.randint(0, 9) : 28] + rng.choices(vocabulary, k=9))) for d in range(40)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted(map(tuple, leak.spans(*frames, block=b).collect())) for b in (10**6, 500))
    assert one == many and len(one) >= 40
    text = dict(docs)
    for doc, _, item, start, end, n, _, _ in one:
        words = leak.words_of(text[doc][start:end])
        assert len(words) == n >= 12 and f" {' '.join(words[:12])}" in " " + " ".join(leak.words_of(dict(items)[item]))
