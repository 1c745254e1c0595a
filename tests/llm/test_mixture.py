"""The mixture comes from the schedule, and names of sources are matched with care."""

from pyspark.sql import functions as F

from verdigris.llm import mixture


def test_names(spark):
    targets = spark.createDataFrame([("hn",), ("web1",), ("forum_qa",), ("law-text",)], "source string")
    raw = ["hn", "en", "web1", "web2", "WEB1 ", "Forum QA", "forum_q", "fourm_qa", "lawtext", "law text", None, "", "x"]
    got = {r.raw_source: r.source for r in mixture.matched_sources(spark.createDataFrame([(r,) for r in raw], "raw_source string"), targets).collect()}
    assert got == {"hn": "hn", "web1": "web1", "WEB1 ": "web1", "Forum QA": "forum_qa", "forum_q": "forum_qa", "fourm_qa": "forum_qa", "lawtext": "law-text", "law text": "law-text"}


def test_repeats_are_a_count_over_the_schedule(spark):
    docs = [(i, "ab"[i % 4 == 0], "một hai ba " * (1 + i % 7)) for i in range(400)] + [(1000, "c", "x " * 30), (1001, None, "y")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("start", F.lit("clash"))
    plan = mixture.Plan(df, targets, block=64)
    repeats = {r.doc_id: r.repeats for r in plan.repeats().collect()}
    schedule = plan.schedule().collect()
    counted: dict = {}
    for r in schedule:
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    assert {d: n for d, n in repeats.items() if n} == counted and len(repeats) == 402 and repeats[1001] == 0 and repeats[1000] == 2
    # The slots are those of the golden-ratio points, and each holds a block of one source.
    stops, total = [], 0
    for s, _, _ in plan.targets:
        total += plan.quota[s]
        stops.append((total, s))
    for r in schedule:
        point = ((r.slot + 0.5) * mixture.GOLDEN) % 1.0 * total
        assert r.source == next(s for stop, s in stops if point < stop) and r.slot < plan.n_slots
    blocks: dict = {}
    for r in schedule:
        blocks[r.slot] = blocks.get(r.slot, 0) + r.n_tokens
    assert max(blocks.values()) <= 64 + max(r.n_tokens for r in schedule)
