"""Readings that only the vocabulary gives, and pairs by classes."""

import random

from pyspark.sql import functions as F

from verdigris.llm import lookalike

WORDS = ["lương", "Lương", "IX", "công", "đồng", "hàng", "hằng", "kg", "nghỉ"]


def test_the_automaton_reads_what_the_table_cannot():
    canonical = lookalike.Canonical(WORDS)
    for written, word in [("lươnց", "lương"), ("Ӏương", "lương"), ("ǀX", "IX"), ("“lươnց”,", "“lương”,"), ("​Լương", "Lương")]:
        assert lookalike.by_table(written) != word and canonical.token(written) == word
    # The right readings cost less than wrong ones.
    assert canonical.automaton.matches("lươnց", 1)[0] == (0.5, "lương") and canonical.automaton.matches("lươnց", 0) == []


def test_no_reading_without_need():
    canonical = lookalike.Canonical(WORDS)
    # Short, ambiguous and plainly different words keep the table's form.
    for token in ["kց", "hцng", "hաng", "cơng", "luong", "đong", "ցցng", "βlương", "Lươngs"]:
        assert canonical.token(token) == lookalike.by_table(token), token


def test_classes_and_pairs_with_a_hot_spelling(spark):
    rng = random.Random(5)
    spellings = ["Chào bạn"] * 20 + ["Сhào bạn", "Chào bạn", " Chào bạn", "chào bạn", "Chào  bạn"]
    rows = [(rng.choice("ab"), i, rng.choice(spellings)) for i in range(150)]
    df = spark.createDataFrame([*rows, rows[0], ("a", 999, None), ("a", 1000, "")], "field string, row_id bigint, text string").withColumn("spelling", F.lit("clash"))
    form = lambda t: lookalike.by_table(t).replace(" ", " ").strip()
    everything = [*rows, rows[0]]
    want = sorted((f, min(i, j), max(i, j)) for x, (f, i, s) in enumerate(everything) for g, j, t in everything[:x] if f == g and i != j and s != t and form(s) == form(t))
    assert sorted((r.field, r.id_a, r.id_b) for r in lookalike.equal_looking_pairs(df).collect()) == want and want
    classes = lookalike.classes(df).collect()
    assert len(classes) == sum(len({t for g, _, t in rows if g == f and form(t) == form(s)}) > 1 for f, _, s in everything)
    assert {r.n_spellings for r in classes} <= {2, 3, 4} and lookalike.classes(df.limit(0)).count() == 0
