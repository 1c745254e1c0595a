"""Operators of problems 3 and 4 on what they once left undone."""

from verdigris.llm import defects


def test_copies_of_a_broken_off_answer_do_not_vouch_for_it(spark):
    sound = [("t", i, "hỏi gì", f"Người lao động số {chr(97 + i % 26)}{chr(97 + i // 26)} được nghỉ phép năm.") for i in range(40)]
    broken = [("t", 100 + i, "hỏi gì", "Người lao động được hưởng trợ cấp khi làm" + " " * (i % 3)) for i in range(20)]
    df = spark.createDataFrame(sound + broken, "pair_table string, row_id bigint, question string, answer string")
    got = {r.row_id: r.defect for r in defects.judged(df, defects.Languages([])).collect()}
    assert {d for i, d in got.items() if i >= 100} == {"TRUNCATED"} and {d for i, d in got.items() if i < 100} == {None}
