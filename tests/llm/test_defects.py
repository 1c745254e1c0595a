"""Defective pairs: copies against brute force, the end model against counting by hand."""

import random

import numpy as np
import pytest
import regex

from verdigris.llm import defects

ROWS = "pair_table string, row_id bigint, question string, answer string"


@pytest.mark.parametrize("question, answer", [("Lương?", "Lương? Lương?"), ("Lương?", "Lương? Trả lời:"), ("Nghỉ phép?", "Nghỉ phép? Đáp:"), ("Lương?", "Trả lời: LƯƠNG")])
def test_short_questions_are_copied_too(question, answer):
    assert defects.copies(question, answer)


def test_copies_against_the_whole_test():
    """The comparison of starts spares work and never changes a result."""
    rng = random.Random(3)
    parts = ["Lương", "nghỉ ", "Trả lời: ", "hỏi ", "đáp", ".", " ", "​", "**", "Ｌương", "công ty trả lương tháng mười ba", "́", "-" * 120]
    held = 0
    for _ in range(4000):
        question = "".join(rng.choices(parts, k=rng.randint(1, 3)))
        answer = "".join(rng.choices([*parts, question], k=rng.randint(1, 5)))
        asked, said = (defects._letters(defects.body_of(t)) for t in (question, answer))
        whole = bool(asked) and asked in said and regex.fullmatch(rf"(?:{defects._letters_of_labels}|{regex.escape(asked)})+", said) is not None
        assert defects.copies(question, answer) == whole, (question, answer)
        held += whole
    assert held > 100


def test_brackets_and_tags_of_any_length():
    assert defects.open_bracket("Xong. Người lao động (" + "nghỉ phép " * 500) and not defects.open_bracket("(a. b) " + "c " * 3000)
    judge = defects._Judge(defects.Languages([]))
    assert judge.judge("Hỏi gì?", f"<p class='{'x' * 90}'> </p>")[0] == "EMPTY"
    assert judge.judge("Hỏi gì?", "Cần có:\n" + " " * 200 + "- \n")[0] == "TRUNCATED"


def test_contexts_are_those_of_each_part():
    parts = ["^ab", "^abcdefghijk", "^0. abcdefghijk"]
    together = defects.contexts(parts)
    alone = [defects.contexts([p]) for p in parts]
    for order, row in enumerate(together):
        assert row.tolist() == [v for own in alone for v in own[order].tolist()]
    assert len({p[-1] for p in (row for row in (a[3] for a in alone))}) == 3 and alone[1][2][-1] == alone[2][2][-1]


def test_last_contexts_are_those_of_whole_parts():
    parts = ["^", "^ab", "^" + "xyz " * 40, "^0. một", "^" + "a" * 31, "^" + "a" * 32]
    assert defects.last_contexts(parts) == [[int(row[-1]) for row in defects.contexts([p])] for p in parts] and defects.last_contexts([]) == []


def test_signs_are_needed():
    rng = random.Random(2)
    signs = ["a", " ", "<b>", "<", "`", "```x", "«q»", "“q”", "\"q\"", "(q)", "‘q’", "\n", "*Nguồn: x*", "\nCăn cứ pháp lý\n- x", "*"]
    for _ in range(2000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 6)))
        assert defects._no_markup(text) == defects._markup.sub(" ", text) and defects._no_quotes(text) == defects._quoted.sub(" ", text) and defects._no_tail(text, "") == defects._tail.sub("", text)


def test_ends_against_counting(spark):
    rng = random.Random(4)
    words = ["giấy", "ra", "viện", "lương", "nghỉ"]
    answers = ["".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n"]) for _ in range(9)).strip() for _ in range(120)] + ["", None, "Trân trọng", "trân  trọng", "Trân trọng", " Giấy ra viện"]
    df = spark.createDataFrame([("t", i, None, a) for i, a in enumerate(answers)], ROWS)
    judge = defects._Judge(defects.Languages([]))
    rows = [(defects._hash(a), *judge.judge(None, a)) for a in answers if a]
    open_ends = [(h, tuple(defects.last_contexts([c])[0])) for h, _, c in rows if c]
    got = {tuple(r.contexts): r.p_end for r in defects.ends(df, spark.createDataFrame(open_ends, "answer_hash bigint, contexts array<bigint>")).collect()}
    n_end, n_on = {}, {}
    for a in answers:
        closed, rest = defects.units(a or "")
        for part, ends in [(p, 1) for p in closed] + [(rest, 0)] * bool(rest):
            for row in defects.contexts([part]):
                for place, value in enumerate(row.tolist(), 1):
                    if place < len(part):
                        n_on[value] = n_on.get(value, 0) + 1
                    elif ends:
                        n_end[value] = n_end.get(value, 0) + 1
    want = {}
    for _, places in open_ends:
        p = 0.0
        for c in places:
            closed = n_end.get(c, 0) + len({h for h, other in open_ends if c in other}) - 1
            p = (closed + defects.BACKOFF * p) / (closed + n_on.get(c, 0) + defects.BACKOFF)
        want[places] = p
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_table_of_bits(spark):
    values = np.random.default_rng(1).integers(-(2**62), 2**62, 500).tolist() + [0, 1, defects.BITS, defects.BITS - 1, -1]
    asked = defects._asked(spark.createDataFrame([(values,)], "contexts array<bigint>"))
    assert set(np.flatnonzero(asked).tolist()) == {v & (defects.BITS - 1) for v in values}


def test_abstain_goes_along(spark):
    df = spark.createDataFrame([("t", 1, "Hỏi?", None, True), ("t", 2, "Hỏi?", "Được nghỉ.", None)], ROWS + ", abstain boolean")
    assert sorted((r.row_id, r.abstain, r.defect) for r in defects.judged(df, defects.Languages([])).collect()) == [(1, True, "EMPTY"), (2, None, None)]


@pytest.mark.parametrize(
    "answer, declines",
    [
        ("I'm sorry, but I can't help with that.", True), ("Câu này tôi chịu, bạn hỏi cơ quan khác nhé.", True), ("Xin phép bỏ qua câu hỏi liên quan đến lương vì lý do chính sách.", True), ("Tôi xin lỗi, nhưng tôi không thể trả lời.", True),
        ("Tôi chịu trách nhiệm trả lời trong tháng này.", False), ("I'm sorry, but the term is 3 months; I can't help with that.", False), ("Xin lỗi vì trả lời muộn: thời hạn là 9 ngày.", False), ("Tôi không thể trả lời hết, nhưng thời hạn là một tháng.", False),
        ("Wages already paid to the trainee cannot be claimed back for that reason.", False),
    ],
)
def test_apologies_give_no_substance(answer, declines):
    assert defects.refuses(answer) == declines
