"""The transducer: the same starts for any size of chunks and pieces, marks far apart, deep marks."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import sentences

PARTS = [
    "Tôi đi làm. ", "Chi nhánh hỏi: “Ai ký? Ai nộp?” rồi thôi. ", "\n\nĐiều 4. Lương\n", "班長は「休む。出る。」と言った。", "(xem phụ lục. Hết) ", "\n", "\n\n", "1. Hồ sơ\n", "a) đơn;\n",
    "- mục", " “", "” ", "\"", " \"Ai?\" ", "‘", "(", ")", "...", "ลูกจ้างต้องได้พัก ", "Mục 4.2. ", " ", "nghỉ phép năm được tính theo tháng làm việc của từng người lao động trong năm đó ", "\n4. ", "Hết:", "\t\n ",
]


def composed(text, chunk):
    functions = sentences._Functions(chunk)({"doc_id": [0], "first": [0], "before": [0], "size": [len(text)], "tail": [""], "text": [text]})
    return sorted(sentences._Scan()(functions)["start_pos"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(7, 300))
def test_any_chunk_gives_the_same_starts(parts, chunk):
    text = "".join(parts)
    assert composed(text, chunk) == composed(text, len(text) + 1)


def test_pieces_of_long_texts_give_the_same_starts(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choices(PARTS, k=500))) for i in range(6)]
    df = spark.createDataFrame([*texts, texts[0], (0, texts[1][1]), (9, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.start_pos) for r in sentences.sentence_starts(df, chunk=200, spread=4).collect())
    want = sorted((d, at) for d, t in [*texts, texts[0], (0, texts[1][1])] for at in composed(t, len(t) + 1))
    assert got == want and len(got) > 500


def test_quotation_of_any_length_stays_inside():
    for n in (3, 30, 300, 3000):
        text = "Chi nhánh nói: “" + "Tôi đi làm. " * n + "” rồi thôi. Hết."
        starts = composed(text, 2000)
        assert len(starts) == 2 and text[starts[1] :] == "Hết."


def test_deep_marks():
    for n in (1, 4, 12):
        text = "Ông nói " + "(" * n + "a. B" + ")" * n + " thế. Hết."
        assert [text[a : a + 3] for a in composed(text, 50)] == ["Ông", "Hết"]


def test_tails_are_what_follows():
    text = "a (b) “c\n\nd” e"
    for at, tail in zip(range(len(text)), sentences.tails(text, list(range(len(text))))):
        stop = text.find("\n\n", max(0, at - 1))
        assert set(tail) == {m for m in sentences._marks if m in text[at : len(text) if stop < 0 else stop]}
