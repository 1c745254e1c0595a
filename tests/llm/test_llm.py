"""The operators of the subpackage: brute force, round trips and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import defects, leak, lookalike, mixture, pieces, pii, sentences

TEXTS = "field string, row_id bigint, text string"
LONG = "Người lao động được nghỉ 12 ngày. " * 3000


# ------------------------------------------------------------------ problem 2
def test_one_form():
    same = ["Điều 25 - số 3", "Ðiều 25 ‐ số 3", "Đi\u200bều\u00a025 ‑ số 3 ", "Đіều ２５ － ѕố 3", "\ufeffĐiê\u0300u 25 - số 3"]
    canonical = lookalike.Canonical(["Điều", "số"])
    assert {canonical.text(s) for s in same} == {"Điều 25 - số 3"}
    for other in ["điều 25 - số 3", "Dieu 25 - so 3", "Điều 25 – số 3", "Điều  25 - số 3", "Điều 25 - số 3."]:
        assert canonical.text(other) != "Điều 25 - số 3"


def test_automaton_agrees_with_table():
    words = ["công", "đồng", "nghỉ", "lương"]
    automaton = lookalike.Automaton(words)
    rng = random.Random(1)
    back = {}
    for a, b in lookalike.LOOKALIKES.items():
        back.setdefault(b, []).append(a)
    for word in words * 50:
        spelled = "".join(rng.choice([c, *back.get(c, [])]) + rng.choice(["", "\u200b", "\u00ad"]) for c in lookalike.unicodedata.normalize("NFD", word))
        assert automaton.match(spelled) == (0, word) and lookalike.by_table(spelled) == word
    assert automaton.match("luong") is None and automaton.match("lương!", 1) == (1, "lương") and automaton.match("lươg", 1) == (1, "lương")


def test_tables_are_aligned():
    assert len(lookalike.LOOKALIKES) > 70 and all(len(k) == len(v) == 1 for k, v in lookalike.LOOKALIKES.items())
    assert lookalike.LOOKALIKES["Ɖ"] == "Đ" and lookalike.LOOKALIKES["ν"] == "v" and lookalike.LOOKALIKES["‑"] == "-"


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    base = ["Tôi hỏi về lương", "Tôi hỏi về lương", "Тôi hỏi về lương", "Tôi\u00a0hỏi về lương ", "tôi hỏi về lương", "", " ", None, LONG, LONG + "\u200b"]
    rows = [(rng.choice("ab"), i, rng.choice(base)) for i in range(80)]
    df = spark.createDataFrame(rows, TEXTS).withColumn("one", F.lit("clash")).withColumn("raw", F.lit(1))
    got = {(r.field, r.id_a, r.id_b) for r in lookalike.equal_looking_pairs(df).collect()}
    form = {i: lookalike.by_table(t).replace("\u00a0", " ").strip() for _, i, t in rows if t is not None}
    want = {(f, i, j) for f, i, s in rows for g, j, t in rows if f == g and i < j and s is not None and t is not None and s != t and form[i] == form[j]}
    assert got == want and want
    assert lookalike.equal_looking_pairs(df.limit(0)).count() == 0


def test_canonical_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("a", None, "Ｌương ")], TEXTS)
    assert sorted((r.row_id or 0, r.canonical) for r in lookalike.canonical_texts(df).collect()) == [(0, "Lương"), (1, None), (2, "")]


# ------------------------------------------------------------------ problem 3
def kinds(text):
    form, _ = pii.plain_form(text)
    return [(k, form[a:b]) for a, b, k in pii.detect(form)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Gửi về net_kha@hopthu-lua.example nhé.", [("EMAIL", "net_kha@hopthu-lua.example")]),
        ("mail truongan-99[a còng]thu chấm vanmia chấm test", [("EMAIL", "truongan-99[a còng]thu chấm vanmia chấm test")]),
        ("Em có nhắn @phong_nhan_su mà không thấy", []),
        ("gọi 0 5 1 0 9 1 8 4 8 6 hoặc (0236) 3526 8962", [("PHONE", "0 5 1 0 9 1 8 4 8 6"), ("PHONE", "(0236) 3526 8962")]),
        ("số ０９１２．３４５．６７８", [("PHONE", "0912.345.678")]),
        ("cccd 015285019429 mới đổi, số cũ 331413181", [("NATIONAL_ID", "015285019429"), ("NATIONAL_ID", "331413181")]),
        ("Mã số BHXH 5022874294, lương 239.323.315 đồng, HS-355041", [("NATIONAL_ID", "5022874294")]),
        ("Hộ chiếu của bạn tôi số P 6694926", [("NATIONAL_ID", "P 6694926")]),
        ("ghi ca 0830-1730, 07568.33 giờ, ngày 27/05/2040", []),
        ("Nhà em ở số 197 đường Vườn Nhãn, phường Đồng Sim.", [("ADDRESS", "số 197 đường Vườn Nhãn, phường Đồng Sim")]),
        ("đến 259/52 rang phi lao, p. 12, tp. bai thom của tôi", [("ADDRESS", "259/52 rang phi lao, p. 12, tp. bai thom")]),
        ("Ca kéo dài 5 giờ, nhà máy không trả ở Tân Lụa", []),
        ("I live at 119 Weaver's St., Ward 4, Con Ray, phone", [("ADDRESS", "119 Weaver's St., Ward 4, Con Ray")]),
        ("Gọi chị Nghiêm Quang Mơ và PHÙNG XUÂN LAM HÀ.", [("PERSON", "Nghiêm Quang Mơ"), ("PERSON", "PHÙNG XUÂN LAM HÀ")]),
        ("lục xuân diệp nói đúng hơn bot", [("PERSON", "lục xuân diệp")]),
        ("Please call Pell Merrow on Monday", [("PERSON", "Pell Merrow")]),
        ("kỹ thuật viên bảo trì, không hưởng lương thì cần", []),
        ("", []),
    ],
)
def test_items(text, found):
    assert kinds(text) == found


def test_replacing(spark):
    rows = [("a", 1, "Tôi là Kha Thu Nết, sdt 0912345678; Kha Thu Nết."), ("a", 2, None), ("a", 3, ""), ("b", 4, "gọi +84912345678"), ("b", 5, LONG + "gọi 0912345678")]
    out = {r.row_id: r for r in pii.replaced(spark.createDataFrame(rows, TEXTS).withColumn("item", F.lit(0))).collect()}
    assert out[1].redacted == "Tôi là [PERSON_1], sdt [PHONE_1]; [PERSON_1]." and out[2].redacted is None and out[3].redacted == ""
    name = out[1].surrogate.split("là ")[1].split(",")[0]
    assert out[1].surrogate.count(name) == 2 and "Nết" not in name and out[5].redacted.endswith("[PHONE_1]")
    assert pii.items(spark.createDataFrame([], TEXTS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10**9 - 1), min_size=2, max_size=40))
def test_digits_never_collide(numbers):
    s = pii.Surrogates("k")
    made = {s.digits("NATIONAL_ID", f"0{n:011d}") for n in numbers}
    assert len(made) == len(numbers)


def test_salts_part_collisions(spark):
    found = spark.createDataFrame([("PERSON", n) for n in ("Kha Thu Nết", "KHA THU NẾT", "Vi Văn Rin")], "pii_type string, item string")
    assert pii.collisions(found).count() == 0 and pii.salted(found) == {}


# ------------------------------------------------------------------ problem 4
@pytest.fixture(scope="module")
def judge():
    fit = [("vi", "Người lao động được nghỉ phép năm và hưởng lương theo hợp đồng"), ("en", "The worker may claim overtime pay under the contract"), ("zh", "员工应当安排休息并支付加班工资")]
    return defects._Judge(defects.Languages(fit * 3))


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("Lương?", None, "EMPTY"), ("Lương?", " \u200b", "EMPTY"), ("Lương?", "**Trả lời:**", "EMPTY"), ("Lương?", "<p></p>", "EMPTY"), ("Lương?", "N/A", "EMPTY"), (None, "", "EMPTY"),
        ("Tôi nghỉ được không?", "Câu hỏi: tôi nghỉ được không.", "COPIES_QUESTION"),
        ("Tôi nghỉ?", "Tôi xin lỗi, tôi không thể hỗ trợ câu hỏi này. Bạn có thể liên hệ bộ phận hỗ trợ.", "REFUSAL"),
        ("Tôi nghỉ?", "Rat tiec, he thong chua co can cu de tra loi.", "REFUSAL"),
        ("Tôi nghỉ?", "Công ty không thể từ chối trả khoản hỗ trợ đi lại.", None),
        ("Tôi nghỉ?", "Tôi không thể khẳng định con số, song mức tối thiểu là 2 triệu đồng.", None),
        ("Người lao động được nghỉ?", "The worker may claim overtime pay.", "OTHER_LANGUAGE"),
        ("Người lao động được nghỉ?", "Chào bạn! 员工应当安排休息。", "OTHER_LANGUAGE"),
        ("Người lao động được nghỉ?", "Nguoi lao dong duoc nghi phep nam.", None),
        ("Tôi nghỉ?", "Người lao động được (nghỉ", "TRUNCATED"), ("Tôi nghỉ?", "Người lao động được nghỉ\n- ", "TRUNCATED"),
    ],
)
def test_single_pairs(judge, question, answer, defect):
    assert judge.judge(question, answer)[0] == defect


def test_endings_are_counted_over_all(spark, judge):
    whole = "Bạn nộp đơn tại phòng nhân sự.\nGiấy tờ:\n1. Đơn đề nghị\n2. Phiếu lương\n"
    rows = [("t", i, "Tôi hỏi?", whole + "3. Đơn đề nghị") for i in range(20)] + [("t", 20, "Tôi hỏi?", "Bạn nộp đơn tại phòng nh"), ("t", 21, "Tôi hỏi?", LONG), ("t", 21, "Tôi hỏi?", LONG)]
    df = spark.createDataFrame(rows, "pair_table string, row_id bigint, question string, answer string").withColumn("last", F.lit("clash"))
    got = sorted((r.row_id, r.defect) for r in defects.judged(df, judge.languages).collect())
    assert [g for g in got if g[1]] == [(20, "TRUNCATED")] and len(got) == 23
    assert defects.judged(df.limit(0), judge.languages).count() == 0


# ------------------------------------------------------------------ problem 5
def check_pieces(text, limit, overlap):
    cut = pieces.cut_all([text], limit, overlap)[0]
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for start, end, _ in cut:
        assert end - start <= limit
    for (a, b, _), (c, d, _) in zip(cut, cut[1:]):
        assert a < c <= b < d and b - c <= overlap
    return cut


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n1)đ。", max_size=400), st.integers(40, 90), st.integers(5, 18))
def test_pieces_cover(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_pieces_agree_with_sequential_walk():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["từ ", "câu. ", "\n1. ", "x" * 30]) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    together = pieces.cut_all(texts, 100, 20)
    assert together == [pieces.cut_all([t], 100, 20)[0] for t in texts]


def test_piece_rows(spark):
    rows = [(1, "ngắn"), (2, None), (3, ""), (4, "x" * 1201), (5, "a b " * 400), (5, "a b " * 400)]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("piece", F.lit("clash"))
    out = pieces.all_pieces(df).collect()
    assert {(r.row_id, r.n_pieces, r.unbroken) for r in out} == {(1, 1, False), (3, 1, False), (4, 2, True), (5, 2, False)}
    assert pieces.all_pieces(df.limit(0)).count() == 0


def test_cut_at_structure():
    text = "Điều 1. Mở đầu\n" + "\n".join(f"{i}. " + "nội dung " * 20 for i in range(1, 12))
    cut = check_pieces(text, 1200, 150)
    assert all(how == "structure" for _, _, how in cut[:-1])


# ------------------------------------------------------------------ problem 6
def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"từ{c}" for c in "abcdefgh"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=30)
        if d % 2:
            source = rng.choice(items)[1].split()
            n = rng.randint(8, 16)
            at = rng.randint(0, max(0, len(source) - n))
            words[10:10] = [w.upper() if rng.random() < 0.5 else w.replace("ừ", "u") for w in source[at : at + n]]
        docs.append((d, " ".join(words).replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(100, None), (101, ""), (102, " ")]
    fold = lambda s: leak.words_of(s or "")
    want = {(d, i) for d, t in docs for i, s in items for k in range(len(fold(s)) - 11) if f" {' '.join(fold(s)[k : k + 12])} " in f" {' '.join(fold(t))} "}
    got = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_leak_edges(spark):
    item = "một hai ba bốn năm sáu bảy tám chín mười mười một mười hai"
    docs = [(1, "x " + item.replace(" ", "") + " y"), (2, item[:-1]), (3, item.replace("hai", "hài", 1).replace("đ", "d")), (4, LONG + item), (4, LONG + item)]
    got = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item), (8, item), (9, "ngắn"), (10, None)], "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8), (4, 7), (4, 7), (4, 8), (4, 8)]
    none = leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string"))
    assert none.count() == 0


# ------------------------------------------------------------------ problem 7
def test_quotas():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.0, 1)]
    assert mixture.quotas(targets, {"a": 1000, "b": 1000, "c": 1000}, 1000) == {"a": 500, "b": 300, "c": 200, "d": 0}
    got = mixture.quotas(targets, {"a": 100, "b": 1000, "c": 20}, 1000)
    assert got["a"] == 100 and got["c"] == 60 and got["b"] == 840
    assert sum(mixture.quotas([], {}, 10).values()) == 0


def test_mixture(spark):
    docs = [(i, "Src-A" if i % 3 else "src_b", "một hai ba bốn năm " * (1 + i % 5)) for i in range(300)] + [(900, None, "x"), (901, "src_a", None), (902, "zzz", "y"), (903, "srcc_a", "z")]
    targets = spark.createDataFrame([("src_a", 0.4, 1), ("src_b", 0.6, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("bucket", F.lit("clash")).withColumn("quota", F.lit(1))
    plan = mixture.Plan(df, targets, block=50)
    repeats = {r.doc_id: r for r in plan.repeats().collect()}
    assert len(repeats) == 304 and repeats[900].repeats == repeats[902].repeats == 0 and repeats[903].source == "src_a"
    assert max(r.repeats for r in repeats.values() if r.source == "src_a") <= 1 and max(r.repeats for r in repeats.values()) <= 3
    shares = {r.source: r for r in plan.shares().collect()}
    assert abs(shares["src_a"].actual_share - 0.4) < 0.03 and abs(shares["src_b"].actual_share - 0.6) < 0.03 and shares["none"].actual_share == 0
    schedule = plan.schedule().collect()
    assert len(schedule) == sum(r.repeats for r in repeats.values())
    half = max(r.slot for r in schedule) // 2
    first = [r for r in schedule if r.slot < half]
    part = sum(r.n_tokens for r in first if r.source == "src_a") / sum(r.n_tokens for r in first)
    assert abs(part - shares["src_a"].actual_share) < 0.06
    empty = mixture.Plan(df.limit(0), targets)
    assert empty.repeats().count() == 0 and empty.shares().count() == 3 and empty.schedule().count() == 0


# ------------------------------------------------------------------ problem 8
def split(text):
    starts = sentences.chunk_function(text, 0, len(text), (sentences.BETWEEN,))[1][0]
    return [text[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(text)])]


@pytest.mark.parametrize(
    "parts",
    [
        ["Hồ sơ gồm phiếu lương, v.v.", "Người lao động ký ngày 1.3.2031."], ["Mục 4.2. Hồ sơ\n\n", "Nội dung có\nxuống dòng."], ["Theo GS. Lục Ngọc Bưởi, “nghỉ” là mở!", "Hết."],
        ["Chi nhánh hỏi: \"Ai ký?\"", "Thu ngân đáp."], ["Bà A (sn. 1911) khai: ‘Tôi nghỉ từ 1.3.’ và ký tên."], ["1. Hồ sơ gồm:\n", "a) đơn;\n", "b) phiếu."],
        ["Dr. Haldsworth of Tools Inc. called it unfair.", "Rates rose by 1.3 per cent, i.e. less."], ["\"Who signed?\" asked Mr. Tullivane.", "Nobody."], ["Mme A dit : « C'est fini. »", "L'employeur répond."],
        ["班長は「今日は休む。明日出る。」と言って出た。", "本当に終わりますか！？", "比率は2%（前年は3%。参考値）である。"], ["工会表示：“没有变！”", "资料……仍在整理中。"],
        ["반장은 \"오늘은 쉰다. 내일 나와라.\"라고 말했다.", "비율은 5.6%다."], ["ลูกจ้างต้องได้พัก", "อัตราใหม่คือ5.9%ไม่ใช่8.6%"], ["ប្រធានថា«ថ្ងៃស្អែក។»ហើយទៅ។", "តើអ្នកណា?", "អត្រា។"],
        ["Anh chị chờ 20 tháng… hội đồng sẽ báo!", "Ngày 82.\n\n", "Hết"], ["Hạn là ngày.", "Chi nhánh ký."],
    ],
)
def test_sentences(parts):
    glue = "" if any("\u3000" < c < "\uac00" or "\u1780" <= c <= "\u17ff" for c in parts[0]) else " "
    text = glue.join(parts)
    assert split(text) == [p.rstrip() for p in parts]


def test_lost_blank():
    assert split("Hạn là 5 ngày.Chi nhánh ký.") == ["Hạn là 5 ngày.", "Chi nhánh ký."]


def test_chunks_compose_to_the_whole(spark):
    parts = ["Tôi đi làm. ", "Chi nhánh hỏi: “Ai ký? Ai nộp?” rồi thôi. ", "\n\nĐiều 4. Lương\n", "班長は「休む。出る。」と言った。", "(xem phụ lục. Hết) "]
    rng = random.Random(6)
    texts = [(i, "".join(rng.choices(parts, k=400))) for i in range(5)] + [(7, None), (8, ""), (9, " \n ")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("start_pos", F.lit("clash"))
    whole = {(r.doc_id, r.start_pos) for r in sentences.sentence_starts(df).collect()}
    cut = {(r.doc_id, r.start_pos) for r in sentences.sentence_starts(df, chunk=1000).collect()}
    assert whole == cut and len(whole) > 1000
    assert sentences.sentence_starts(df.limit(0)).count() == 0


def test_prefix_scan_is_sequential_composition():
    rng = np.random.default_rng(7)
    functions = rng.integers(0, sentences.STATES, (37, sentences.STATES))
    state, want = sentences.BETWEEN, []
    for f in functions:
        want.append(state)
        state = f[state]
    assert sentences.prefix_entries(functions).tolist() == want
