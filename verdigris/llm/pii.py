"""Personal data in free text: found, replaced by typed placeholders or by surrogates (problem 3).

Detection runs on the look-alike-free form of a text, with a map back to the
text as stored, so disguised spellings count and all else stays readable.
Types are looked for in the order e-mail, address, identity number, phone,
person; what one has taken is closed to the next, so a name inside an address
or an e-mail is no item of its own.

Surrogates are keyed: the same person, number or address gets the same
replacement in every text and place of the corpus without any shared state
(coreference), the replacement has the original's gender, script, case and
grouping, and digits are replaced by a keyed permutation of their length, which
can't collide. Names, addresses and e-mail addresses carry a keyed draw from a
product of parts; draws that fall together are redrawn until none do
(``redrawn``). Without a key a fresh random one is drawn for the call, so that
nobody who has the code can undo the replacement.

Defined results: null texts stay null and hold nothing; empty texts stay empty;
items of one type are numbered from 1 in order of their start.
"""

from __future__ import annotations

import hashlib
import secrets
import unicodedata

import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm import lookalike
from verdigris.session import cut, map_batches

TYPES = ("EMAIL", "ADDRESS", "NATIONAL_ID", "PHONE", "PERSON")


# ------------------------------------------------------------------ text forms
_cluster = regex.compile(f"[^\\p{{M}}{lookalike.IGNORABLE}]?[\\p{{M}}{lookalike.IGNORABLE}]*")


def plain_form(text: str):
    """The text in its one form, and per character of it the span it has in the stored text."""
    if lookalike._plain.fullmatch(text):
        return text, None
    out, spans = [], []
    for m in _cluster.finditer(text):
        if not m[0]:
            continue
        form = lookalike._blank.sub(" ", lookalike.by_table(m[0]))
        for c in form:
            out.append(c)
            spans.append(m.span())
    return "".join(out), spans


class _Bare(dict):
    """Per code point its letter without accents, nothing for a mark."""

    def __missing__(self, point: int) -> str:
        form = unicodedata.normalize("NFD", chr(point))
        self[point] = "".join(c for c in form if not unicodedata.combining(c)).replace("đ", "d")
        return self[point]


_bare = _Bare()


def bare(text: str) -> str:
    """Lower case without accents."""
    return text.lower().translate(_bare)


# ------------------------------------------------------------------ e-mail
_dot = r"(?:\.|\s*[\(\[{]\s*(?:dot|chấm|cham|\.)\s*[\)\]}]\s*|\s+(?:dot|chấm|cham)\s+)"
_at = r"(?:\s?@\s?|\s*[\(\[{<]\s*(?:at|@|a[ -]?(?:còng|cong|móc|moc))\s*[\)\]}>]\s*|\s+(?:a[ -]?còng|a[ -]?cong|a[ -]?móc)\s+)"
_email = regex.compile(
    rf"(?i)(?<![\w.+-])[a-z0-9][a-z0-9._+-]*(?:\s+(?:dot|chấm)\s+[a-z0-9_+-]+)*?{_at}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_dot}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_dot}[a-z]{{2,}}(?![\w-])"
    rf"|(?<![\w.+-])[a-z0-9][a-z0-9._+-]*\s+at\s+[a-z0-9-]+(?:(?:\.|\s+dot\s+)[a-z0-9-]+)*\s+dot\s+[a-z]{{2,}}\b"
)

_email_hint = regex.compile(r"(?i)@|a[ -]?[cm][oòó][cn]|[(\[{<\s]at[)\]}>\s]")

# ------------------------------------------------------------------ addresses
_U = r"\p{Lu}[\p{L}\p{M}'’-]*"
_L = r"\p{Ll}[\p{L}\p{M}'’-]*"
_stop = (
    r"(?:của|cua|bị|bi|nhé|nhe|giúp|giup|để|de|và|va|là|la|có|co|không|khong|khỏi|khoi|cho|thì|thi|nên|nen|rồi|roi|mà|ma|"
    r"người|nguoi|tôi|toi|em|được|duoc|đang|dang|đã|da|gửi|gui|ạ|a|phone|on|and|to|from|for|is|was|please)\b"
)
_name = rf"(?-i:{_U}(?: {_U}){{0,4}}|{_L}(?: {_L}){{0,3}}(?=\s*,)|(?!{_stop}){_L}(?: (?!{_stop}){_L}){{0,3}})"
_num = r"\d{1,5}\p{L}?(?:[/-]\d{1,4}\p{L}?)*"
_area = (
    r"(?:phường|phuong|thị trấn|thi tran|thị xã|thi xa|thành phố|thanh pho|quận|quan|huyện|huyen|tỉnh|tinh|xã|xa|thôn|thon|xóm|xom|ấp|ap|"
    r"ward|district|city|province|(?:p|q|h|x|tp|tx|tt|t)\.)"
)
_unit = r"(?:khu phố|khu pho|kp\.?|tổ dân phố|to dan pho|số nhà|so nha|số|so|tổ|to|nhà|nha|tầng|tang|khối|khoi|block|căn|can)"
_more = rf"(?:\s*[,;]\s*(?:{_area} ?(?:{_num}|{_name})|{_unit} {_num}(?![\p{{L}}\d])))"
_road = r"(?:đường|duong|phố|pho|đại lộ|dai lo|đ\.|d\.)"
_lane = r"(?:ngõ|ngo|hẻm|hem|ngách|ngach|kiệt|kiet)"
_way = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Way|Court|Ct|Hill|Row|Terrace|Square|Sq)"
_house = r"(?:nhà số|nha so|số nhà|so nha|số|so|nhà|nha)"
_address = regex.compile(
    r"(?i)(?<![\w/.,-])(?<!\d )(?:"
    rf"(?:{_house} )?{_num},? {_road} ?{_name}{_more}*"
    rf"|(?:{_house} {_num},? )?{_lane} {_num}(?:,? {_lane} {_num})*,? (?:{_road} ?)?{_name}{_more}*"
    rf"|(?:căn hộ|can ho|căn|can|phòng|phong|p\.) ?{_num},? (?:chung cư|chung cu|tòa nhà|toa nha|tòa|toa|khu tập thể|cc\.?) {_name}{_more}*"
    rf"|(?:thôn|thon|ấp|ap|xóm|xom|bản|làng|lang|khóm|khom) (?:{_num}|{_name}){_more}+"
    rf"|(?:{_house} {_num}|\d{{1,5}}\p{{L}}?(?:/\d{{1,4}}\p{{L}}?)+) {_name}{_more}+"
    rf"|(?:(?:Flat|Apt\.?|Apartment|Unit|Room|Suite) {_num},? )?{_num} (?-i:(?:{_U} ){{1,3}}){_way}\b\.?(?:{_more}|, (?-i:{_U}(?: {_U}){{0,2}}))*"
    r")"
)

# What every address has somewhere; texts without it aren't searched for whole ones.
_address_hint = regex.compile(
    rf"(?i)\d\p{{L}}?,? ?(?:{_road}|chung|tòa|toa|khu tập|cc)|{_lane} \d|[,;]\s*(?:{_area}|{_unit} \d)|\b{_way}\b"
)

# ------------------------------------------------------------------ numbers
_free = r"(?<![\p{L}\p{N}_])(?<![.,/+-])"
_shut = r"(?![\p{L}\p{N}_])(?![.,/-]\d)"
_money = r"(?!\s*(?:đồng|đ\b|vnd|vnđ|dong\b|triệu|nghìn|tỷ|usd))"
_card = regex.compile(
    rf"(?i){_free}(?:0\d{{11}}|0\d\d([ .-])\d{{3}}\1\d{{3}}\1\d{{3}}|0\d{{3}}([ .-])\d{{4}}\2\d{{4}}|0(?: \d){{11}}){_shut}{_money}"
)
_old_card = regex.compile(rf"(?i){_free}(?:\d{{9}}|\d{{3}}([ .-])\d{{3}}\1\d{{3}}|\d(?: \d){{8}}){_shut}{_money}")
_old_cue = regex.compile(
    r"(?i)(?:cmnd|cmt|cccd|chứng minh|chung minh|căn cước|can cuoc|số cũ|so cu|thẻ cũ|the cu|giấy tùy thân|identity|id card|id no)[^.?!\n]{0,45}$"
)
_insurance = regex.compile(rf"(?i){_free}(?:\d{{10}}|\d{{2,4}}(?:[ .-]\d{{2,4}}){{2,3}}|\d(?: \d){{9}}){_shut}{_money}")
_insurance_cue = regex.compile(r"(?i)(?:(?:bhxh|bảo hiểm xã hội|bao hiem xa hoi|sổ bảo hiểm|so bao hiem|social insurance)[^.?!\n\d]{0,30}|\bsổ (?:số )?)$")
_passport = regex.compile(r"(?i)(?<![\w-])[a-z][ -]?\d{7}(?![\w])(?![.,/-]\d)")
_passport_hint = regex.compile(r"(?i)hộ chiếu|ho chieu|passport")
_passport_cue = regex.compile(r"(?i)(?:hộ chiếu|ho chieu|passport)[^?!\n]{0,45}$")
_phone = regex.compile(
    r"(?<![\p{L}\p{N}_])(?<![.,/-])(?<!\+)(?:"
    r"(?:\(\+84\)|\+84|0084|\(84\)|\(0084\))[ .-]?(?:\(0\))?\d(?:[ .-]?\d){8}"
    r"|84[35789]\d{8}"
    r"|\(0\d{2,3}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|0[2-9]\d(?:[ .-]?\d){7}"
    r"|0 [2-9](?: \d){8}"
    r")(?![\p{L}\p{N}_])(?![.,/-]\d)"
)

_not_phone = regex.compile(r"(?i)(?:mã số thuế|ma so thue|mst|tax (?:code|id)|tài khoản|tai khoan|account)[^.?!\n\d]{0,20}$")
# An office's address isn't a dwelling's.
_office = regex.compile(r"(?i)(?:trụ sở|tru so|văn phòng|van phong|công ty|cong ty|cty|chi nhánh|chi nhanh|cơ quan|co quan|nhà máy|nha may|office)[^.?!\n,;]{0,25}(?:ở|tại|o|tai|at|:)\s*$")

# ------------------------------------------------------------------ persons
# Vietnamese family names.
FAMILY = (
    "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Đoàn Lâm Mai Trịnh Đào Cao Hà Tạ Tăng Kiều Quách "
    "Phùng Vương Trương Lương Thái Lục Giang Nghiêm Mạc Ngụy Cù Kha Vi Chu Châu La Từ Thạch Tô Tôn Tống Triệu Ông Khổng Hứa Doãn "
    "Diệp Đàm Đậu Bạch Cung Khúc Lã Lưu Lại Mã Ninh Nhữ Phí Quan Sơn Thân Thiều Tiêu Trà Vưu Âu Viên Văn"
).split()
# Vietnamese middle names.
MIDDLE = (
    "Văn Thị Hữu Đình Quang Xuân Thanh Thu Ngọc Bảo Mỹ Khắc Đức Minh Hoàng Anh Kim Hồng Gia Tuấn Công Phương Thùy Hải Như Bích Tấn "
    "Trọng Quốc Duy Nhật Thế Chí Viết Phúc Diệu Cẩm Tuyết Hoài Khánh Trung Tiến Đăng Hùng Mạnh Bá Sỹ Ánh Diễm Kiều Lan Thúy Việt Huy "
    "Nam Thành Vĩnh Trường Tường Nguyên Hà Linh Quỳnh Thảo Yến Hoa"
).split()
# Vietnamese given names, by who usually bears them.
GIVEN_MALE = (
    "Cường Dũng Hùng Hưng Kiên Long Mạnh Nghĩa Phong Phúc Quân Sơn Thắng Thịnh Tiến Toàn Trung Trường Tú Tuấn Tùng Việt Vinh Vũ Đạt Đức Hậu Hiếu "
    "Huy Khôi Khoa Lộc Luân Nam Nhân Quốc Quý Tài Tấn Thành Thiện Thuận Tín Toản Trí Trọng Vương Bình Chiến Công Danh Duy Đông Giang Hoàng Khang"
).split()
GIVEN_FEMALE = (
    "Anh Bích Châu Chi Cúc Diễm Diệp Diệu Dung Duyên Đào Hạnh Hằng Hiền Hoa Hồng Huệ Huyền Hương Lan Lệ Liên Liễu Linh Loan Ly Mai My Mỹ Nga Ngân Ngọc "
    "Nguyệt Nhi Nhung Như Oanh Phượng Phương Quyên Quỳnh Sương Thắm Thảo Thi Thơ Thu Thúy Thùy Thủy Thư Thương Tiên Trà Trang Trâm Trinh Trúc Tuyết Uyên Vân Vy Xuyến Yến"
).split()
GIVEN_BOTH = "An Ân Bảo Hà Hải Khánh Lam Lâm Minh Nhật Tâm Thanh Trân Xuân Quang Hòa Thái Ninh Phú Nguyên".split()
# Family names that are everyday syllables too; in small letters they need a cue before them.
WEAK = "Lại Quan Viên Từ Văn Ông Khổng La Cao Hứa Hồ Mai Hà Lâm Lý Chu Sơn Thân Trà Âu Lương Vi Lục Cung Đào Đậu Kha Giang Thái Bạch Tiêu".split()
_weak = {n.lower() for n in WEAK}

_family = {bare(n) for n in FAMILY}
_middle = {bare(n) for n in MIDDLE}
_syllables_of_names = {bare(n) for n in (*MIDDLE, *GIVEN_MALE, *GIVEN_FEMALE, *GIVEN_BOTH)}
_family_exact = {unicodedata.normalize("NFC", n.lower()) for n in FAMILY}
_middle_exact = {unicodedata.normalize("NFC", n.lower()) for n in MIDDLE}
_token = regex.compile(r"[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}]+)?")
_syllable = regex.compile(
    r"(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|b|c|d|g|h|k|l|m|n|p|r|s|t|v|x)?"
    r"(?:uye|uya|uyu|ieu|yeu|oai|oay|uoi|uou|uay|oeo|ai|ao|au|ay|eo|eu|ia|ie|iu|oa|oe|oi|oo|ua|ue|ui|uo|uu|uy|ye|a|e|i|o|u|y)"
    r"(?:ng|nh|ch|c|m|n|p|t)?"
)
# Capitalised words of labels, offices and sentence starts that are no part of a name.
_not_name = set(
    """a an the and or but if under no both this that these those please my your our his her who what when where why how is are was
    were do does did can could may might i we you he she it they good thanks thank dear hello hi call contact phone flat ward road
    street lane avenue district city office company ltd inc co corp tnhh cty hs zalo mail email bhxh cccd cmnd id bot ai mr mrs ms dr
    wages rate notice article annex part notes chapter section shift monday tuesday wednesday thursday friday saturday sunday january
    february march april june july august september october november december vietnam asean pdf faq excel word web facebook google
    gmail viber telegram internet overtime contract probation severance leave work workers worker employer employee deduction
    since after before during for from with without about on at in of to by as""".split()
)
_cue = regex.compile(
    r"(?i)(?:\b(?:tên|ten|là|la|anh|chị|chi|ông|ong|bà|ba|cô|chú|bác|em|cháu|bạn|gọi|goi|nhờ|nho|gồm|và|với|chỉ|ca|nhận|nhan|hợp của|hop cua|"
    r"tên là|đứng tên|dung ten|góp ý|gop y|name is|call|mr|mrs|ms|dr|gs|ts|ths)[.:]?\s+)$"
)


def _case(token: str) -> str:
    if token.isupper() and len(token) > 1:
        return "U"
    if token[0].isupper():
        return "T"
    return "L"


class _Begins(dict):
    """Per token whether a name may begin with it: a family name, a capitalised syllable, or a capitalised word of plain letters."""

    def __missing__(self, token: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[token] = bare(token) in _family or token[0].isupper() and (token.isascii() and token.lower() not in _not_name or _syllable.fullmatch(bare(token)) is not None)
        return self[token]


_begins = _Begins()


#: How far before an item what tells of it may stand; longer than any of the patterns that end there.
BEFORE = 120


def _person_spans(text: str):
    """Spans of full personal names, from left to right."""
    tokens = [(m.start(), m.end(), m[0]) for m in _token.finditer(text)]
    spans, i, n = [], 0, len(tokens)

    def joined(k):
        return k + 1 < n and text[tokens[k][1] : tokens[k + 1][0]] == " "

    def cue(start):
        return _cue.search(text[max(0, start - BEFORE) : start]) is not None

    while i < n:
        start, end, token = tokens[i]
        if not _begins[token]:
            i += 1
            continue
        low, flat, case = token.lower(), bare(token), _case(token)
        if flat in _family and joined(i):
            two = tokens[i + 1][2]
            three = tokens[i + 2][2] if joined(i + 1) else ""
            ascii_name = (token + two + three).isascii()
            right = ascii_name or low in _family_exact or low in _family
            known = bare(two) in _middle and (two.isascii() and ascii_name or two.lower() in _middle_exact)
            same = case == _case(two) or (case == "U" and len(two) == 1)
            if known and right and same and three:
                shape = _case(three) == case
                if case == "L":
                    cued = start == 0 or text[max(0, start - BEFORE) : start].rstrip(" ")[-1:] in ".?!:,;(\n" or cue(start)
                    shape = shape and (cued or (not ascii_name and low in _family_exact and low not in _weak))
                if shape:
                    k = i + 2
                    if joined(k):
                        four = tokens[k + 1][2]
                        # A given name of two syllables, both of which are known from names.
                        double = bare(three) in _syllables_of_names and bare(four) in _syllables_of_names
                        if _case(four) == case and (case == "T" or double):
                            if case != "T" or double or not joined(k + 1) or _case(tokens[k + 2][2]) != "T":
                                k += 1
                    spans.append((start, tokens[k][1]))
                    i = k + 1
                    continue
            if case in "TU" and same and not (known and three) and cue(start):
                k = i + 1
                while k < i + 3 and joined(k) and _case(tokens[k + 1][2]) == case:
                    k += 1
                if low in _family_exact or all(t[2].isascii() for t in tokens[i : k + 1]):
                    spans.append((start, tokens[k][1]))
                    i = k + 1
                    continue
        if case in "TU" and flat not in _family and joined(i) and joined(i + 1) and _syllable.fullmatch(flat) and low not in _not_name:
            # A family name that isn't listed: a middle and a given name follow, and something before it leads to a name.
            two, three = tokens[i + 1][2], tokens[i + 2][2]
            ascii_name = (token + two + three).isascii()
            known = bare(two) in _middle and (ascii_name or two.lower() in _middle_exact)
            if known and _case(two) == _case(three) == case and _syllable.fullmatch(bare(three)) and cue(start):
                k = i + 2
                if joined(k) and _case(tokens[k + 1][2]) == case and bare(tokens[k + 1][2]) in _syllables_of_names:
                    k += 1
                spans.append((start, tokens[k][1]))
                i = k + 1
                continue
        if case in "TU" and token.isascii() and joined(i) and low not in _not_name:
            two = tokens[i + 1][2]
            if two.isascii() and _case(two) in "TU" and len(token) > 2 and len(two) > 2 and two.lower() not in _not_name:
                foreign = [t for t in (low, *two.lower().split("-")) if not _syllable.fullmatch(t)]
                after = text[tokens[i + 1][1] : tokens[i + 1][1] + 2]
                if foreign and not after.startswith(("'", "’")):
                    k = i + 1
                    if joined(k) and tokens[k + 1][2].isascii() and _case(tokens[k + 1][2]) in "TU" and tokens[k + 1][2].lower() not in _not_name and len(tokens[k + 1][2]) > 2:
                        k += 1
                    spans.append((start, tokens[k][1]))
                    i = k + 1
                    continue
        i += 1
    return spans


# ------------------------------------------------------------------ all together
_any = regex.compile(r"\d{2}|\d [\d ]|@|(?i:\bat\b|còng|\bcong\b)|\p{Lu}")


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of a text in its one form, by start."""
    found: list = []
    work, letters = text, None

    def take(start, end, kind):
        nonlocal letters
        found.append((start, end, kind))
        letters = letters or list(work)
        letters[start:end] = "\x00" * (end - start)

    def closed():
        """The text with what has been taken blanked, written anew only once for each type."""
        nonlocal work, letters
        if letters:
            work, letters = "".join(letters), None
        return work

    def before(start, size=BEFORE):
        return "".join(letters[max(0, start - size) : start]) if letters else work[max(0, start - size) : start]

    for m in _email.finditer(work) if _email_hint.search(work) else ():
        take(m.start(), m.end(), "EMAIL")
    for m in _address.finditer(closed()) if _address_hint.search(closed()) else ():
        if not _office.search(before(m.start(), 60)):
            take(m.start(), m.end(), "ADDRESS")
    for m in _passport.finditer(closed()) if _passport_hint.search(closed()) else ():
        if _passport_cue.search(before(m.start())):
            take(m.start(), m.end(), "NATIONAL_ID")
    for m in _insurance.finditer(closed()):
        if sum(c.isdigit() for c in m[0]) == 10 and _insurance_cue.search(before(m.start())):
            take(m.start(), m.end(), "NATIONAL_ID")
    for m in _card.finditer(closed()):
        take(m.start(), m.end(), "NATIONAL_ID")
    for m in _phone.finditer(closed()):
        if not _not_phone.search(before(m.start(), 40)):
            take(m.start(), m.end(), "PHONE")
    for m in _old_card.finditer(closed()):
        if _old_cue.search(before(m.start()).replace("\x00", "0")):
            take(m.start(), m.end(), "NATIONAL_ID")
    for start, end in _person_spans(closed()):
        take(start, end, "PERSON")
    return sorted(found)


class Surrogates:
    """Keyed replacements. ``salt`` sets redraws for entities whose draw collided."""

    # Parts of invented names, by gender.
    MALE = ("Văn", "Đình", "Hữu", "Khắc", "Quang", "Bá", "Đức", "Công", "Duy", "Thế")
    FEMALE = ("Thị", "Mỹ", "Thu", "Ngọc", "Diệu", "Kim", "Bích", "Hồng", "Cẩm", "Tuyết")
    EITHER = ("Minh", "Bảo", "Khánh", "Hải", "Thanh", "Xuân", "Hoài", "Nhật", "An", "Gia")
    GIVEN = (
        "Kỷ Lạc Sâm Tùng Thạch Trúc Bằng Thông Vinh Cúc Liễu Trầm Dung Hiền Phụng Đào Vân Tiên Nhạn Sương Thúy Lê Băng Giáng Hân Khuyên "
        "Ly Mẫn Nga Oanh Phấn Quyên Sao Tâm Uyên Vy Xoan Ý Ân Biên Chiến Dũng Đạt Giáp Hoan Kiên Lực Nghĩa Phong Quý Sáu Tài Thuận Út"
    ).split()
    FIRST = ("Alder", "Bryn", "Corin", "Dara", "Elwin", "Fenna", "Garrick", "Hanne", "Ilse", "Joss", "Kester", "Linnet")
    LAST = ("Ashdown", "Birkett", "Calloway", "Dunmore", "Ellery", "Farrow", "Gladwin", "Harcourt", "Ingram", "Kestrel", "Lockyer")
    # Surnames are a start and two ends.
    ENDS = ("ash", "bourne", "combe", "dale", "ert", "fold", "gate", "holm", "ing", "ley", "mere", "ney", "ock", "ridge", "stead", "wick")
    STREETS = ("Bạch Dương", "Cây Thị", "Đồng Hồ", "Gác Chuông", "Hồ Sen", "Lá Phong", "Mái Ngói", "Nắng Mai", "Sóng Xanh", "Tre Ngà")

    def __init__(self, key: str, salt: dict | None = None):
        self.key, self.salt = key.encode(), salt or {}

    def entity(self, kind: str, text: str) -> str:
        """What makes two mentions one entity: letters with their accents and digits, without case and grouping."""
        folded = unicodedata.normalize("NFC", text.lower()) if kind == "PERSON" else bare(text)
        if kind == "PHONE":
            digits = "".join(c for c in folded if c.isdigit())
            for lead in ("0084", "84"):
                if digits.startswith(lead) and not folded.startswith("0 ") and len(digits) >= 11:
                    digits = "0" + digits[len(lead) :]
            return digits
        if kind == "EMAIL":
            folded = regex.sub(_at.replace("còng", "cong").replace("móc", "moc"), "@", folded)
            folded = regex.sub(_dot.replace("chấm", "cham"), ".", folded)
        return "".join(c for c in folded if c.isalnum() or c in "@./")

    def draw(self, kind: str, entity: str, n: int) -> int:
        salt = self.salt.get((kind, entity), "")
        digest = hashlib.blake2b(f"{kind}\x00{entity}\x00{salt}".encode(), key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(digest, "big") % n

    def digits(self, kind: str, text: str) -> str:
        """A keyed permutation of the digits' places and values within their length: a Feistel walk, so no two meet."""
        raw = plain = "".join(c for c in text if c.isdigit())
        if kind == "PHONE":  # the national number, so that both ways to write it stay one
            plain = self.entity(kind, text)
        lead = raw[: len(raw) - len(plain) + 1] if len(plain) < len(raw) else ""
        keep = 2 if kind == "PHONE" and plain.startswith("00") else 1
        head, tail = plain[:keep], plain[keep:]
        half = len(tail) // 2
        a, b = tail[:half], tail[half:]
        for turn in range(8):
            if turn % 2 == 0 and a:
                a = str((int(a) + self.draw(f"{kind}{turn}", b, 10 ** len(a))) % 10 ** len(a)).zfill(len(a))
            elif b:
                b = str((int(b) + self.draw(f"{kind}{turn}", a, 10 ** len(b))) % 10 ** len(b)).zfill(len(b))
        made = head + a + b
        fresh = iter(lead + made[1:] if lead else made)
        return "".join(next(fresh) if c.isdigit() else c for c in text)

    def gender(self, name: str) -> str:
        """f, m or neither, by the middle name if that tells, else by the given name; without accents only what is clear."""
        words = name.split()[1:]
        plain = name.isascii()
        fold = bare if plain else str.lower

        def told(word, female, male):
            mine = fold(word)
            f, m = mine in {fold(n) for n in female}, mine in {fold(n) for n in male}
            return "f" if f and not m else "m" if m and not f else ""

        for word in words[:-1]:
            if fold(word) in (fold("Thị"), fold("Văn")):
                return "f" if fold(word) == fold("Thị") else "m"
        for word in reversed(words):
            gender = told(word, (*GIVEN_FEMALE, *self.FEMALE), (*GIVEN_MALE, *self.MALE))
            if gender:
                return gender
        return ""

    def mail(self, text: str, entity: str, redraws: int) -> str:
        """An address of the same make: parts, digits, marks and disguises stay where they are, the last label is a reserved one."""
        at = regex.search(rf"(?i){_at}|\s+at\s+", text)
        local, sign, domain = text[: at.start()], at[0], text[at.end() :]
        _, _, host = entity.partition("@")

        def filled(part, n, keep):
            out = []
            for piece in regex.split(rf"(?i)({_dot}|[._+-])", part):
                if regex.fullmatch(rf"(?i){_dot}|[._+-]", piece):
                    out.append(piece)
                    continue
                made = ""
                for c in piece:
                    if c.isdigit():
                        n, digit = divmod(n, 10)
                        made += str(digit)
                    elif c.isalpha():
                        n, letter = divmod(n, 26)
                        made += chr((65 if c.isupper() else 97) + letter)
                    else:
                        made += c
                out.append(made)
            if keep:
                out[-1] = "EXAMPLE" if out[-1].isupper() else "example"
            return "".join(out)

        # Redraws add a letter each, so that short names don't run out.
        name = filled(local + "x" * redraws, self.draw("EMAIL", entity, 2**400), False)
        return f"{name}{sign}{filled(domain, self.draw('HOST', host, 2**400), True)}"

    def make(self, kind: str, text: str) -> str:
        entity = self.entity(kind, text)
        # Each redraw of a name takes a part more, so that there are names enough for any number of persons.
        redraws = int(self.salt.get((kind, entity), 0))
        if kind in ("PHONE", "NATIONAL_ID"):
            return self.digits(kind, text)
        if kind == "EMAIL":
            return self.mail(text, entity, redraws)
        if kind == "ADDRESS":
            n = self.draw(kind, entity, 10**9)
            made = f"số {n % 89_000 + 1} đường {self.STREETS[n % len(self.STREETS)]}, phường {n // 89_000 % 9_000 + 1}"
        elif bare(text.split()[0]) in _family:
            gender = self.gender(text)
            middle = self.FEMALE if gender == "f" else self.MALE if gender == "m" else self.EITHER
            n = self.draw(kind, entity, 2**120)
            words = []
            for part in (FAMILY, middle, self.GIVEN, self.GIVEN, *[self.GIVEN] * redraws):
                n, place = divmod(n, len(part))
                words.append(part[place])
            made = " ".join(words)
        else:
            n = self.draw(kind, entity, 2**120)
            words = []
            for part in (self.FIRST, *[self.LAST, self.ENDS, self.ENDS] * (2 + redraws)):
                n, place = divmod(n, len(part))
                words.append(part[place])
            made = f"{words[0]} {'-'.join(''.join(words[i : i + 3]) for i in range(1, len(words), 3))}"
        if text.isascii():
            made = "".join(c for c in unicodedata.normalize("NFD", made) if not unicodedata.combining(c))
            made = made.replace("đ", "d").replace("Đ", "D")
        return made.upper() if text.isupper() else made.lower() if text.islower() else made


class _Find:
    """Items of each text; one output row per item."""

    def __call__(self, batch):
        out: dict = {"field": [], "row_id": [], "pii_type": [], "item_no": [], "start_pos": [], "end_pos": [], "item": []}
        for field, row, text in zip(batch["field"], batch["row_id"], batch["text"]):
            form, spans = plain_form(text)
            if not _any.search(form) and not form.islower():
                continue
            count: dict = {}
            for start, end, kind in detect(form):
                count[kind] = count.get(kind, 0) + 1
                a, b = (start, end) if spans is None else (spans[start][0], spans[end - 1][1])
                for name, value in (
                    ("field", field), ("row_id", row), ("pii_type", kind), ("item_no", count[kind]), ("start_pos", a), ("end_pos", b), ("item", form[start:end]),
                ):
                    out[name].append(value)
        return out


class _Replace:
    """Each text with placeholders, and with surrogates."""

    def __init__(self, key: str, salt: dict | None = None):
        self.surrogates = Surrogates(key, salt)

    def __call__(self, batch):
        marked, natural = [], []
        given = self.surrogates.salt
        for text, salts in zip(batch["text"], batch.get("salts") or [None] * len(batch["text"])):
            self.surrogates.salt = {(x["pii_type"], x["entity"]): x["salt"] for x in salts} if salts else given
            if text is None:
                marked.append(None)
                natural.append(None)
                continue
            form, spans = plain_form(text)
            places, m, s, at = {}, [], [], 0
            for start, end, kind in detect(form):
                a, b = (start, end) if spans is None else (spans[start][0], spans[end - 1][1])
                item = form[start:end]
                known = places.setdefault(kind, {})
                number = known.setdefault(self.surrogates.entity(kind, item), len(known) + 1)
                m += [text[at:a], f"[{kind}_{number}]"]
                s += [text[at:a], self.surrogates.make(kind, item)]
                at = b
            marked.append("".join(m) + text[at:])
            natural.append("".join(s) + text[at:])
        return {"field": batch["field"], "row_id": batch["row_id"], "redacted": marked, "surrogate": natural}


def items(texts: DataFrame) -> DataFrame:
    """(field, row_id, text) to one row per item, its place in the text as stored included. No shuffle."""
    schema = "field string, row_id bigint, pii_type string, item_no int, start_pos int, end_pos int, item string"
    return map_batches(texts.where("text is not null and text <> ''"), _Find(), schema)


def _own(key: str | None) -> str:
    """The caller's key, or a random one."""
    return key or secrets.token_hex(32)


def replaced(texts: DataFrame, key: str | None = None, salt: dict | None = None) -> DataFrame:
    """(field, row_id, text) to the text with placeholders and the text with surrogates. No shuffle."""
    key = _own(key)
    return map_batches(texts, _Replace(key, salt), "field string, row_id bigint, redacted string, surrogate string")


def _seen(kind: str, made: str) -> str:
    """A surrogate without case, accents and, but for names, what isn't a letter or digit: equal for what reads alike."""
    folded = bare(made)
    return folded if kind == "PERSON" else "".join(c for c in folded if c.isalnum() or c in "@./")


class _Draw:
    def __init__(self, key, salt):
        self.surrogates = Surrogates(key, salt)

    def __call__(self, batch):
        pairs = list(zip(batch["pii_type"], batch["item"]))
        return {
            "pii_type": batch["pii_type"],
            "entity": [self.surrogates.entity(k, t) for k, t in pairs],
            "made": [_seen(k, self.surrogates.make(k, t)) for k, t in pairs],
            "item": batch["item"],
        }


def collisions(found: DataFrame, key: str | None = None, salt: dict | None = None) -> DataFrame:
    """Surrogates that stand for more than one entity after redraws, with the number of entities; none is left.

    Entities are made distinct before they are grouped by surrogate, so a name
    that fills a third of all rows is one row here. With ``salt`` given, its
    redraws are tested instead.
    """
    key = _own(key)
    schema = "pii_type string, entity string, made string"
    items = found.select("pii_type", "item").distinct()
    if salt is not None:
        drawn = map_batches(items, _Draw(key, salt), schema)
    else:
        salts = redrawn(found, key)
        known = map_batches(items, _Draw(key, {}), schema + ", item string").drop("made").join(salts, ["pii_type", "entity"], "left")
        drawn = map_batches(known.select("pii_type", "item", "salt"), _Redraw(key), "pii_type string, item string, salt string, " + schema.split(", ", 1)[1])
    return drawn.select("pii_type", "entity", "made").distinct().groupBy("pii_type", "made").agg(F.count("*").alias("n_entities")).where("n_entities > 1")


class _Redraw:
    """Entities of items, and the surrogates that they draw with their salts."""

    def __init__(self, key):
        self.surrogates = Surrogates(key)

    def __call__(self, batch):
        entities, made = [], []
        for kind, item, salt in zip(batch["pii_type"], batch["item"], batch["salt"]):
            entities.append(self.surrogates.entity(kind, item))
            self.surrogates.salt = {(kind, entities[-1]): salt} if salt else {}
            made.append(_seen(kind, self.surrogates.make(kind, item)))
        return {"pii_type": batch["pii_type"], "item": batch["item"], "salt": batch["salt"], "entity": entities, "made": made}


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(pii_type, entity, salt): salts for entities whose surrogate fell together with another's.

    All but the first entity of a surrogate are drawn anew, and all are checked
    again, until no collision is left. Digits are permuted and can't collide.
    """
    schema = "pii_type string, item string, salt string, entity string, made string"
    items = found.where(F.col("pii_type").isin("PERSON", "ADDRESS", "EMAIL")).select("pii_type", "item").distinct()
    drawn = map_batches(items.withColumn("salt", F.lit(None).cast("string")), _Redraw(key), schema)
    drawn = drawn.groupBy("pii_type", "entity").agg(F.min_by(F.struct("item", "salt", "made"), "item").alias("x")).select("pii_type", "entity", "x.*")
    order = Window.partitionBy("pii_type", "made").orderBy(F.col("salt").cast("int").asc_nulls_first(), "entity")
    while True:
        drawn = cut(drawn.withColumn("n", F.row_number().over(order)))
        if drawn.where("n > 1").isEmpty():
            return drawn.where("salt is not null").select("pii_type", "entity", "salt")
        more = F.when(F.col("n") > 1, (F.coalesce(F.col("salt").cast("int"), F.lit(0)) + 1).cast("string")).otherwise(F.col("salt"))
        drawn = map_batches(drawn.select("pii_type", "item", more.alias("salt")), _Redraw(key), schema)


class _Entity:
    def __init__(self, key):
        self.surrogates = Surrogates(key)

    def __call__(self, batch):
        entities = [self.surrogates.entity(k, t) for k, t in zip(batch["pii_type"], batch["item"])]
        return {"field": batch["field"], "row_id": batch["row_id"], "pii_type": batch["pii_type"], "entity": entities}


def replaced_distinct(texts: DataFrame, key: str | None = None) -> DataFrame:
    """``replaced`` with the salts of ``redrawn``, joined to the texts that need them: different entities keep different surrogates."""
    key = _own(key)
    found = items(texts)
    held = map_batches(found.select("field", "row_id", "pii_type", "item"), _Entity(key), "field string, row_id bigint, pii_type string, entity string")
    salts = held.join(redrawn(found, key), ["pii_type", "entity"]).groupBy("field", "row_id").agg(F.collect_set(F.struct("pii_type", "entity", "salt")).alias("salts"))
    return replaced(texts.join(salts, ["field", "row_id"], "left"), key)


#: Entities that ``salted`` may send to the workers.
MOST_SALTS = 100_000


def salted(found: DataFrame, key: str | None = None) -> dict:
    """Redraws for entities whose surrogate fell together with another's, for ``replaced``; ``replaced_distinct`` has no bound.

    All but the first entity of a surrogate, in order, get a salt. Collisions are
    rare draws, not data, but their number is checked before they come to the driver.
    """
    rows = redrawn(found, _own(key)).limit(MOST_SALTS + 1).collect()
    if len(rows) > MOST_SALTS:
        raise ValueError("more collisions than salts may be sent; use longer surrogates")
    return {(row.pii_type, row.entity): row.salt for row in rows}
