"""Defective question-answer pairs, each with its one defect (problem 4).

Languages are compared by the posteriors of a character n-gram naive Bayes
model of question and answer body. Truncation is told by the likelihood of the
end-of-text sign after an answer's last characters, in a character n-gram model
that is counted over all answers and backs off from long contexts to short ones.

At most one defect per pair, the first of: EMPTY, COPIES_QUESTION, REFUSAL,
OTHER_LANGUAGE, TRUNCATED.

Defined results: a null, blank, markup-only or placeholder answer is EMPTY; with
a null or empty question only EMPTY, REFUSAL and TRUNCATED can be told. Equal
rows get equal results; every row counts on its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm import lookalike
from verdigris.llm.pii import bare
from verdigris.session import cut, map_batches

#: Labelled texts per language that the language model is fitted on, and their greatest length.
FIT_TEXTS, FIT_CHARS = 200, 3000
#: Languages that the labels may name; the fitted sample is at most this times ``FIT_TEXTS``.
MOST_LANGUAGES = 500
#: Context lengths of the end-of-text model, each twice the one before; 0 is the rate of ends overall.
ORDERS = (0, 4, 8, 16, 32)
#: Weight that a shorter context's estimate has, in sightings of the longer one.
BACKOFF = 2.0
#: An answer without a full stop is complete where its end is at least this likely.
COMPLETE = 0.5

# ------------------------------------------------------------------ languages
_unit = regex.compile(r"[\p{Latin}\p{M}]+|[^\s\p{Latin}\p{P}\p{N}\p{S}\p{M}]")


def _grams(unit: str):
    if len(unit) == 1 and not unit.isascii():
        return [unit]
    padded = f"^{unit}$"
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]


#: Weight of the flat part of each language's n-gram distribution, which is what unseen n-grams get.
FLAT = 0.01


class Languages:
    """Character n-gram naive Bayes with a uniform prior; words met before keep their row of scores.

    Labels are partly wrong: texts that the first fit puts elsewhere are left out
    of the second.
    """

    def __init__(self, texts: list[tuple[str, str]]):
        self._fit(texts)
        kept = [(language, text) for language, text in texts if self.posteriors(text).get(language, 0) > 0.5]
        if {language for language, _ in kept} == set(self.names):
            self._fit(kept)

    def _fit(self, texts):
        counts: dict[str, dict] = {}
        for language, text in texts:
            low = text.lower()
            forms = [low, bare(low)] if language == "vi" else [low]
            mine = counts.setdefault(language, {})
            for form in forms:
                for unit in _unit.findall(form):
                    for gram in _grams(unit):
                        mine[gram] = mine.get(gram, 0) + 1
        self.names = sorted(counts)
        vocabulary = len(set().union(*counts.values())) + 1 if counts else 1
        floor = math.log(FLAT / vocabulary)
        self.scores: dict = {}
        for place, name in enumerate(self.names):
            total = sum(counts[name].values())
            for gram, count in counts[name].items():
                row = self.scores.setdefault(gram, [floor] * len(self.names))
                row[place] = math.log((1 - FLAT) * count / total + FLAT / vocabulary)
        self.unseen = [0.0] * len(self.names)
        self.rows: dict = {}
        self.matrix = np.zeros((4096, max(1, len(self.names))))

    #: Words whose scores are remembered.
    MOST_ROWS = 200_000

    def _row(self, unit: str) -> int:
        """The place of the word's scores."""
        grams = _grams(unit)
        sums = [0.0] * len(self.names)
        for gram in grams:
            for k, s in enumerate(self.scores.get(gram, self.unseen)):
                sums[k] += s
        place = self.rows[unit] = len(self.rows)
        if place >= len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[place] = [s / len(grams) * min(len(grams), 6) for s in sums]
        return place

    def posteriors_of(self, texts: list[str]) -> np.ndarray:
        """A row of probabilities per text, of zeros for a text without letters; all texts in a few array operations."""
        if len(self.rows) > self.MOST_ROWS:
            self.rows.clear()
        known, places, sizes = self.rows, [], []
        for text in texts:
            units = _unit.findall(text.lower()) if self.names else []
            places += [known[u] if u in known else self._row(u) for u in units]
            sizes.append(len(units))
        out = np.zeros((len(texts), len(self.names)))
        some = np.flatnonzero(sizes)
        if len(some):
            begins = (np.cumsum(sizes) - sizes)[some]
            sums = np.add.reduceat(self.matrix[places], begins, axis=0)
            weights = np.exp(sums - sums.max(axis=1, keepdims=True))
            out[some] = weights / weights.sum(axis=1, keepdims=True)
        return out

    def posteriors(self, text: str) -> dict:
        """Language to probability; empty for a text without letters."""
        row = self.posteriors_of([text])[0]
        return dict(zip(self.names, row.tolist())) if row.any() else {}


def fit_languages(documents: DataFrame) -> Languages:
    """The model of a bounded sample of labelled rows: ``FIT_TEXTS`` per language, by hash order."""
    # Labels in one spelling; what names no language isn't a label.
    label = F.lower(F.regexp_extract(F.trim("lang"), r"^\p{L}+", 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (
        documents.where(F.length("text").between(40, FIT_CHARS))
        .select("doc_id", label.alias("lang"), "text")
        .where(~F.col("lang").isin("", "und", "mul", "mis", "zxx", "unknown"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= FIT_TEXTS)
        .orderBy("lang", "n")
        .limit(MOST_LANGUAGES * FIT_TEXTS + 1)
        .collect()
    )
    if len(rows) > MOST_LANGUAGES * FIT_TEXTS:
        raise ValueError("the labels name more languages than the model may hold")
    return Languages([(row.lang, row.text) for row in rows])


# ------------------------------------------------------------------ labels
_label = (
    r"(?:(?:câu )?trả lời|(?:cau )?tra loi|đáp án|dap an|đáp|câu hỏi|cau hoi|bạn hỏi|ban hoi|hỏi|hoi|question|answer|q|a|kết luận|ket luan)"
)
_greeting = r"(?:(?:xin |kính )?chào (?:bạn|anh|chị|anh chị|quý khách)|(?:xin |kinh )?chao (?:ban|anh|chi|anh chi)|hello|hi|dear [^,!.\n]{1,20}|theo quy định hiện hành|theo quy dinh hien hanh)"
_lead = regex.compile(rf"(?i)^[\s*_#>`\"“”:.,!–-]*(?:{_label}[\s*_]*[:：][\s*_]*|{_greeting}[\s*_]*[,!.:：][\s*_]*)")
_tail = regex.compile(r"(?is)\n+\W*(?:căn cứ pháp lý|can cu phap ly|giấy tờ cần có|giay to can co)\W*(?:\n.*)?$|\*(?:nguồn|nguon)[^*]*\*\s*$")
_quoted = regex.compile(r"«[^«»]*»|“[^“”]*”|\"[^\"\n]*\"|‘[^‘’]*’|「[^「」]*」|『[^『』]*』|`[^`]*`|\([^()]*\)")
_markup = regex.compile(r"</?\p{L}[^<>]*>|<!--.*?-->|```\w*")
_void = regex.compile(r"(?i)^\W*(?:null|none|n/?a|nan|nil|undefined|trống|trong|không có|empty)?\W*$")


def _parted(pattern, signs: str):
    """``pattern`` replaced by a blank, in texts that hold one of the signs that it needs."""
    needed = regex.compile(signs)
    return lambda text, new=" ": pattern.sub(new, text) if needed.search(text) else text


_no_markup, _no_quotes = _parted(_markup, "[<`]"), _parted(_quoted, "[«“\"‘「『`(]")
_no_tail = _parted(_tail, "[\n*]")


def body_of(answer: str) -> str:
    """The answer without greetings and labels before it."""
    while True:
        m = _lead.match(answer)
        if not m or not m[0]:
            return answer
        answer = answer[m.end() :]


_silent = regex.compile(r"[\W_]+")


def _letters(text: str) -> str:
    return _silent.sub("", lookalike.by_table(text).lower())


_letters_of_labels = "|".join(
    _letters(w)
    for w in ("câu hỏi", "bạn hỏi", "hỏi", "trả lời", "câu trả lời", "cau hoi", "ban hoi", "tra loi", "question", "answer", "chào bạn", "đáp")
)
_label_head = regex.compile(rf"(?:{_letters_of_labels})")
#: Letters by which an answer's start is compared before all of it is folded.
HEAD = 12


def _head(text: str) -> str:
    """The first ``HEAD`` letters; the text's last character may yet take marks, so it isn't cut there."""
    size = 8 * HEAD
    while size < len(text):
        found = _letters(text[:size])
        if len(found) > HEAD:
            return found[:HEAD]
        size *= 2
    return _letters(text)[:HEAD]


def copies(question: str, answer: str) -> bool:
    """Whether the answer is the question, once or more often, and labels and greetings alone."""
    body, question = body_of(answer), body_of(question)
    head, start = _head(body), _head(question)
    # What consists of them begins with one of them.
    if not start or not head.startswith(start) and not _label_head.match(head):
        return False
    asked, said = _letters(question), _letters(body)
    return asked in said and regex.fullmatch(rf"(?:{_letters_of_labels}|{regex.escape(asked)})+", said) is not None


# ------------------------------------------------------------------ refusals, on text without accents
_refuses = regex.compile(
    r"\b(?:khong the(?! tu choi)|khong duoc phep|chua the|khong co kha nang|khong co tham quyen|tu choi|khong|chua)\b(?:(?!\bnhung\b|\bsong\b|\btuy nhien\b).){0,40}?"
    r"(?<!khoan |bo phan |can bo |cong ty )\b(?:tra loi|tu van|ho tro|giup|ket luan|dua ra|cung cap|giai dap|binh luan|y kien)\b"
    r"|\b(?:toi|minh|em|bot|chung toi) (?:xin |danh |cung )?chiu\b(?! trach| phi| phat| su| trach nhiem| anh huong)|\b(?:bo qua|mien ban|khong ban|ne) (?:den |ve |toi )?(?:cau hoi|cau nay|noi dung nay|yeu cau|chu de)\b|\b(?:skip|pass on|rather not (?:answer|discuss))\b|\bngoai pham vi\b|\b(?:khong|chua) (?:co|du|tim thay|tim duoc)(?: \w+){0,3} (?:thong tin|can cu|du lieu|co so|tai lieu|cau tra loi)"
    r"|\bchua du\b|\b(?:can'?t|cannot|can not|unable|not able|not allowed|not permitted|decline|won'?t|will not)\b.{0,40}\b(?:help|answer|advise|assist|comment|provide|say|respond|discuss)\b"
    r"|\boutside (?:of )?(?:what|my|the scope)|\bbeyond (?:my|the) scope|\bno answer can\b|\bno information\b"
    r"|无法(?:回答|提供)|不能(?:回答|提供)|お答えできま|回答できま|답변할 수 없|답변드릴 수 없"
)
_substance = regex.compile(r"\b(?:nhung|song|tuy nhien|muc toi thieu|but|however|thoi han la|van phai)\b|\d")
_support = regex.compile(
    r"^\W*(?:toi |chung toi )?(?:xin loi|rat tiec|rat xin loi|mong (?:ban|anh|chi)|thanh that|xin cam on|cam on|vui long|(?:ban|anh|chi|anh chi) (?:co the |nen |hay |vui long |can )?(?:lien he|tim|hoi|gap|gui|tham khao)|"
    r"chao|kinh chao|than men|tran trong|thank|please|sorry|i'?m sorry|i am sorry|we are sorry|hi\b|hello|chuc|ban tu van|with (?:kind|best) regards|try again|hay )"
)
# An apology before a refusal, with the "but" that leads on from it: it gives no substance.
_sorry = regex.compile(
    r"^\W*(?:(?:toi|chung toi|minh|em|i|we)\W+)?(?:rat |thanh that |very |really )?(?:xin loi|tiec|i'?m (?:very |so |really )?sorry|i am (?:very |so |really )?sorry|we are sorry|we'?re sorry|sorry|unfortunately|i apologi[sz]e|apologies)"
    r"(?: ban| anh chi| quy khach)?\W*(?:nhung|song|but)?\W+(?=\w)"
)
_sentences = regex.compile(r"[^.!?。！？\n]+")


def refuses(answer: str) -> bool:
    """Every sentence declines, excuses itself or sends elsewhere, and one at least declines."""
    declined = False
    for m in _sentences.finditer(body_of(_no_tail(answer, ""))):
        sentence = bare(lookalike.by_table(m[0])).replace("’", "'").strip(" \t*_-–:,;\"'“”()")
        if not any(c.isalnum() for c in sentence):
            continue
        rest = _sorry.sub("", sentence)
        if _refuses.search(rest) and not _substance.search(rest):
            declined = True
        elif not _support.search(sentence) or _substance.search(sentence):
            return False
    return declined


# ------------------------------------------------------------------ endings
_number = regex.compile(r"\d+(?:[.,]\d+)*")
_close = "\"'”’»)]」』）*_"
_stops = regex.compile(r"[.!?。！？។]+[\"'”’»)\]」』）*_]*(?=\s|$)|(?<=[。！？។])|\n+")
_marker = regex.compile(r"(?:[-*•–]|\d+[.)])")
_ended = regex.compile(r"[.!?。！？។][\"'”’»)\]」』）*_]*\s*$")
_last_break = regex.compile(r"(?r)[.!?。！？]\s|\n")


def dangling(text: str) -> bool:
    """Whether the text stops at a mark that asks for more, or at an item without content."""
    text = text.rstrip()
    return text.endswith(tuple(",;:([{/–—-…")) or text.endswith("...") or _marker.fullmatch(text[text.rfind("\n") + 1 :].lstrip(" \t")) is not None


def open_bracket(text: str) -> bool:
    """Whether the last sentence opens a bracket or quote that it doesn't close."""
    break_ = _last_break.search(text)
    last = text[break_.end() :] if break_ else text
    return any(last.count(a) > last.count(b) for a, b in ("()", "[]", "“”", "«»", "「」")) or text.count("```") % 2 == 1


def units(text: str) -> tuple[list[str], str]:
    """The sentences and lines that are followed by a full stop or another line, and what comes after them.

    Each begins with a sign of its own, or with its number in a list; numbers are made alike.
    """
    low = _number.sub("0", text.lower())
    found, start, lead = [], 0, "^"
    for m in _stops.finditer(low):
        part = low[start : m.start()].strip(_trim)
        start = m.end()
        if part == "0":
            lead = "^0. "
        elif part:
            found.append(lead + part)
            lead = "^"
    rest = low[start:].strip(_trim)
    return found, lead + rest if rest else ""


_trim = " \t\r\n" + _close
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def contexts(parts: list[str]):
    """Per order the print of the characters up to each place, as if each part had a margin before it.

    A print of twice the length is made of two, so all orders take a few array
    operations over all parts together.
    """
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    seen = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prints = [np.zeros(len(codes), np.int64)]
    row, width = (codes + np.uint64(1)) * _MIX[0], 1
    while width < ORDERS[-1]:
        earlier = np.zeros_like(row)
        earlier[width:] = np.where(seen[width:] > width, row[:-width], 0)
        row = (row ^ (row >> np.uint64(29))) * _MIX[1] + (earlier ^ (earlier >> np.uint64(31))) * _MIX[0] + np.uint64(width)
        width *= 2
        if width in ORDERS:
            prints.append(row.view(np.int64))
    return prints


def last_contexts(parts: list[str]) -> list[list[int]]:
    """Per part the prints of its end, from the shortest context to the longest."""
    if not parts:
        return []
    tails = [part[-ORDERS[-1] :] for part in parts]
    ends = np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails))) - 1
    return np.stack([row[ends] for row in contexts(tails)], axis=1).tolist()


#: Bits of the table that tells which contexts are asked for.
BITS = 1 << 23


class _Count:
    """How often the contexts that are asked for end a sentence or line, and how often they go on.

    ``asked`` only spares work: a bit set by another context lets one pass that
    no answer looks up.
    """

    def __init__(self, asked: np.ndarray):
        self.asked = asked

    def __call__(self, batch):
        parts, ends = [], []
        for answer in batch["answer"]:
            closed, rest = units(lookalike._ignorable.sub("", answer))
            parts += closed
            ends += [1] * len(closed)
            if rest:
                parts.append(rest)
                ends.append(0)
        if not parts:
            return {"context": [], "n_end": [], "n_on": []}
        prints = contexts(parts)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) - 1
        kind = np.zeros(stops[-1] + 1, np.int64)  # 0 goes on, 1 is an end, 2 is an answer's end without a full stop
        kind[stops] = np.where(np.array(ends) == 1, 1, 2)
        found, n_end, n_on = [], [], []
        for row in prints:
            keep = kind < 2
            keep[keep] = self.asked[row[keep] & (BITS - 1)]
            values, place = np.unique(row[keep], return_inverse=True)
            closed = np.bincount(place, kind[keep], len(values)).astype(np.int64)
            found.append(values)
            n_end.append(closed)
            n_on.append(np.bincount(place, minlength=len(values)) - closed)
        return {"context": np.concatenate(found), "n_end": np.concatenate(n_end), "n_on": np.concatenate(n_on)}


def _asked(open_ends: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, with those of all contexts set; built by the executors."""
    bit = F.col("context").bitwiseAND(F.lit(BITS - 1))
    blocks = (
        open_ends.select(F.explode("contexts").alias("context"))
        .select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # at most BITS / 32,768 rows of 4 KB
    )
    table = np.zeros(BITS + 32_768, bool)
    for row in blocks:
        # Block 1 begins with bit 1; bit 0 stands in block 0 or 1, depending on the sign.
        begin = (row.block - 1) * 32_768 + 1 if row.block else 0
        bits = np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little")
        table[begin : begin + 32_768] |= bits.astype(bool)
    return table[:BITS]


def _hash(answer: str) -> int:
    """The same for copies of an answer, whatever their case, accents, blanks and marks."""
    folded = _silent.sub("", bare(lookalike.by_table(answer)))
    return int.from_bytes(hashlib.blake2b(folded.encode(), digest_size=8).digest(), "big", signed=True)


class _Judge:
    """What a pair shows on its own."""

    def __init__(self, languages):
        self.languages = languages

    def others(self, pairs: list[tuple[str, str]]) -> list[bool]:
        """Per question and answer whether their languages are told apart with confidence."""
        asked = self.languages.posteriors_of([_no_quotes(question) for question, _ in pairs])
        said = self.languages.posteriors_of([_no_quotes(_no_tail(body_of(answer), "")) for _, answer in pairs])
        if not asked.size:
            return [False] * len(pairs)
        apart = (asked.argmax(1) != said.argmax(1)) & (asked.max(1) > 0.9) & (said.max(1) > 0.9)
        return apart.tolist()

    @staticmethod
    def plain(question, answer):
        """A defect that needs no model, or None."""
        if answer is None:
            return "EMPTY"
        said = lookalike._ignorable.sub("", _no_markup(answer))
        if _void.match(said) or _void.match(body_of(said)):
            return "EMPTY"
        if question and copies(question, said):
            return "COPIES_QUESTION"
        return "REFUSAL" if refuses(said) else None

    def judged(self, pairs: list[tuple]) -> list[tuple]:
        """Per pair (defect or None, what comes after the last full stop if its end is to be looked up)."""
        found = [(self.plain(question, answer), None) for question, answer in pairs]
        open_ = [k for k, (defect, _) in enumerate(found) if defect is None]
        texts = {k: lookalike._ignorable.sub("", pairs[k][1]) for k in open_}
        asked = [k for k in open_ if pairs[k][0]]
        apart = {k for k, other in zip(asked, self.others([(pairs[k][0], texts[k]) for k in asked])) if other} if asked else set()
        for k in open_:
            said = texts[k]
            if k in apart:
                found[k] = ("OTHER_LANGUAGE", None)
            elif dangling(said) or open_bracket(said.rstrip()):
                found[k] = ("TRUNCATED", None)
            else:
                found[k] = (None, ("" if _ended.search(said) else units(said)[1]) or None)
        return found

    def judge(self, question, answer):
        return self.judged([(question, answer)])[0]

    def __call__(self, batch):
        found = self.judged(list(zip(batch["question"], batch["answer"])))
        ends = iter(last_contexts([end for _, end in found if end]))
        return {
            "pair_table": batch["pair_table"],
            "row_id": batch["row_id"],
            "abstain": batch["abstain"],
            "defect": [defect for defect, _ in found],
            "answer_hash": [_hash(answer) if end else None for answer, (_, end) in zip(batch["answer"], found)],
            "contexts": [next(ends) if end else None for _, end in found],
        }


def ends(pairs: DataFrame, open_ends: DataFrame) -> DataFrame:
    """(contexts, p_end): per different end of answers that stop without a full stop, how likely the text ends there.

    Sightings come from all answers: ends of their sentences and lines, places
    where the context goes on, and ends of other answers (copies of an answer
    count once and never for it). The estimate of each order is mixed with that
    of the order below.
    """
    texts = pairs.where("answer is not null").select("answer")
    counted = map_batches(texts, _Count(_asked(open_ends)), "context bigint, n_end bigint, n_on bigint")
    counted = counted.groupBy("context").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))
    others = (
        open_ends.select("answer_hash", F.explode("contexts").alias("context")).distinct().groupBy("context").agg((F.count("*") - 1).alias("n_last"))
    )
    different = open_ends.select("contexts").distinct().select("contexts", F.posexplode("contexts").alias("place", "context"))
    sightings = different.join(others, "context").join(counted, "context", "left").na.fill(0, ["n_end", "n_on"])
    by_end = sightings.groupBy("contexts").agg(F.array_sort(F.collect_list(F.struct("place", "n_end", "n_on", "n_last"))).alias("seen"))

    def mixed(p, x):
        closed = x["n_end"] + x["n_last"]
        return (closed + BACKOFF * p) / (closed + x["n_on"] + BACKOFF)

    return by_end.select("contexts", F.aggregate("seen", F.lit(0.0), mixed).alias("p_end"))


def judged(pairs: DataFrame, languages: Languages) -> DataFrame:
    """(pair_table, row_id, question, answer, maybe abstain) to (pair_table, row_id, abstain, defect), defect null for sound pairs.

    One Python pass gives what a pair shows on its own; it is written once,
    without the texts. Answers that stop without a full stop are TRUNCATED unless
    their end is likely (``ends``); a second pass counts the contexts of their
    ends in all answers.
    """
    if "abstain" not in pairs.columns:
        pairs = pairs.withColumn("abstain", F.lit(None).cast("boolean"))
    pairs = pairs.select("pair_table", "row_id", "question", "answer", "abstain")
    schema = "pair_table string, row_id bigint, abstain boolean, defect string, answer_hash bigint, contexts array<bigint>"
    seen = cut(map_batches(pairs, _Judge(languages), schema))
    open_ends = seen.where("contexts is not null")
    likely = ends(pairs, open_ends).where(F.col("p_end") >= COMPLETE).select("contexts", F.lit(True).alias("complete"))
    # A frequent end is one row on this side; the hot answers are split by adaptive execution.
    ended = open_ends.join(likely, "contexts", "left").select(
        "pair_table", "row_id", "abstain", F.when(F.col("complete").isNull(), F.lit("TRUNCATED")).alias("defect")
    )
    return seen.where("contexts is null").select("pair_table", "row_id", "abstain", "defect").unionByName(ended)
