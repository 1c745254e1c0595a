"""Sentence starts in texts of any language and script (problem 8).

Boundary rules are compiled into a finite transducer. A scanner turns a text
into symbols, each named by what stands close around it: a full stop that can
end a sentence, one that ends it unless it numbers a line, an opening or closing
mark, a closing mark after a full stop, a blank that parts (Thai), and a line
break with what the lines before and after it look like. The transducer's state
is ``between`` two sentences or the depth of open marks, together with what kind
of line is being read and whether it began anew; its table says per symbol and
state the next state and whether a sentence ends.

Every text is cut into chunks of ``CHUNK`` characters. Each chunk yields, for
every state it may be entered in, the state it is left in and its starts: a
function of the state. The functions of a text are composed by a parallel prefix
scan, which gives each chunk its true entry, and with it its starts. Whatever
the size of the chunks, the starts are the same.

Defined results: null, empty and blank texts have no sentence; a text without
any mark is one sentence; places count code points from 0. More than ``LOOK``
blanks or full stops in a row part like an empty line; ``DEPTHS`` marks open at
once are told apart, further ones count with the last.
"""

from __future__ import annotations

import numpy as np
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import map_batches

#: Characters of a chunk, and how far the scanner looks around a symbol.
CHUNK, LOOK = 2_000, 200
#: Texts longer than this many chunks are spread over tasks, as pieces of so many chunks with what the scanner may
#: look at around them.
SPREAD, AROUND = 512, 600

# ------------------------------------------------------------------ the transducer
BETWEEN, DEPTHS = 0, 16  # within a line: 0 is between sentences, 1 + d is inside at depth d
WIDTH = 1 + DEPTHS
LINES = 6  # kind of line (0 none, 1 item, 2 heading), plus 3 for one that goes on from the line before
STATES = LINES * WIDTH
END, NUMBER_END, OPEN, CLOSE, CLOSE_END, BLANK = range(6)


class _Table(dict):
    """Per symbol three lists over the states: the next line, the next sentence state, whether a sentence ends.

    A line break is a symbol (parts after none, after an item, after a heading; next line anew; its kind).
    """

    def __missing__(self, symbol):
        lines, inside, ends = [], [], []
        for line in range(LINES):
            kind, stale = line % 3, line >= 3
            for state in range(WIDTH):
                depth, to, ended, next_line = state - 1, state, False, line
                if isinstance(symbol, tuple):
                    ended = symbol[0 if stale else kind]
                    next_line = symbol[4] + (0 if symbol[3] or kind else 3)
                elif symbol == OPEN:
                    to = min(state + 1, WIDTH - 1)
                elif symbol == CLOSE:
                    to = max(state - 1, 1)
                elif symbol == CLOSE_END:
                    ended, to = depth <= 1, max(state - 1, 1)
                elif depth == 0:
                    ended = symbol != NUMBER_END or stale
                if state == BETWEEN:
                    to, ended = BETWEEN, False
                lines.append(next_line)
                inside.append(BETWEEN if ended else to)
                ends.append(ended)
        self[symbol] = (lines, inside, ends, np.array(lines) * WIDTH, np.array(inside), np.array(ends))
        return self[symbol]


TABLE = _Table()

# ------------------------------------------------------------------ the scanner
_stop = "!?。！？｡។៕‼⁇⁈⁉؟।"
_closers = "\"'”’»)\\]」』）】〉》›"
_event = regex.compile(
    # What a symbol can begin with is looked at first; most characters are none of it.
    rf"(?=[.．…{_stop}\s“‘«(\[「『（【〈《‹„”’»)\]」』）】〉》›\"'])(?:(?P<stop>[.．…{_stop}]+)|(?P<line>(?:(?<![ \t\r\f ])[ \t\r\f ]++)?\n\s*+)|(?P<open>[“‘«(\[「『（【〈《‹„])|(?P<close>[”’»)\]」』）】〉》›])|(?P<straight>[\"'])"
    r"|(?P<thai>(?<=[\u0e00-\u0e7f][”»)\"]?)[ \u00a0]+(?=\S)|(?<=[^\s\u0e00-\u0e7f])[ \u00a0]+(?=[\u0e00-\u0e7f])))"
)
_partner = {"“": "”", "‘": "’", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》", "‹": "›", "„": "“”"}
_after = regex.compile(rf"[{_closers}]{{0,20}}")
_marks = "".join(dict.fromkeys("".join(_partner.values()) + "\"'"))
_caseless = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Khmer}\p{Lao}\p{Myanmar}]")
_spaceless = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Khmer}]")
_before = regex.compile(r"(?r)(?:[\p{L}\p{M}\p{N}]+(?:[.][\p{L}\p{M}\p{N}]+)*)$")
_marker = r"(?:\d{1,3}(?:\.\d{1,3})*[.)]|\(\d{1,3}\)|[a-zđ][.)]|[ivx]{1,4}[.)]|[-–—•*+·▪])"
_item = regex.compile(rf"\s*{_marker}\s+\S")
# Words that head a numbered part.
_part = (
    r"(?:điều|chương|mục|phần|phụ lục|khoản|tiết|quyển|dieu|chuong|muc|phan|phu luc|khoan|article|art\.|annexe?|appendix|chapter|section|part|"
    r"chapitre|titre|partie|section|ข้อ|มาตรา|หมวด|มาตรา|ภาคผนวก|មាត្រា|ជំពូក|ឧបសម្ព័ន្ធ)"
)
_heading = regex.compile(
    rf"(?i)^\s*(?:{_part}\s*(?:\d+|[ivxlc]+\b)(?:[.\d]*)|第\s*[\d〇一二三四五六七八九十百]+\s*[条章节節項编編]|제\s*\d+\s*[조장절]|(?:別紙|附件|附录|付録|부록|별지)\s*\d*)"
)
_heading_number = regex.compile(rf"(?i)^\s*(?:{_part}\s*)?(?:\d+|[ivxlc]+|[a-zđ])(?:\.\d+)*$")
# Abbreviations whose point never ends a sentence (titles, and words before a number or a name).
NEVER = set(
    "mr mrs ms dr prof st cf vs viz approx eg ie e.g i.e resp gen col capt lt sgt rev hon pres gov "
    "gs ts ths pgs bs ks ls tp tx tt q h x p k đ đt dt sđt sn m mm mme mlle me env p.ex vgl bzw z.b sr sra bd apt ste mgr".split()
)
# Abbreviations before a number.
BEFORE_NUMBER = set("no nos éd ed fig figs vol vols pp p ch sec art arts al tr t n nr số tel ext ver v ed av item eq ref tab c op đ".split())
# Abbreviations that may stand at the end of a sentence.
MAYBE = set("etc v.v vv inc ltd co corp jr a.m p.m am pm u.s u.k e.u ph.d b.c a.d cty llc plc sa sarl gmbh".split())
_consonants = regex.compile(r"[BCDFGHJKLMNPQRSTVWXZĐ]+")
_months = set("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil".split())
_particles = regex.compile(r"(?:と|って|は|が|を|に|の|も|で|へ|や|など|だ|的|地|，|、|,|说|說|道|등|라|하고|고|는|을|를|이라|며|면서)")


class _Of(dict):
    """Whether a character is of a class; characters met before are remembered."""

    def __init__(self, pattern):
        self.pattern = pattern

    def __missing__(self, c: str) -> bool:
        self[c] = self.pattern.match(c) is not None
        return self[c]


_is_caseless, _is_spaceless = _Of(_caseless), _Of(_spaceless)


def _next_visible(text: str, at: int):
    """The first character after ``at`` that isn't a blank, and whether blanks or breaks come before it."""
    n, start = min(len(text), at + LOOK), at
    while at < n and text[at].isspace():
        at += 1
    return (text[at] if at < n else ""), at > start, at


def _starts_sentence(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can begin a sentence: a capital, a digit, a caseless letter, maybe after an opening mark."""
    n = min(len(text), at + LOOK)
    while at < n and (text[at] in "“‘«(\"'[「『（【*_-–—•" or text[at].isspace()):
        at += 1
    if at >= n:
        return True
    c = text[at]
    return c.isupper() or c.isdigit() or _is_caseless[c]


def _stop_ends(text: str, start: int, end: int):
    """The symbol of the full stops at start..end if they can end a sentence, else None."""
    ends = _can_end(text, start, end)
    if not ends or end - start > 1 or text[start] not in ".．":
        return END if ends else None
    begin = text.rfind("\n", max(0, start - LOOK), start) + 1
    if (begin or start < LOOK) and _heading_number.match(text[begin:start]) and text[end : end + 1].isspace():
        return NUMBER_END
    return END


def _can_end(text: str, start: int, end: int) -> bool:
    if end - start > LOOK:
        return True
    cluster = text[start:end]
    past = _after.match(text, end).end()
    c, blank, place = _next_visible(text, past)
    if not c:
        return True
    strong = any(x in _stop for x in cluster)
    if strong:
        if blank:
            if c.islower() and cluster[-1] in ".…":
                return False
            return True
        if past < len(text) and text[past] in ",;:":
            return False
        # Lost blanks: the next sentence follows at once.
        if any(x in "。！？｡។៕" for x in cluster):
            return True
        return c.isupper() or _is_caseless[c]
    if "…" in cluster or len(cluster) > 1:
        # An ellipsis.
        if not blank:
            return c.isupper() and past == end and not _caseless.match(text[start - 1 : start] or " ")
        return c.isupper() or c in "“\"«" and _starts_sentence(text, place)
    before = text[max(0, start - 40) : start]
    word = _before.search(before)
    token = word[0] if word else ""
    low = token.lower()
    if not blank:
        if past > end:
            # A closing mark and then a letter at once: still inside.
            return False
        if _is_caseless[c]:
            return bool(token) and _is_caseless[token[-1]] and not token[-1].isdigit()
        if not c.isupper():
            return False
        following = text[place + 1 : place + 2]
        if low.rpartition(".")[2] in NEVER or low in MAYBE or "." in token and not token[-1].isdigit():
            return False
        if token and token[-1].isdigit():
            return following.islower()
        return len(token) > 1 and token[-1].islower() and (following.islower() or following in " \n")
    unit = token.islower() and before[: -len(token)].rstrip(" ")[-1:].isdigit()
    if not unit and (low in NEVER or low.rpartition(".")[2] in NEVER or low in BEFORE_NUMBER and c.isdigit()):
        return False
    if token.isupper() and 2 <= len(token) <= 4 and _consonants.fullmatch(token):
        return False
    if before.endswith("p. ex"):
        return False
    if len(token) == 1 and token.isupper() and (len(before) < 2 or not before[-2:-1].isalnum()):
        return False
    if low in MAYBE or low in _months and c.isdigit():
        return _starts_sentence(text, place) and not c.isdigit()
    if c.islower():
        return False
    return _starts_sentence(text, place)


def _kind(line: str) -> int:
    """What a line is: 1 for an item, 2 for a heading, else 0."""
    return 1 if _item.match(line) else 2 if _heading.match(line) else 0


def _line_symbol(text: str, start: int, end: int):
    """The line break at start..end: whether it parts after a plain line, an item and a heading; how the next line begins."""
    gap = text[start:end]
    upcoming = text[end : end + LOOK].split("\n", 1)[0]
    kind = _kind(upcoming)
    found = text.rfind("\n", max(0, start - LOOK), start)
    line = text[found + 1 if found >= 0 else max(0, start - LOOK) : start].strip()
    if gap.count("\n") > 1 or end - start > LOOK:
        return True, True, True, True, kind
    if not line or end >= len(text):
        return True, True, True, not line or len(line) < 40, kind
    tail = line.rstrip("\"'”’»)]」』）】*_")[-1:]
    closed = tail in ".:;…" or tail in _stop
    first = upcoming.lstrip("“‘«(\"'[「『（【*_ ")[:1]
    anew = closed or len(line) < 40

    def parts(item, heading):
        if kind == 1:
            return closed or item or heading or upcoming.lstrip()[:1] in "-–—•*+·▪" or len(line) < 40
        if kind == 2 and (closed or heading):
            return True
        if heading and len(line) < 90:
            return not first.islower()
        if tail == ":":
            return upcoming[:1] not in "“‘«\"'「『" and not first.islower()
        if _is_spaceless[line[-1]] and not _is_caseless[first or " "]:
            return first.isupper()
        if "฀" <= line[-1] <= "๿":
            return True
        if closed or not first.isupper():
            return False
        # A capital after a line without a full stop: part only what is clearly shorter than a wrapped line.
        word = upcoming.split(" ", 1)[0]
        return len(line) + 1 + len(word) < 45

    return parts(False, False), parts(True, False), parts(False, True), anew, kind


class _Ahead:
    """Whether a closing mark follows before the paragraph ends; asked from left to right, so each mark is sought once."""

    def __init__(self, text: str, tail: str = ""):
        self.text, self.tail, self.next = text, tail, {}

    def _find(self, what: str, at: int) -> int:
        place = self.next.get(what, -1)
        if place < at:
            place = self.text.find(what, at)
            self.next[what] = place = len(self.text) if place < 0 else place
        return place

    def __call__(self, marks: str, at: int) -> bool:
        stop = self._find("\n\n", at)
        if any(self._find(mark, at) < stop for mark in marks):
            return True
        return stop == len(self.text) and any(mark in self.tail for mark in marks)


def tails(text: str, ends: list[int]) -> list[str]:
    """Per ascending place the marks that follow it before the paragraph ends."""
    ahead = _Ahead(text)
    out = []
    for end in ends:
        stop = ahead._find("\n\n", max(0, end - 1))
        out.append("".join(m for m in _marks if ahead._find(m, end) < stop))
    return out


#: How far before a chunk a full stop or closing mark may begin that reaches into it.
BACK = 64


def symbols(text: str, lo: int, hi: int, ahead: _Ahead):
    """((symbol, its place, where the sentence that it ends is over) for those that start in lo..hi, and the place up
    to which an earlier one reaches over lo)."""
    found, reach = [], lo
    for m in _event.finditer(text, max(0, lo - BACK)):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if start >= hi:
            break
        event, over = None, end
        if kind == "line":
            if start >= lo:
                found.append((_line_symbol(text, start, end), start, start))
            continue
        if kind == "stop":
            event = _stop_ends(text, start, end)
            if event is not None:
                closing = _after.match(text, end).end()
                # Closing marks belong to the sentence they close; a straight one only before a blank.
                while over < closing and (text[over] not in "\"'" or closing >= len(text) or text[closing].isspace() or _is_caseless[text[closing]]):
                    over += 1
        elif kind == "thai":
            event, over = BLANK, start
        elif kind == "open":
            if start >= lo and ahead(_partner[m[0]], end):
                event = OPEN
        else:
            closing = kind == "close"
            if m[0] in "’'" and 0 < start and text[start - 1].isalnum() and text[end : end + 1].isalnum() and not _is_spaceless[text[start - 1]]:
                continue
            if kind == "straight":
                before, after = text[start - 1 : start], text[end : end + 1]
                opens = (not before or before.isspace() or before in "([“«:") and after and not after.isspace()
                if opens:
                    if start >= lo and ahead(m[0], end):
                        event = OPEN
                elif m[0] == '"' or before in ".!?":
                    closing = True
            if closing:
                event, over = CLOSE, end
                head = text[max(0, start - 8) : start].rstrip("  " + "\"'”’»)]」』）】")
                if head and (head[-1] in ".…" or head[-1] in _stop):
                    past = _after.match(text, end).end()
                    c, blank, place = _next_visible(text, past)
                    if not c or "\n\n" in text[past:place]:
                        event = CLOSE_END
                    elif _particles.match(text, place) and _is_caseless[c]:
                        event = CLOSE
                    elif blank:
                        event = CLOSE_END if _starts_sentence(text, place) else CLOSE
                    elif _is_spaceless[c] and not ("ក" <= c <= "៿") and not ("฀" <= c <= "๿"):
                        event = CLOSE_END
                    if event == CLOSE_END:
                        over = past
        if event is None:
            continue
        if start < lo:
            reach = max(reach, over)
            continue
        found.append((event, start, over))
    return found, reach


def summary(text: str, lo: int, hi: int, entries, ahead: _Ahead):
    """A chunk as a function: (exit states, starts of some entries as (place, which entries), starts of every entry)."""
    found, reach = symbols(text, lo, hi, ahead)

    def visible(at):
        while at < hi and text[at].isspace():
            at += 1
        return at

    entries = np.array(entries, np.int64)
    line, state = np.divmod(entries, WIDTH)
    if lo == 0:
        line[:] = _kind(text[:LOOK].split("\n", 1)[0])
    opened = np.full(len(entries), lo, np.int64)
    some, every = [], []
    fresh = state == BETWEEN
    if fresh.any():
        at = visible(max(lo, reach))
        if at < hi:
            some.append((at, fresh.copy()))
            state[fresh], opened[fresh] = 1, at
    step, n = 0, len(found)
    # All entries at once, until they have come together.
    while step < n and (len(entries) > 1 and not ((state == state[0]).all() and (line == line[0]).all() and (opened == opened[0]).all())):
        symbol, place, over = found[step]
        step += 1
        rule = TABLE[symbol]
        where = line * WIDTH + state
        live = state != BETWEEN
        if symbol != OPEN:
            live &= place >= opened
        ended = rule[5][where] & live
        line = rule[3][where] // WIDTH
        state = np.where(live, rule[4][where], state)
        if ended.any():
            at = visible(max(over, lo))
            if at < hi:
                some.append((at, ended))
                state[ended], opened[ended] = 1, at
    if step < n:
        row, now, since = int(line[0]), int(state[0]), int(opened[0])
        for symbol, place, over in found[step:]:
            lines, inside, ends = TABLE[symbol][:3]
            where = row * WIDTH + now
            row = lines[where]
            if now == BETWEEN or place < since and symbol != OPEN:
                continue
            now = inside[where]
            if ends[where]:
                at = visible(max(over, lo))
                if at < hi:
                    every.append(at)
                    now, since = 1, at
        line[:], state[:] = row, now
    return line * WIDTH + state, some, every


def chunk_function(text: str, lo: int, hi: int, entries=range(STATES)):
    """Per entry state the exit state and the starts within lo..hi."""
    exits, some, every = summary(text, lo, hi, entries, _Ahead(text))
    return exits.tolist(), [[at for at, who in some if who[k]] + every for k in range(len(exits))]


FUNCTIONS = "doc_id bigint, first int, exits array<smallint>, at array<int>, maybe array<int>, chunk array<int>, who array<binary>"


class _Functions:
    """Texts, or pieces of them, to the functions of their chunks.

    ``first`` is the number of a piece's first chunk, ``before`` how much of the
    piece stands before it, ``size`` how much belongs to it, ``tail`` the marks
    that follow. The first chunk of a text is entered between sentences.
    """

    def __init__(self, chunk):
        self.chunk = chunk

    def __call__(self, batch):
        out: dict = {name: [] for name in ("doc_id", "first", "exits", "at", "maybe", "chunk", "who")}
        for doc, first, before, size, tail, text in zip(*(batch[c] for c in ("doc_id", "first", "before", "size", "tail", "text"))):
            exits, places, maybe, numbers, who = [], [], [], [], []
            ahead = _Ahead(text, tail)
            for number, lo in enumerate(range(before, before + size, self.chunk), first):
                base = number * self.chunk - lo
                left, some, every = summary(text, lo, min(lo + self.chunk, before + size), (BETWEEN,) if number == 0 else range(STATES), ahead)
                if size > self.chunk or number:
                    exits += left.tolist() * (STATES if number == 0 else 1)
                if number == 0:
                    every = [at for at, _ in some] + every
                else:
                    maybe += [base + at for at, _ in some]
                    numbers += [number - first] * len(some)
                    who += [np.packbits(mask).tobytes() for _, mask in some]
                places += [base + at for at in every] if base else every
            for name, value in zip(out, (doc, first, exits, places, maybe, numbers, who)):
                out[name].append(value)
        return out


class _Split:
    """Long texts to pieces, in one pass from left to right."""

    def __init__(self, chunk, spread):
        self.chunk, self.spread = chunk, spread

    def __call__(self, batch):
        out: dict = {name: [] for name in ("doc_id", "first", "before", "size", "tail", "text")}
        for doc, text in zip(batch["doc_id"], batch["text"]):
            step = self.chunk * self.spread
            begins = range(0, len(text), step)
            ends = [min(len(text), b + step + AROUND) for b in begins]
            for begin, end, tail in zip(begins, ends, tails(text, ends)):
                before = min(begin, AROUND)
                for name, value in zip(out, (doc, begin // self.chunk, before, min(step, len(text) - begin), tail, text[begin - before : end])):
                    out[name].append(value)
        return out


def prefix_entries(functions: np.ndarray) -> np.ndarray:
    """The entry state of each chunk: all prefixes composed in a logarithmic number of steps.

    ``functions[k, s]`` is the state in which chunk k is left if entered in s.
    """
    scan = functions.copy()
    step = 1
    while step < len(scan):
        earlier, later = scan[:-step], scan[step:]
        scan = np.concatenate([scan[:step], np.take_along_axis(later, earlier, axis=1)])
        step *= 2
    return np.concatenate([[BETWEEN], scan[:-1, BETWEEN]]).astype(np.int32)


class _Scan:
    """Composes the functions of each text and keeps the starts of its chunks' true entries."""

    def __call__(self, batch):
        docs, starts = [], []
        for doc, exits, places, maybe, chunks, who in zip(*(batch[c] for c in ("doc_id", "exits", "at", "maybe", "chunk", "who"))):
            mine = places
            if maybe:
                entries = prefix_entries(np.array(exits, np.int64).reshape(-1, STATES))
                mine = places + [at for at, k, mask in zip(maybe, chunks, who) if mask[entries[k] >> 3] >> (7 - (entries[k] & 7)) & 1]
            docs += [doc] * len(mine)
            starts += mine
        return {"doc_id": docs, "start_pos": starts}


def sentence_starts(documents: DataFrame, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(doc_id, text) to one row (doc_id, start_pos) per sentence.

    One stage makes the functions of chunks, a second one composes them. Texts of
    up to ``spread`` chunks stay in their task and need no shuffle. Longer ones
    are cut into pieces in one pass and spread over the cluster; only their
    functions, a few numbers for each chunk, come together again. Rows that share
    a doc_id are told apart by their text.
    """
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    most = chunk * spread
    whole = texts.where(F.length("text") <= most).select(
        "doc_id", F.lit(0).alias("first"), F.lit(0).alias("before"), F.length("text").alias("size"), F.lit("").alias("tail"), "text"
    )
    short = map_batches(whole, _Functions(chunk), FUNCTIONS)

    key = F.to_json(F.struct("doc_id", F.xxhash64("text").alias("print")))
    pieces = map_batches(texts.where(F.length("text") > most).select(key.alias("doc_id"), "text"), _Split(chunk, spread), PIECES)
    functions = map_batches(pieces.repartition("doc_id", "first"), _Functions(chunk), FUNCTIONS.replace("doc_id bigint", "doc_id string"))
    once = functions.groupBy("doc_id", "first").agg(F.first(F.struct("first", "exits", "at", "maybe", "chunk", "who")).alias("f"), F.count("*").alias("copies"))
    by_text = once.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("f"), F.max("copies").alias("copies"))
    rejoined = by_text.select(
        F.from_json("doc_id", "doc_id bigint, print bigint")["doc_id"].alias("doc_id"),
        F.flatten("f.exits").alias("exits"),
        F.flatten("f.at").alias("at"),
        F.flatten("f.maybe").alias("maybe"),
        F.flatten(F.transform("f", lambda p: F.transform(p["chunk"], lambda k: k + p["first"]))).alias("chunk"),
        F.flatten("f.who").alias("who"),
        F.explode(F.expr("sequence(1, copies)")).alias("copy"),
    ).drop("copy")
    functions_of_texts = short.drop("first").unionByName(rejoined)
    return map_batches(functions_of_texts, _Scan(), "doc_id bigint, start_pos bigint")


PIECES = "doc_id string, first int, before int, size int, tail string, text string"
