"""Held-out items inside training texts (problem 6).

The items are folded to plain letters and digits and put into one generalised
suffix automaton. Each training text streams through it character by
character; the automaton's state and the matched length say which items' runs
of ``WORDS`` words have just been completed. Blanks take no part in the match,
so lost or added ones don't matter; a run counts only if it starts and ends
where words of the text do, or goes on beyond there in text and item alike.
The runs are spans of the stored text; those that are long or cover much of an
item are removed from it (``cleaned``).

Defined results: null, empty and blank texts hold nothing and stay as they are;
items with fewer than ``WORDS`` words can't be held, which ``item_words`` tells;
repeated items each count.
"""

from __future__ import annotations

import bisect
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.lookalike import LOOKALIKES, _ignorable
from verdigris.session import map_batches

WORDS = 12
#: Folded characters of items that one automaton holds, and that come to the driver at a time; more items make more passes.
BLOCK = 200_000
#: A span is removed if it has so many words, or so large a share of its item.
LONG, COVERS = 12, 0.5


class _Fold(dict):
    """Per code point what stays of it: letters and digits without case and accents, a blank for the rest."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if _ignorable.match(c):
            folded = ""
        else:
            parts = []
            for d in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)):
                d = LOOKALIKES.get(d, d)
                kind = unicodedata.category(d)[0]
                if kind in "LN":
                    parts.append(unicodedata.normalize("NFKD", d.casefold()))
                elif kind != "M":
                    parts.append(" ")
            folded = "".join(p for p in "".join(parts) if unicodedata.category(p)[0] != "M")
            folded = folded.replace("đ", "d")
        self[point] = folded
        return folded


FOLD = _Fold()


class _Words(dict):
    """Per stretch without blanks its folded words; stretches met before are remembered."""

    def __missing__(self, stretch: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        self[stretch] = tuple(stretch.translate(FOLD).split())
        return self[stretch]


_words = _Words()


def words_of(text: str) -> list[str]:
    """The folded words of a text."""
    out: list[str] = []
    for stretch in text.split():
        out += _words[stretch]
    return out


class SuffixAutomaton:
    """Of all items at once, each closed by a sign of its own that no text contains.

    ``done[v]`` lists (item, characters that its last ``WORDS`` words take) for
    item words that end in state v and may be complete there.
    """

    def __init__(self, items: list[tuple[int, list[str]]], words: int = WORDS):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list] = [[]]
        last = 0
        for place, (item, tokens) in enumerate(items):
            sizes = [len(t) for t in tokens]
            for k, token in enumerate(tokens):
                for c in token:
                    last = self._extend(c, last, own)
                if k + 1 >= words:
                    own[last].append((item, sum(sizes[k + 1 - words : k + 1])))
            last = self._extend(("end", place), last, own)
        # Ends are inherited by suffixes that are still long enough.
        order = sorted(range(1, len(self.length)), key=lambda v: -self.length[v])
        gathered: list[dict] = [dict() for _ in self.length]
        for v in range(len(own)):
            for item, need in own[v]:
                gathered[v][item] = min(need, gathered[v].get(item, need))
        for v in order:
            up, room = self.link[v], self.length[self.link[v]]
            for item, need in gathered[v].items():
                if need <= room and need < gathered[up].get(item, room + 1):
                    gathered[up][item] = need
        self.done = [tuple((need, item) for item, need in g.items()) for g in gathered]
        self.steps: dict = {}

    #: Steps over whole words that are remembered.
    MOST_STEPS = 1_000_000

    def _over(self, state: int, word: str):
        """What a whole word does from a state: (next state, matched length or -1 if the word only adds to it), or
        None where items may be complete on the way and every character must be looked at."""
        nexts, link, length, done = self.next, self.link, self.length, self.done
        fixed = -1
        for c in word:
            step = nexts[state].get(c)
            while step is None and state:
                state = link[state]
                fixed = length[state]
                step = nexts[state].get(c)
            if step is None:
                fixed = 0
                continue
            state = step
            if fixed >= 0:
                fixed += 1
            if done[state]:
                return None
        return state, fixed

    def _extend(self, c, last, own):
        nexts, link, length = self.next, self.link, self.length
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        own.append([])
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                own.append([])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def stream(self, words: list[str]) -> dict:
        """Per item the runs of the text's characters that it shares, as (start, end), where a whole run of words is completed."""
        nexts, link, length, done, steps = self.next, self.link, self.length, self.done, self.steps
        found: dict = {}
        state = matched = total = 0
        starts, pending = set(), []

        def note(item, start, end):
            runs = found.setdefault(item, [])
            while runs and start <= runs[-1][1]:
                start = min(start, runs.pop()[0])
            runs.append((start, end))

        for word in words:
            starts.add(total)
            if not pending:
                key = (state, word)
                over = steps.get(key, 0)
                if over == 0:
                    if len(steps) > self.MOST_STEPS:
                        steps.clear()
                    over = steps[key] = self._over(state, word)
                if over is not None:
                    state, fixed = over
                    total += len(word)
                    matched = matched + len(word) if fixed < 0 else fixed
                    continue
            for c in word:
                step = nexts[state].get(c)
                if step is None or pending:
                    if step is not None:
                        # The run goes on in the text as in the item: a blank was lost there.
                        for item, room in pending:
                            note(item, total - room, total)
                    pending = []
                while step is None and state:
                    state = link[state]
                    matched = length[state]
                    step = nexts[state].get(c)
                total += 1
                if step is None:
                    matched = 0
                    continue
                state = step
                matched += 1
                up = state
                while up > 0 and done[up]:
                    room = matched if up == state else length[up]
                    for need, item in done[up]:
                        # The run of words starts where a word of the text does, or within a longer run.
                        if need < room or need == room and total - need in starts:
                            pending.append((item, room))
                    up = link[up]
            for item, room in pending:
                note(item, total - room, total)
            pending = []
        return found


def places(text: str) -> tuple[list[int], list[int]]:
    """The place in the text of each of its folded characters, and the folded places where words begin."""
    at, starts, fresh = [], [], True
    for k, c in enumerate(text):
        folded = " " if c.isspace() else FOLD[ord(c)]
        for d in folded:
            if d == " ":
                fresh = True
                continue
            if fresh:
                starts.append(len(at))
                fresh = False
            at.append(k)
    return at, starts


class _Stream:
    """Spans of items in texts, or per text and item the longest alone; the automaton is built once per worker."""

    def __init__(self, items, words, longest):
        self.__setstate__((items, words, longest))

    def __getstate__(self):
        return (self.items, self.words, self.longest)

    def __setstate__(self, state):
        self.items, self.words, self.longest = state
        self.automaton = None

    def __call__(self, batch):
        if self.automaton is None:
            self.automaton = SuffixAutomaton(self.items, self.words)
            self.sizes = {item: sum(map(len, tokens)) for item, tokens in self.items}
        out: dict = {name.split()[0]: [] for name in SPANS.split(", ")}
        for doc, mark, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
            found = self.automaton.stream(words_of(text))
            if not found:
                continue
            at, starts = places(text)
            for item, runs in found.items():
                for start, end in [max(runs, key=lambda run: run[1] - run[0])] if self.longest else runs:
                    # What was matched of a word before the run isn't part of it.
                    k = bisect.bisect_left(starts, start)
                    n_words = bisect.bisect_left(starts, end) - k
                    begin = starts[k] if n_words >= self.words else start
                    for name, value in zip(out, (doc, mark, item, at[begin], at[end - 1] + 1, n_words, end - begin, min(1.0, (end - begin) / self.sizes[item]))):
                        out[name].append(value)
        return out


SPANS = "doc_id bigint, text_hash bigint, item_id bigint, start_pos int, end_pos int, n_words int, n_chars int, coverage double"


class _Size:
    def __call__(self, batch):
        folded = [words_of(text or "") for text in batch["text"]]
        return {"item_id": batch["item_id"], "n_words": [len(w) for w in folded], "n_chars": [sum(map(len, w)) for w in folded]}


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, n_words, n_chars) of the folded items; those below ``WORDS`` words can't be found."""
    return map_batches(items.select("item_id", "text"), _Size(), "item_id bigint, n_words int, n_chars int")


def spans(documents: DataFrame, items: DataFrame, words: int = WORDS, block: int = BLOCK, longest: bool = False) -> DataFrame:
    """One row per run of an item's words in a text: its place there, its words, and the share of the item it covers.

    ``longest`` keeps one run per text and item. Items are taken in blocks of
    about ``block`` characters: a block comes to the driver and goes to the
    workers, which hold one automaton of it. The corpus is read once for each
    block and not shuffled; a held-out set of usual size is one block.
    """
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = None
    for k in range(n_blocks):
        rows = items.where(number == k).orderBy("item_id", "text").collect()
        held = [item for item in ((row.item_id, words_of(row.text)) for row in rows) if len(item[1]) >= words]
        if held:
            mine = map_batches(texts, _Stream(held, words, longest), SPANS)
            found = mine if found is None else found.unionByName(mine)
    return documents.sparkSession.createDataFrame([], SPANS) if found is None else found


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_chars) for every text that holds a run of an item's words, with the longest run's folded characters."""
    return spans(documents, items, words, longest=True).select("doc_id", "item_id", "n_chars")


class _Clean:
    def __call__(self, batch):
        out: dict = {"doc_id": batch["doc_id"], "n_removed": [], "cleaned": []}
        for text, cuts in zip(batch["text"], batch["cuts"]):
            kept, at, removed = [], 0, 0
            for start, end in sorted((c["start_pos"], c["end_pos"]) for c in cuts or ()):
                if end > at:
                    kept.append(text[at : max(at, start)])
                    removed += end - max(at, start)
                    at = end
            out["n_removed"].append(removed)
            out["cleaned"].append(None if text is None else "".join(kept) + text[at:])
        return out


def cleaned(documents: DataFrame, found: DataFrame, long: int = LONG, covers: float = COVERS) -> DataFrame:
    """(doc_id, n_removed, cleaned): every text without the spans that are too long or cover too much of an item."""
    cuts = (
        found.where((F.col("n_words") >= long) | (F.col("coverage") >= covers))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start_pos", "end_pos")).alias("cuts"))
    )
    joined = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(cuts, ["doc_id", "text_hash"], "left")
    return map_batches(joined, _Clean(), "doc_id bigint, n_removed int, cleaned string")
