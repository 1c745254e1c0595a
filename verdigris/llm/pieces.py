"""Oversized texts cut into overlapping pieces at natural boundaries (problem 5).

Every boundary of a text is joined to its farthest legal successor: the start
of the next piece if a piece began there. Successor tables are then squared;
after round k a jump covers 2**k pieces, so the cuts of the longest text are
known after a logarithmic number of rounds. All texts of a batch share one
table, and every round is one array operation over the whole batch.

A piece ends at the farthest structural boundary (a numbered clause, lettered
point, article, list item or paragraph) in its last three quarters; without one
at the farthest sentence or clause end, without one at the farthest blank, and
only in an unbroken stretch between two characters. The next piece starts up to
``overlap`` characters before that end, at a sentence start if there is one.

Defined results: null texts give no piece; an empty text gives one empty piece;
a text within the limit gives itself. No piece is longer than the limit, the
pieces cover the text, and neighbours share at most ``overlap`` characters.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import map_batches

LIMIT, OVERLAP = 1200, 150

_structure = regex.compile(
    r"(?m)(?:^[ \t]*(?=\d{1,3}[.)]\s|[a-zđ][).]\s|[-–•*]\s|(?:Điều|Khoản|Mục|Chương|Phần|Article|Section|Part)\s+\d|第\d+)|(?<=\n[ \t]*\n)(?=\S))"
)
_sentence = regex.compile(r"(?<=[.!?…;:][\"'”’»)\]]*)\s+(?=\S)|(?<=[。！？；][”’」』）]*)(?=\S)|\n+(?=\S)")
_word = regex.compile(r"\s+(?=\S)")
_long = regex.compile(r"\S+")

SCHEMA = (
    "row_id bigint, piece_no int, n_pieces int, start_pos int, end_pos int, cut string, unbroken boolean, piece string"
)
CUTS = ("structure", "sentence", "blank", "none", "end")


def boundaries(text: str, limit: int, overlap: int):
    """Sorted places of structure, sentence, blank and forced boundaries, inner places only."""
    n = len(text)
    found = []
    for pattern in (_structure, _sentence, _word):
        found.append(sorted({m.end() for m in pattern.finditer(text) if 0 < m.end() < n}))
    forced = []
    edges = [0, *sorted(set().union(*found)), n]
    step = max(1, overlap // 2)
    for a, b in zip(edges, edges[1:]):
        if b - a > limit - overlap:
            for place in range(a + step, b, step):
                # Never between a letter and its marks.
                while place < b and unicodedata.category(text[place])[0] == "M":
                    place += 1
                if place < b:
                    forced.append(place)
    found.append(sorted(set(forced)))
    return found


def _last(places, upto, after):
    """Per entry the largest place <= upto that is > after, else -1."""
    if not len(places):
        return np.full(len(upto), -1, np.int64)
    at = np.searchsorted(places, upto, "right") - 1
    got = places[np.maximum(at, 0)]
    return np.where((at >= 0) & (got > after), got, -1)


def _first(places, atleast, below, after):
    """Per entry the smallest place >= atleast that is < below and > after, else -1."""
    if not len(places):
        return np.full(len(atleast), -1, np.int64)
    at = np.searchsorted(places, np.maximum(atleast, after + 1), "left")
    got = places[np.minimum(at, len(places) - 1)]
    return np.where((at < len(places)) & (got < below), got, -1)


def cut_all(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple]]:
    """Per text its pieces as (start, end, how its end was found)."""
    if not texts:
        return []
    per_level, nodes, bases, ends = [[], [], [], []], [], [], []
    base = 0
    for text in texts:
        levels = boundaries(text, limit, overlap)
        for kept, places in zip(per_level, levels):
            kept.extend(base + p for p in places)
        nodes.append(base)
        nodes.extend(sorted(base + p for p in set().union(*levels)))
        bases.append(base)
        ends.append(base + len(text))
        base += len(text) + limit + 1
    levels = [np.array(p, np.int64) for p in per_level]
    node = np.array(nodes, np.int64)
    bases, ends = np.array(bases, np.int64), np.array(ends, np.int64)
    owner = np.searchsorted(bases, node, "right") - 1
    stop = ends[owner]

    reach = node + limit
    end = np.full(len(node), -1, np.int64)
    how = np.full(len(node), 4, np.int8)
    done = stop <= reach
    end[done] = stop[done]
    for level, least in enumerate((limit // 4, overlap, overlap, 0)):
        found = _last(levels[level], np.minimum(reach, stop - 1), node + least)
        take = (end < 0) & (found >= 0)
        end[take], how[take] = found[take], level
    start = np.full(len(node), -1, np.int64)
    for places in (levels[1], levels[2], levels[3]):
        found = _first(places, end - overlap, end, node)
        take = (start < 0) & (found >= 0)
        start[take] = found[take]
    start = np.where(start < 0, end, start)
    jump = np.where(done, np.arange(len(node)), np.searchsorted(node, start))

    reached = np.zeros(len(node), bool)
    reached[np.searchsorted(node, bases)] = True
    while True:
        before = reached.sum()
        reached[jump[reached]] = True
        jump = jump[jump]
        if reached.sum() == before:
            break
    result: list[list[tuple]] = [[] for _ in texts]
    for i in np.flatnonzero(reached):
        t = owner[i]
        result[t].append((int(node[i] - bases[t]), int(end[i] - bases[t]), CUTS[how[i]]))
    return result


class _Cut:
    def __init__(self, limit, overlap, keep):
        self.limit, self.overlap, self.keep = limit, overlap, keep

    def __call__(self, batch):
        out: dict = {name: [] for name in (*self.keep, *(c.split()[0] for c in SCHEMA.split(", ")))}
        texts = batch["text"]
        for k, (row, text, pieces) in enumerate(zip(batch["row_id"], texts, cut_all(texts, self.limit, self.overlap))):
            unbroken = any(m.end() - m.start() > self.limit for m in _long.finditer(text))
            for number, (start, end, how) in enumerate(pieces, 1):
                out["row_id"].append(row)
                out["piece_no"].append(number)
                out["n_pieces"].append(len(pieces))
                out["start_pos"].append(start)
                out["end_pos"].append(end)
                out["cut"].append(how)
                out["unbroken"].append(unbroken)
                out["piece"].append(text[start:end])
            for name in self.keep:
                out[name] += [batch[name][k]] * len(pieces)
        return out


def long_pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple = ()) -> DataFrame:
    """Pieces of the texts over the limit; ``texts`` has row_id and text, and the columns to ``keep`` with each piece. No shuffle.

    Shorter texts never leave the JVM: the length test runs before Python.
    """
    long = texts.where(F.length("text") > limit).select(*keep, "row_id", "text")
    kept = [f"`{name}` {texts.schema[name].dataType.simpleString()}" for name in keep]
    return map_batches(long, _Cut(limit, overlap, keep), ", ".join([*kept, SCHEMA]))


def all_pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple = ()) -> DataFrame:
    """Pieces of every text; those within the limit pass whole."""
    short = texts.where(F.length("text") <= limit).select(
        *keep,
        "row_id",
        F.lit(1).alias("piece_no"),
        F.lit(1).alias("n_pieces"),
        F.lit(0).alias("start_pos"),
        F.length("text").alias("end_pos"),
        F.lit("end").alias("cut"),
        F.lit(False).alias("unbroken"),
        F.col("text").alias("piece"),
    )
    return long_pieces(texts, limit, overlap, keep).unionByName(short)


def rejoined(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, n_pieces, within_limit, overlap_kept, content_hash): the pieces of each text put together again.

    ``content_hash`` is the MD5 of the text that the pieces give without what
    neighbours share, so it equals the text's own if they cover it in order.
    """
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece")))

    def add(done, p):
        return F.struct(F.concat(done["text"], F.substr(p["piece"], done["upto"] - p["start_pos"] + 1)).alias("text"), p["end_pos"].alias("upto"))

    def neighbours(test):
        return F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == F.size("p")) | test(F.get("p", i - 1), F.get("p", i)))

    whole = F.aggregate("p", F.struct(F.lit("").alias("text"), F.lit(0).alias("upto")), add, lambda done: done["text"])
    return (
        pieces.groupBy("row_id")
        .agg(parts.alias("p"))
        .select(
            "row_id",
            F.size("p").alias("n_pieces"),
            F.forall("p", lambda x: (F.length(x["piece"]) <= limit) & (x["end_pos"] - x["start_pos"] == F.length(x["piece"]))).alias("within_limit"),
            neighbours(lambda a, b: (b["start_pos"] <= a["end_pos"]) & (a["end_pos"] - b["start_pos"] <= overlap)).alias("overlap_kept"),
            F.md5(whole.cast("binary")).alias("content_hash"),
        )
    )
