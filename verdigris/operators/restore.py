"""Accents put back into texts that have lost them (T11).

The dictionary is counted from the corpus: every run of one to four words,
without accents, with the accented form it most often has. A text is restored by
longest match from left to right; case is carried over letter by letter, and a
word that no entry knows stays as it is. Only texts with few marked letters are
touched, and of those only texts most of whose words the dictionary knows, so
sound texts and texts in another language pass unchanged.
"""

from __future__ import annotations

import unicodedata

import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import LETTERS, diacritic_ratio, fold
from verdigris.session import map_batches, spread, written

#: Words of the longest entry, and entries that ``dictionary`` may bring to the driver.
LONGEST, ENTRIES = 4, 60_000
#: Share of a text's words that entries must cover.
COVERED = 0.6
_word = regex.compile(r"[\p{L}\p{M}]+")


def entries(texts: DataFrame, column: str) -> DataFrame:
    """(bare, form): bare runs of words with their most frequent accented form, counted over all texts in the JVM.

    Runs don't cross punctuation. Counting combines map-side; no entry is left out.
    """
    low = F.lower(F.col(column))
    stretches = spread(texts.where(diacritic_ratio(F.col(column)) >= 0.08).select(F.col(column))).select(F.explode(F.split(low, f"[^{LETTERS} ]+")).alias("s"))
    words = stretches.select(F.filter(F.split(F.trim("s"), " +"), lambda w: w != "").alias("w"))
    runs = F.flatten(F.array(*[_runs("w", n) for n in range(1, LONGEST + 1)]))
    counted = words.select(F.explode(runs).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    best = counted.withColumn("bare", fold(F.col("form"))).groupBy("bare").agg(F.max_by("form", F.struct("n", "form")).alias("form"), F.sum("n").alias("n"))
    return best.where("bare <> form AND (n > 1 OR NOT contains(bare, ' '))").select("bare", "form")


def dictionary(texts: DataFrame, column: str, most: int = ENTRIES) -> dict[str, str]:
    """``entries`` of a small corpus as a dictionary; an error if there are more than ``most``, for which ``restored_by`` joins."""
    rows = entries(texts, column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the dictionary is larger than the driver may hold; use restored_by")
    return {row.bare: unicodedata.normalize("NFC", row.form) for row in rows}


def _runs(words: str, n: int):
    """All runs of n words of an array column; none if it is shorter."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


class _Restore:
    def __init__(self, known: dict, threshold: float):
        self.known, self.threshold = known, threshold

    def needs(self, text: str) -> bool:
        letters = [c for c in text if c.isalpha()]
        return len(letters) > 20 and sum(not c.isascii() for c in letters) < self.threshold * len(letters)

    def restore(self, text: str, known: dict | None = None) -> str:
        known = self.known if known is None else known
        words = [(m.start(), m.end()) for m in _word.finditer(text)]
        out, at, i, covered = [], 0, 0, 0
        while i < len(words):
            for n in range(min(LONGEST, len(words) - i), 0, -1):
                start, end = words[i][0], words[i + n - 1][1]
                run = text[start:end]
                form = known.get(run.lower())
                if form is not None and len(form) == len(run):
                    cased = "".join(f.upper() if c.isupper() else f for c, f in zip(run, form))
                    out += [text[at:start], cased]
                    at, i, covered = end, i + n, covered + n
                    break
            else:
                i += 1
        return "".join(out) + text[at:] if covered >= COVERED * len(words) else text

    def __call__(self, batch):
        texts = [t if t is None or not self.needs(t) else self.restore(t) for t in batch["text"]]
        return {"row_id": batch["row_id"], "text": texts}


def restored(texts: DataFrame, known: dict[str, str], threshold: float = 0.08) -> DataFrame:
    """(row_id, text) with accents put back where a text has lost them; nulls stay, no shuffle."""
    return map_batches(texts.select("row_id", "text"), _Restore(known, threshold), "row_id bigint, text string")


class _RunsOf(_Restore):
    """Texts that need it with the runs that entries may know; other texts without."""

    def __call__(self, batch):
        out: dict = {"row_id": batch["row_id"], "text": batch["text"], "runs": []}
        for text in batch["text"]:
            if text is None or not self.needs(text):
                out["runs"].append(None)
                continue
            words = [(m.start(), m.end()) for m in _word.finditer(text)]
            out["runs"].append(sorted({text[words[i][0] : words[i + n][1]].lower() for i in range(len(words)) for n in range(min(LONGEST, len(words) - i))}))
        return out


class _RestoreRow(_Restore):
    def __call__(self, batch):
        known = [{x["run"]: unicodedata.normalize("NFC", x["form"]) for x in entries} if entries else {} for entries in batch["entries"]]
        return {"row_id": batch["row_id"], "text": [self.restore(t, k) for t, k in zip(batch["text"], known)]}


def restored_by(texts: DataFrame, known: DataFrame, threshold: float = 0.08) -> DataFrame:
    """``restored`` with a table of entries of any size: only texts that need it meet the entries of their own runs.

    A run that many texts share is one row of the entries; its hot side is split
    by adaptive execution.
    """
    seen = written(map_batches(texts.select("row_id", "text"), _RunsOf({}, threshold), "row_id bigint, text string, runs array<string>"))
    sound = seen.where("runs IS NULL").select("row_id", "text")
    needy = seen.where("runs IS NOT NULL").withColumn("_h", F.xxhash64("text"))
    asked = needy.select("row_id", "_h", F.explode("runs").alias("bare")).distinct()
    held = asked.join(known, "bare").groupBy("row_id", "_h").agg(F.collect_list(F.struct(F.col("bare").alias("run"), "form")).alias("entries"))
    joined = needy.withColumn("_key", F.coalesce("row_id", F.lit(-1))).join(held.withColumn("_key", F.coalesce("row_id", F.lit(-1))).drop("row_id"), ["_key", "_h"], "left")
    return sound.unionByName(map_batches(joined.select("row_id", "text", "entries"), _RestoreRow({}, threshold), "row_id bigint, text string"))
