"""Texts that look the same brought to one form (problem 2).

Words are matched against a vocabulary trie by a weighted edit automaton.
Look-alike letters, wide and narrow forms and invisible characters cost nothing,
also where a character is drawn like several letters and only the vocabulary
tells which is meant. A letter of another script that no table knows costs
``FOREIGN``, any other edit more than the budget, so one such letter in a longer
Latin word is read as the letter that the only fitting word has there. The
cheapest word gives the canonical spelling; what matches none is normalised by
table.

What stays apart is whatever the eye can tell: case, accents, punctuation,
dashes of other length, curly and straight quotes, one blank and two.

Defined results: a null text stays null; empty and blank texts become the
empty text; unknown letters pass unchanged.
"""

from __future__ import annotations

import unicodedata

import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.prefix import most_frequent
from verdigris.session import cut, map_batches

# Letters of other alphabets that are drawn like the Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԜԚ"  # Cyrillic capitals
        "асԁеһіјӏорԛѕуԝх"  # Cyrillic small letters
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"  # Greek capitals
        "ονϲϳ"  # Greek small letters
        "ÐƉðᎠ"  # other letters with the stroke of the Vietnamese D
        "ɑɡօոսհⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ",  # Latin, Armenian and numeral forms
        "ABESIJKMHOPCTYXYWQ"
        "acdehijlopqsywx"
        "ABEZHIKMNOPTYXCJ"
        "ovcj"
        "ĐĐđD"
        "agonuhIVXLCDMivxlcdm",
    )
)
# Hyphens drawn like the ASCII one, and apostrophes drawn like the closing quote.
LOOKALIKES |= {"‐": "-", "‑": "-", "﹣": "-", "ʼ": "’"}
# Characters that leave no mark.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
)
#: Kinds of blank drawn as one blank; line breaks aren't.
BLANKS = "\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u2800\u3000"

# Letters drawn like more than one Latin letter, the likelier first.
AMBIGUOUS = {"Ӏ": "Il", "ӏ": "lI", "ǀ": "lI", "Ɩ": "lI"}
LOOKALIKES |= {c: letters[0] for c, letters in AMBIGUOUS.items()}

_lookalikes = str.maketrans(LOOKALIKES)
_ignorable = regex.compile(f"[{IGNORABLE}]")
_blank = regex.compile(f"[ {BLANKS}]")
_wide = regex.compile("[！-～｡-ﾟﾡ-ￜ￠-￦]+")
#: Texts of these characters only are in normal form but for blanks at the ends.
PLAIN = "\\x20-\\x7e\\n\\r"
_NORMAL = "\\x20-\\x7eÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ‘’“”–—…"
_plain = regex.compile(f"[{PLAIN}{_NORMAL}]*")
_space = regex.compile(r"(\s+)")
#: What comes before the word of a token, the word, and what comes after it.
_edges = regex.compile(r"(?s)^([^\p{L}\p{Nl}\p{N}]*)(.*?)([^\p{L}\p{M}\p{Nl}\p{N}]*)$")

#: Words kept in the vocabulary, the most frequent of each hash bucket: a bound on what is sent to the workers.
VOCABULARY = 20_000
#: Costs of a letter of another script that is in no table, of any other edit, and what a match may cost.
FOREIGN, EDIT, BUDGET = 0.5, 1, 0.5
#: Letters that a word must have for a foreign one to be read by its company.
COMPANY = 4
_foreign = regex.compile(r"[[\p{L}\p{Nl}]--\p{Latin}]", regex.V1)
_latin = regex.compile(r"\p{Latin}")


def by_table(token: str) -> str:
    """The normal form of one token or text, by the tables alone."""
    if _plain.fullmatch(token):
        return token
    token = _ignorable.sub("", token)
    token = _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), token)
    token = unicodedata.normalize("NFD", token)
    token = token.translate(_lookalikes)
    return unicodedata.normalize("NFC", token)


class Automaton:
    """A vocabulary trie walked by a weighted edit automaton.

    The words are held decomposed. A state is a trie node with its cost so far;
    the look-alikes of an edge cost nothing, nor does passing an ignorable
    character; a foreign letter in place of one of its case costs ``FOREIGN``, every
    other substitution, insertion or deletion ``EDIT``.
    """

    def __init__(self, words):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            node[""] = word

    @staticmethod
    def _letters(token: str) -> list:
        """Per character of the token the letters that it may be read as."""
        token = unicodedata.normalize("NFD", _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), token))
        # Marks that an ignorable character had kept apart take their canonical order.
        if _ignorable.search(token):
            kept = _ignorable.sub("", token)
            if unicodedata.normalize("NFD", kept) != kept:
                token = unicodedata.normalize("NFD", kept)
        return [AMBIGUOUS.get(c) or LOOKALIKES.get(c, c) for c in token]

    def matches(self, token: str, budget: int = 0) -> list:
        """(cost, word) of every word within the budget, the cheapest first."""
        states = self._skip({id(self.root): (0, self.root)}, budget)
        for letters in self._letters(token):
            step: dict = {}
            free = _ignorable.match(letters) is not None
            price = FOREIGN if _foreign.match(letters) else EDIT
            for cost, node in states.values():
                if free:
                    self._add(step, cost, node, budget)
                    continue
                for c in letters:
                    if c in node:
                        self._add(step, cost, node[c], budget)
                if cost + EDIT <= budget:
                    self._add(step, cost + EDIT, node, budget)
                if cost + price <= budget:
                    for edge, other in node.items():
                        if edge and edge not in letters and (price == EDIT or _latin.match(edge) and edge.isupper() == letters.isupper()):
                            self._add(step, cost + price, other, budget)
            states = self._skip(step, budget)
            if not states:
                return []
        return sorted((cost, node[""]) for cost, node in states.values() if "" in node)

    def match(self, token: str, budget: int = 0):
        """(cost, word) of the cheapest word within the budget, the first in order on ties; or None."""
        found = self.matches(token, budget)
        return found[0] if found else None

    @staticmethod
    def _add(states, cost, node, budget):
        if cost <= budget and cost < states.get(id(node), (budget + 1,))[0]:
            states[id(node)] = (cost, node)

    def _skip(self, states, budget):
        """Letters of the word that the token lacks, at ``EDIT`` each."""
        if budget >= EDIT:
            todo = list(states.values())
            while todo:
                cost, node = todo.pop()
                if cost + EDIT <= budget:
                    for edge, other in node.items():
                        if edge and cost + EDIT < states.get(id(other), (budget + 1,))[0]:
                            states[id(other)] = (cost + EDIT, other)
                            todo.append((cost + EDIT, other))
        return states


class Canonical:
    """Texts to their one form; tokens met before are remembered."""

    def __init__(self, words):
        self.automaton = Automaton(words)
        self.known: dict = {}

    def token(self, token: str) -> str:
        if _plain.fullmatch(token):
            return token
        form = self.known.get(token)
        if form is None:
            if len(self.known) > 200_000:
                self.known.clear()
            form = self.known[token] = self._spelling(token)
        return form

    def _spelling(self, token: str) -> str:
        """The vocabulary's spelling of the word in the token, the marks around it by table."""
        tabled = by_table(token)
        head, word, tail = _edges.match(tabled).groups()
        if not word:
            return tabled
        budget = BUDGET if len(_latin.findall(word)) >= COMPANY else 0
        # Readings are tried on the word as written; marks and ignorables around it are of no cost or in the table.
        written = _edges.match(_ignorable.sub("", token))[2]
        found = self.automaton.matches(written, budget)
        cheapest = [w for cost, w in found if cost == found[0][0]]
        if not cheapest or found[0][0] and len(cheapest) > 1:
            return tabled
        return head + (word if word in cheapest else cheapest[0]) + tail

    def text(self, text: str) -> str:
        if _plain.fullmatch(text):
            return text.strip()
        parts = _space.split(text)
        parts[0::2] = [self.token(t) for t in parts[0::2]]
        parts[1::2] = [_blank.sub(" ", b) for b in parts[1::2]]
        return "".join(parts).strip()


def vocabulary(texts: DataFrame, column: str, size: int = VOCABULARY) -> list[str]:
    """The most frequent words of each hash bucket, in normal form, over all texts.

    Counted in the JVM with map-side combining; no more than ``size`` words of up
    to 64 characters come to the driver.
    """
    marks = r"^[^\p{L}\p{N}]+|[^\p{L}\p{M}\p{N}]+$"
    words = (
        texts.select(F.explode(F.split(column, r"[\s\u00a0]+")).alias("token"))
        .groupBy("token")
        # The token comes out of the aggregate once more: what is asked of it below is asked per token, not per row.
        .agg(F.count("*").alias("n"), F.max("token").alias("one"))
        .select(F.regexp_replace("one", marks, "").alias("word"), "n")
        .where(F.length("word").between(1, 64) & F.col("word").rlike(f"^[{_NORMAL}]+$") & F.col("word").rlike(r"\p{L}"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    rows = sorted(most_frequent(words, "word", "n", size).collect(), key=lambda row: (-row.n, row.word))
    return [row.word for row in rows]


class _Signature:
    """Per row two 128-bit prints: of the text's one form and of the text as stored."""

    def __init__(self, words):
        self.words, self.canonical = words, None

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.words, self.canonical = words, None

    def __call__(self, batch):
        import xxhash

        self.canonical = self.canonical or Canonical(self.words)
        one, raw = [], []
        for field, text in zip(batch["field"], batch["text"]):
            form = self.canonical.text(text)
            one.append(xxhash.xxh3_128_digest(f"{field}\x00{form}".encode("utf-8", "surrogatepass")))
            raw.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
        return {"field": batch["field"], "row_id": batch["row_id"], "one": one, "raw": raw}


class _Text(_Signature):
    def __call__(self, batch):
        self.canonical = self.canonical or Canonical(self.words)
        forms = [None if t is None else self.canonical.text(t) for t in batch["text"]]
        return {"field": batch["field"], "row_id": batch["row_id"], "canonical": forms}


def canonical_texts(texts: DataFrame) -> DataFrame:
    """(field, row_id, text) to (field, row_id, canonical); rows and nulls are kept."""
    words = vocabulary(texts, "text")
    return map_batches(texts, _Text(words), "field string, row_id bigint, canonical string")


def classes(texts: DataFrame) -> DataFrame:
    """(field, row_id, class_id, spelling, n_spellings): the rows whose text looks like another spelling of itself.

    ``class_id`` is the print of the form, ``spelling`` that of the text as
    stored; rows of forms with one spelling, among them groups of exact copies of
    any size, are left out by a pre-aggregated minimum and maximum. Only prints
    and ids are shuffled, and they are written once.
    """
    texts = texts.where(F.col("text").isNotNull())
    words = vocabulary(texts, "text")
    prints = cut(map_batches(texts, _Signature(words), "field string, row_id bigint, one binary, raw binary"))
    varied = prints.groupBy("one").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("one")
    rows = prints.join(varied, "one", "left_semi")
    counts = rows.groupBy("one", "raw").agg(F.count("*").alias("n")).groupBy("one").agg(F.count("*").alias("n_spellings"))
    return rows.join(counts, "one").select("field", "row_id", F.col("one").alias("class_id"), F.col("raw").alias("spelling"), "n_spellings")


def equal_looking_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of rows of a field whose texts look the same but differ in code points.

    Pairs are drawn between the different spellings of a class, one row each,
    and only then between their rows, so copies of one spelling never meet each
    other. Hot spellings are split by adaptive execution.
    """
    rows = cut(classes(texts).select("field", "row_id", "class_id", "spelling"))
    spellings = rows.select("class_id", "spelling").distinct()
    linked = spellings.join(spellings.select("class_id", F.col("spelling").alias("other")), "class_id").where("spelling < other")
    a = linked.join(rows.select("spelling", "class_id", "field", F.col("row_id").alias("id_1")), ["class_id", "spelling"])
    b = a.join(rows.select(F.col("spelling").alias("other"), "class_id", F.col("row_id").alias("id_2")), ["class_id", "other"])
    # Rows that share their id are no pair.
    pairs = b.where("id_1 <> id_2")
    return pairs.select("field", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
