"""Sources mixed to target shares of tokens (problem 7).

Sizes are counted with a public tokenizer. Each source's weight is its share of
the total; a source too small for it is repeated, at most as often as allowed,
and what it can't fill is left to the others in proportion. The mixture is a
sequence of slots of equal size: slot i takes the golden-ratio point of i and
maps it through the cumulative weights of the sources, so every stretch of
slots has nearly the target shares. The slots of a source are ranked, and its
r-th slot holds the r-th block of that source's documents in hash order, pass
after pass. How often a document is used is how many of its source's slots hold
it.

Defined results: documents of no target source, with a null source or without
text take part 0 times; a target source without documents gets share 0; names
are matched to the targets' without case, blanks and look-alike marks, and
within two edits if one target is nearest.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.prefix import running_total
from verdigris.session import cut, map_batches

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
#: Tokens of a slot.
BLOCK_TOKENS = 4096
#: Documents of a source, or slots, that are counted in one bucket; a power of two.
BUCKET_ROWS = 1 << 17
#: Rows that the table of targets may have; it is held by the driver.
MOST_SOURCES = 10_000
GOLDEN = 0.6180339887498949
#: The usual way byte-level vocabularies part a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Count:
    """Tokens per text; the vocabulary travels with the function, so that no worker needs the file."""

    def __init__(self, vocabulary: bytes):
        self.vocabulary, self.encoding = vocabulary, None

    def __getstate__(self):
        return self.vocabulary

    def __setstate__(self, vocabulary):
        self.vocabulary, self.encoding = vocabulary, None

    def __call__(self, batch):
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines())}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        counts = [0 if t is None else len(self.encoding.encode_ordinary(t)) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": counts}


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, source, text) to (doc_id, source, n_tokens). The driver reads the vocabulary at ``path``."""
    with open(path, "rb") as file:
        count = _Count(file.read())
    return map_batches(documents.select("doc_id", "source", "text"), count, "doc_id bigint, source string, n_tokens bigint")


def matched_sources(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(raw_source, source): per spelling the target name it stands for; spellings that stand for none are left out.

    Works on different spellings, not on rows; the targets are a small table, so
    every spelling may be compared with each of them.
    """
    flat = F.regexp_replace(F.lower(F.trim("raw_source")), r"[^\p{L}\p{N}]+", "_")
    spelled = sources.where("raw_source is not null").distinct().withColumn("flat", flat).withColumn("digits", F.regexp_replace("flat", r"\D", ""))
    names = targets.select(F.lower("source").alias("name"), F.col("source"), F.regexp_replace("source", r"\D", "").alias("digits"))
    near = (
        spelled.join(names, "digits")
        .withColumn("d", F.levenshtein("flat", "name"))
        .where(F.col("d") <= F.least(F.lit(2), F.floor(F.least(F.length("flat"), F.length("name")) / 4)))
    )
    best = near.groupBy("raw_source").agg(F.min("d").alias("d"))
    return near.join(best, ["raw_source", "d"]).groupBy("raw_source").agg(F.min("source").alias("source"), F.count("*").alias("n")).where("n = 1").drop("n")


def quotas(targets: list[tuple[str, float, int]], supply: dict[str, int], total: int) -> dict[str, int]:
    """Tokens per source: shares of the total, capped by supply times repeats, the rest shared out anew."""
    cap = {s: supply.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    share = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    given = {s: 0 for s in cap}
    open_sources = {s for s in cap if cap[s] and share[s]}
    left = total
    while open_sources and left > 0:
        weight = sum(share[s] for s in open_sources)
        full = {s for s in open_sources if left * share[s] / weight >= cap[s]}
        if not full:
            for s in open_sources:
                given[s] = int(left * share[s] / weight)
            break
        for s in full:
            given[s] = cap[s]
        left = total - sum(cap[s] for s in cap if given[s] == cap[s] and s not in open_sources - full)
        open_sources -= full
    return given


class Plan:
    """The mixture of a corpus: documents with repeats, shares reached, and the schedule."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, tokenizer: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"):
        self.spark, self.block = documents.sparkSession, block
        rows = targets.select("source", "target_share", "max_repeats").orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError("the table of targets is larger than the driver may hold")
        self.targets = [(r.source, r.target_share, r.max_repeats) for r in rows]
        counted = cut(token_counts(documents, tokenizer).withColumnRenamed("source", "raw_source").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(2**40))))
        # Counted once; ids, names and sizes feed the totals, the repeats and the schedule.
        meant = matched_sources(counted.select("raw_source"), targets)
        self.documents = cut(counted.join(meant, "raw_source", "left"))
        sums = self.documents.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        found = sums.collect()  # one row per target source
        self.supply = {r.source: r.t for r in found}
        self.count = {r.source: r.n for r in found}
        self.total = sum(self.supply.values()) if total is None else total
        self.quota = quotas(self.targets, self.supply, self.total)
        self.n_slots = -(-sum(self.quota.values()) // block)

    def _slots(self) -> DataFrame:
        """(slot, source): the golden-ratio point of each slot through the cumulative weights."""
        stops, total = [], 0
        for s, _, _ in self.targets:
            total += self.quota[s]
            stops.append(float(total))
        names = F.array(*[F.lit(s) for s, _, _ in self.targets])
        point = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)") * F.lit(float(total))
        passed = F.size(F.filter(F.lit(stops), lambda stop: stop <= F.col("point")))
        slots = self.spark.range(self.n_slots).select(F.col("id").alias("slot"), point.alias("point"))
        return slots.select("slot", F.get(names, passed).alias("source"))

    def _table(self):
        data = [
            (s, float(w or 0), int(r or 0), int(self.supply.get(s, 0)), int(self.count.get(s, 0)), int(self.quota[s]))
            for s, w, r in self.targets
        ]
        return self.spark.createDataFrame(
            data, "source string, target_share double, max_repeats int, supply bigint, n_documents bigint, quota bigint"
        )

    def _placed(self) -> DataFrame:
        """Documents of target sources with ``start``, the tokens of their source before them, and the room that the source's slots give."""
        held = self._slots().groupBy("source").agg((F.count("*") * self.block).alias("room")) if self.targets and self.n_slots else None
        table = self._table().select("source", "supply", "max_repeats")
        table = table.withColumn("room", F.lit(0).cast("bigint")) if held is None else table.join(held, "source", "left").na.fill(0, ["room"])
        buckets = 1 << max(0, (max(self.count.values(), default=0) // BUCKET_ROWS).bit_length())
        mine = self.documents.where("source is not null").withColumn("bucket", F.floor(F.col("place") / (2**40 // buckets)).cast("int"))
        placed = running_total(mine, ["source"], "bucket", [F.col("place"), F.col("doc_id")], "n_tokens", "start")
        return placed.join(F.broadcast(table), "source")  # one row per target source, whose number is checked

    def repeats(self) -> DataFrame:
        """Every document with the number of slots' passes that reach it, at most ``max_repeats``."""
        passes = F.when((F.col("start") < F.col("room")) & (F.col("supply") > 0), F.floor((F.col("room") - 1 - F.col("start")) / F.col("supply")) + 1).otherwise(0)
        used = self._placed().select(
            "doc_id", "source", "n_tokens", "start", "supply", F.least(passes, F.col("max_repeats")).cast("int").alias("repeats")
        )
        rest = self.documents.where("source is null").select(
            "doc_id", "source", "n_tokens", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("supply"), F.lit(0).alias("repeats")
        )
        return used.unionByName(rest)

    def shares(self) -> DataFrame:
        """Per source what it was to give and what it gives."""
        given = (
            self.repeats()
            .where("source is not null")
            .groupBy("source")
            .agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
        )
        table = self._table().join(given, "source", "left").na.fill(0, ["tokens", "most_repeats"])
        total = F.coalesce(given.agg(F.sum("tokens")).scalar(), F.lit(0))
        return table.withColumn("all_tokens", total).select(
            "source",
            "target_share",
            "max_repeats",
            "n_documents",
            "supply",
            "quota",
            "tokens",
            "most_repeats",
            F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
        )

    def schedule(self) -> DataFrame:
        """(slot, source, pass, doc_id, n_tokens): the mixture in order of slots."""
        buckets = 1 << max(0, (self.n_slots // BUCKET_ROWS).bit_length())
        slots = self._slots().withColumn("one", F.lit(1)).withColumn("bucket", F.floor(F.col("slot") / max(1, -(-self.n_slots // buckets))).cast("int"))
        ranked = running_total(slots, ["source"], "bucket", [F.col("slot")], "one", "block").select("slot", "source", "block")
        uses = (
            self.repeats()
            .where("repeats > 0")
            .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
            .withColumn("block", F.floor((F.col("pass") * F.col("supply") + F.col("start")) / self.block))
        )
        return uses.join(ranked, ["source", "block"]).select("slot", "source", "pass", "doc_id", "n_tokens")
