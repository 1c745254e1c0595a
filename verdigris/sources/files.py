"""File sources and sinks (S): JSON lines, JSON arrays, CSV with marks, pages of HTML, binaries, versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.text import csv_safe
from verdigris.session import cut


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object per line; blank lines are skipped. Malformed lines fail, or are dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV in which no text can pass for a formula."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    safe = df.withColumns({c: csv_safe(F.col(c)) for c in texts})
    safe.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _code_page(name: str) -> tuple[str, tuple[str, str]]:
    """Latin-1 characters that a code page leaves undefined, and those it means otherwise with what they mean."""
    undefined, here, there = "", "", ""
    for byte in range(128, 256):
        try:
            meant = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            undefined += chr(byte)
            continue
        if meant != chr(byte):
            here, there = here + chr(byte), there + meant
    return undefined, (here, there)


def text_files(spark: SparkSession, path: str, most: int | None = 15_000) -> DataFrame:
    """(path, size, sha256, encoding, text): whole files, by the first encoding that fits.

    UTF-8, UTF-16 if it says so, the Vietnamese code page, at last Latin-1,
    which fits anything. The text is capped at ``most`` characters, which is the
    interface's limit for attachments; None keeps all.
    """
    raw = spark.read.format("binaryFile").load(path)
    content = F.col("content")
    utf8 = F.try_validate_utf8(content.cast("string"))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    latin = F.decode(content, "ISO-8859-1")
    undefined, moved = _code_page("cp1258")
    defined = ~latin.rlike(f"[{undefined}]")
    as_text = lambda name, text: F.struct(F.lit(name).alias("encoding"), text.alias("text"))
    chosen = (
        F.when(marked, as_text("UTF-16", F.decode(content, "UTF-16")))
        .when(utf8.isNotNull(), as_text("UTF-8", utf8))
        .when(defined, as_text("windows-1258", F.translate(latin, *moved)))
        .otherwise(as_text("ISO-8859-1", latin))
    )
    text = F.col("c.text") if most is None else F.substring(F.col("c.text"), 1, most)
    return raw.withColumn("c", chosen).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "c.encoding", text.alias("text"))


def verified(df: DataFrame, magic: str = "%PDF-", least: int = 1024) -> Column:
    """What a downloaded file is: ok, too_small or wrong_type; ``df`` is a binaryFile frame."""
    head = F.decode(F.substring(df["content"], 1, len(magic)), "ISO-8859-1")
    return F.when(df["length"] < least, "too_small").when(head != magic, "wrong_type").otherwise("ok")


def html_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, line): the text of a page's blocks, tags and entities gone, repeats in a row dropped."""
    blocks = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    blocks = F.regexp_replace(blocks, r"(?i)</?(p|div|br|li|tr|h[1-6]|title)[^>]*>", "\n")
    text = F.regexp_replace(blocks, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return lines.withColumn("_b", before).where("_b IS NULL OR _b <> line").drop("_b")


def mined_links(pages: DataFrame, html: str, order: str | None = None) -> DataFrame:
    """(item_id, title): numbered links, the first title of each id over all pages in the order of a column, the first other than ``html`` if none is named."""
    pattern = r'(?is)<a[^>]*href="[^"]*ItemID=(\d+)[^"]*"[^>]*>(.*?)</a>'
    ids, titles = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    others = [c for c in pages.columns if c != html]
    page = F.col(order or others[0]) if order or others else F.xxhash64(html)
    links = pages.select(page.alias("_page"), F.posexplode(F.arrays_zip(ids.alias("item_id"), titles.alias("title"))).alias("_n", "l"))
    clean = F.trim(F.regexp_replace(F.col("l.title"), r"<[^>]*>", ""))
    return links.select(F.col("l.item_id").alias("item_id"), clean.alias("title"), "_page", "_n").groupBy("item_id").agg(F.min_by("title", F.struct("_page", "_n", "title")).alias("title"))


def _pointer(spark: SparkSession, path: str):
    """(step, version) that was published last, or None."""
    try:
        return spark.read.schema("step bigint, version string").json(f"{path}/_pointer").orderBy(F.desc("step"), F.desc("version")).first()
    except AnalysisException:
        return None


def version_of(spark: SparkSession, path: str) -> str | None:
    """The version that was published last, or None."""
    last = _pointer(spark, path)
    return None if last is None else last.version


def publish(df: DataFrame, path: str, version: str) -> None:
    """A new version beside the old ones, then one more pointer to it: a reader finds the old pointer until the new one is whole."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    last = _pointer(df.sparkSession, path)
    step = 1 if last is None else last.step + 1
    df.sparkSession.createDataFrame([(step, version)], "step bigint, version string").coalesce(1).write.mode("append").json(f"{path}/_pointer")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the newest pointer names."""
    return spark.read.parquet(f"{path}/version={_pointer(spark, path).version}")


def rewrite_json(df: DataFrame, path: str) -> None:
    """JSON lines in place of what stands at the path; what is read from there is written out in full first."""
    cut(df).write.mode("overwrite").json(path)


def metrics_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """A CSV with header and as it is, for measures; ``mark`` puts a byte order mark before the first name of each part."""
    named = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if mark else df
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def paged(df: DataFrame, order: list, page: int, size: int = 200) -> DataFrame:
    """One page of an ordered table; the size of a page is the feature."""
    return df.orderBy(*order).offset(page * size).limit(size)


def backup(df: DataFrame, path: str) -> str:
    """JSON lines with a checksum that doesn't depend on the order of rows; returns it."""
    df.write.mode("overwrite").json(path)
    return checksum(df)


def checksum(df: DataFrame) -> str:
    """Sum and exclusive or of the rows' 64-bit hashes, and their number, digested."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    row = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return row.select(F.sha2(F.concat_ws(":", "n", "s", "x"), 256)).first()[0]


def restore_backup(spark: SparkSession, path: str, schema: str, expected: str) -> DataFrame:
    """The rows of a backup, if their checksum is the one that ``backup`` returned."""
    df = spark.read.schema(schema).json(path)
    if checksum(df) != expected:
        raise ValueError(f"the backup at {path} isn't what was written")
    return df
