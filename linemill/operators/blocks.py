"""Blocks of lines: the unit of independence. A line has a block_id and a line_no; partition order never counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linemill.functions import tokens as t


def lines_of_texts(df: DataFrame, block: Column, order: list[Column], text: Column, terminate: bool = True) -> DataFrame:
    """(block_id, line_no, line): a text column's values as the lines of blocks.

    ``order`` has to tell the rows of a block apart (or tie only equal values). Numbers are counted within a block, so
    blocks of bounded size keep every window small.
    """
    value = t.with_terminator(text) if terminate else text
    rows = df.where(text.isNotNull()).select(block.alias("block_id"), F.struct(*order).alias("o"), F.posexplode(t.split_lines(value)).alias("i", "line"))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("o", "i"))
    return rows.select("block_id", (place - 1).cast("long").alias("line_no"), "line")


def texts_of(df: DataFrame, block: Column, order: list[Column], text: Column) -> DataFrame:
    """(block_id, o, text): the blocks of ``lines_of_texts`` as texts that aren't split yet, a line feed behind each; ``o`` orders them."""
    o = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return df.where(text.isNotNull()).select(block.alias("block_id"), o.alias("o"), t.with_terminator(text).alias("text"))


def head_lines(texts: DataFrame, n: int, n_bytes: int) -> DataFrame:
    """(block_id, line_no, line): at least the first n lines of each block and those of its first n_bytes, from (block_id, o,
    text). Only the texts' sizes are put in order by block, not the texts."""
    sizes = texts.select("block_id", "o", (t.line_count(F.col("text")) - 1).alias("lines"), F.octet_length("text").cast("long").alias("bytes"))
    before = Window.partitionBy("block_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("block_id", "o", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("lines", "bytes")))
    first = placed.where((F.col("lines") < n) | (F.col("bytes") < n_bytes)).select(F.col("block_id").alias("b"), F.col("o").alias("first_o"))
    found = texts.join(F.broadcast(first), F.col("block_id").eqNullSafe(F.col("b")) & F.col("o").eqNullSafe(F.col("first_o")), "left_semi")
    pieces = found.select("block_id", "o", F.posexplode(F.slice(t.split_lines(F.col("text")), 1, max(n, n_bytes))).alias("i", "line"))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("o", "i"))
    return pieces.select("block_id", (place - 1).cast("long").alias("line_no"), "line")


def lines_of_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, line_no, line) of (block_id, payload binary): no shuffle, as a block is one row."""
    return blocks.select("block_id", F.posexplode(t.split_lines(t.decoded(F.col("payload")))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """(block_id, payload) of (block_id, line_no, line)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("block_id").agg(F.encode(joined, "UTF-8").alias("payload"))


def blocks_of_files(spark: SparkSession, path: str) -> DataFrame:
    """One block for each whole file: (block_id: its path, payload)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("block_id"), F.col("content").alias("payload"))


def chunked(blocks: DataFrame, chunk_bytes: int) -> DataFrame:
    """Blocks cut after the first line feed at or past each multiple of chunk_bytes: no line and no character is cut."""
    text = F.decode(F.col("payload"), "ISO-8859-1")  # a character for each byte
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_bytes}}}+(?:[^\n]*+(?:\n|$))|(?s).+"), F.lit(0))
    cut = blocks.select("block_id", F.posexplode(pieces).alias("chunk_no", "piece"))
    return cut.select(F.concat_ws("#", F.col("block_id").cast("string"), F.lpad(F.col("chunk_no").cast("string"), 9, "0")).alias("block_id"), F.encode("piece", "ISO-8859-1").alias("payload"))


def trimmed(lines: DataFrame) -> DataFrame:
    """Lines without their ends and without blank ones: lossy, for reading only."""
    return lines.withColumn("line", F.regexp_replace("line", "[\r\n]+$", "")).where("line <> ''")


def guards(blocks: DataFrame) -> DataFrame:
    """(block_id, encoding, binary, collision, n_lines) of each block, before any parsing."""
    text = t.decoded(F.col("payload"))
    return blocks.select("block_id", t.encoding(F.col("payload")).alias("encoding"), t.likely_binary(F.col("payload")).alias("binary"), t.collides(text).alias("collision"), t.line_count(text).alias("n_lines"))


def preview(lines: DataFrame, n: int = 6, chars: int = 100) -> DataFrame:
    """The first lines of each block, cut with dots."""
    bare = F.regexp_replace("line", "[\r\n]+$", "")
    return lines.where(F.col("line_no") < n).select("block_id", "line_no", F.when(F.length(bare) > chars, F.concat(F.left(bare, F.lit(chars)), F.lit("..."))).otherwise(bare).alias("line"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file: no blank lines, no comments."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> '' and not startswith(file, '#')")
