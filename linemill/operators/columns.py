"""Transposition: lines to per-template columns and back, row groups, samples and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linemill.functions import tokens as t

#: Templates, values of a column, and values after which sampling ends.
SAMPLE_TEMPLATES, SAMPLE_VALUES, SAMPLE_STOP = 5, 50, 2000
#: Average row size by default, lines it is taken from, least rows of a group, rows without a chunk size.
DEFAULT_ROW, ROW_LINES, LEAST_ROWS, DEFAULT_ROWS = 200, 1000, 100, 100_000


def cells(assigned: DataFrame) -> DataFrame:
    """(block_id, template_id, col_idx, row_ord, line_no, value): one row for each variable of each line."""
    order = F.row_number().over(Window.partitionBy("block_id", "template_id").orderBy("line_no")) - 1
    ranked = assigned.withColumn("row_ord", order.cast("long"))
    return ranked.select("block_id", "template_id", F.posexplode("vars").alias("col_idx", "value"), "row_ord", "line_no").select("block_id", "template_id", "col_idx", "row_ord", "line_no", "value")


def columns(assigned: DataFrame) -> DataFrame:
    """(block_id, template_id, col_idx, values): each column's values in row order."""
    long = assigned.select("block_id", "template_id", "line_no", F.posexplode("vars").alias("col_idx", "value"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"])
    return long.groupBy("block_id", "template_id", "col_idx").agg(ordered.alias("values"))


def wide(assigned: DataFrame, template_id: int, arity: int) -> DataFrame:
    """One template's lines with a column for each variable: v0, v1, ... Reading one variable reads one column."""
    return assigned.where(F.col("template_id") == template_id).select("block_id", "line_no", *(F.get("vars", F.lit(i)).alias(f"v{i}") for i in range(arity)))


def rebuilt_from_lines(assigned: DataFrame, registry: DataFrame) -> DataFrame:
    """(block_id, line_no, line) from ids and variables."""
    return assigned.join(registry.select("block_id", "template_id", "skeleton"), ["block_id", "template_id"]).select("block_id", "line_no", t.restore(F.col("skeleton"), F.col("vars")).alias("line"))


def rebuilt_from_cells(ids: DataFrame, cells_: DataFrame, registry: DataFrame) -> DataFrame:
    """(block_id, line_no, line) from the id stream (block_id, line_no, template_id) and cells: the n-th occurrence of a
    template takes the n-th value of each of its columns."""
    place = F.row_number().over(Window.partitionBy("block_id", "template_id").orderBy("line_no")) - 1
    rows = ids.withColumn("row_ord", place.cast("long"))
    values = cells_.groupBy("block_id", "template_id", "row_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]).alias("vars"))
    joined = rows.join(values, ["block_id", "template_id", "row_ord"], "left").join(registry.select("block_id", "template_id", "skeleton"), ["block_id", "template_id"])
    return joined.select("block_id", "line_no", t.restore(F.col("skeleton"), F.coalesce("vars", F.expr("cast(array() as array<string>)"))).alias("line"))


def column_stats(assigned: DataFrame) -> DataFrame:
    """(block_id, template_id, col_idx, n_values, n_distinct, n_bytes, least, greatest)."""
    long = assigned.select("block_id", "template_id", F.posexplode("vars").alias("col_idx", "value"))
    return long.groupBy("block_id", "template_id", "col_idx").agg(
        F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.sum(F.octet_length("value")).alias("n_bytes"), F.min("value").alias("least"), F.max("value").alias("greatest"),
    )


def column_stats_of_lines(parsed_lines: DataFrame) -> DataFrame:
    """``column_stats`` from parsed lines (block_id, line_no, skeleton, vars) that have no ids yet: lines are parsed once,
    equal values are counted before they are shuffled, and ids are given to what is left, one row a column."""
    long = parsed_lines.select("block_id", "skeleton", "line_no", F.posexplode_outer("vars").alias("col_idx", "value"))
    by_value = long.groupBy("block_id", "skeleton", "col_idx", "value").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    found = by_value.groupBy("block_id", "skeleton", "col_idx").agg(
        F.sum("n").alias("n_values"), F.count("value").alias("n_distinct"), F.sum(F.col("n") * F.octet_length("value")).alias("n_bytes"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.min("first").alias("first"),
    )
    placed = found.withColumn("first", F.min("first").over(Window.partitionBy("block_id", "skeleton")))
    template = (F.dense_rank().over(Window.partitionBy("block_id").orderBy("first")) - 1).alias("template_id")
    return placed.select("block_id", template, "col_idx", "n_values", "n_distinct", "n_bytes", "least", "greatest").where("col_idx is not null")


def sample_buffer(assigned: DataFrame, registry: DataFrame) -> DataFrame:
    """(block_id, n_values, sample): the values on which the layout is decided, in template, column and row order."""
    first = cells(assigned.where(F.col("template_id") < SAMPLE_TEMPLATES)).where(F.col("row_ord") < SAMPLE_VALUES)
    per = registry.where(F.col("template_id") < SAMPLE_TEMPLATES).select("block_id", "template_id", (F.col("n_vars") * F.least("n_rows", F.lit(SAMPLE_VALUES))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block_id").orderBy("template_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    going = per.withColumn("before", before).where(F.col("before") <= SAMPLE_STOP).select("block_id", "template_id")
    taken = first.join(going, ["block_id", "template_id"])
    ordered = F.sort_array(F.collect_list(F.struct("template_id", "col_idx", "row_ord", "value")))
    return taken.groupBy("block_id").agg(F.count("*").alias("n_values"), F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("sample"))


def row_groups(lines: DataFrame, rows: int) -> DataFrame:
    """(block_id, group_no, first_row, num_rows, n_bytes) of groups of consecutive lines, and where each begins."""
    grouped = lines.groupBy("block_id", (F.col("line_no").cast("long") / rows).cast("long").alias("group_no")).agg(F.min("line_no").alias("first_row"), F.count("*").alias("num_rows"), F.sum(F.octet_length("line")).alias("n_bytes"))
    start = F.sum("n_bytes").over(Window.partitionBy("block_id").orderBy("group_no")) - F.col("n_bytes")
    return grouped.withColumn("start_offset", start)


def overlaps(first_row: Column, num_rows: Column, start: int, end: int) -> Column:
    """Groups that hold a row of start..end (0-based, inclusive); empty groups never do."""
    return (num_rows > 0) & (first_row + num_rows > start) & (first_row <= end)


def row_range(text: str) -> tuple[int, int]:
    """'A-B' (from 1, inclusive) as 0-based bounds; a bad A is 1, a bad B unbounded."""
    if text.count("-") != 1:
        raise ValueError(f"no row range: {text!r}")
    a, b = (x.strip() for x in text.split("-"))
    top = (1 << 64) - 1
    return max(0, (int(a) if a.isascii() and a.isdigit() else 1) - 1), max(0, (int(b) if b.isascii() and b.isdigit() else top) - 1)


def in_rows(lines: DataFrame, start: int, end: int) -> DataFrame:
    return lines.where(F.col("line_no").between(start, min(end, (1 << 63) - 1)))


def average_row(lines: DataFrame) -> DataFrame:
    """(block_id, avg_row, rows_per_group(chunk)): mean length plus one of the first lines, 1 at least."""
    bare = F.regexp_replace("line", "\r?\n$", "")
    return lines.where(F.col("line_no") < ROW_LINES).groupBy("block_id").agg(F.greatest(F.lit(1), F.coalesce(F.floor(F.try_divide(F.sum(F.octet_length(bare) + 1), F.count("*"))), F.lit(DEFAULT_ROW))).cast("long").alias("avg_row"))


def rows_per_group(avg_row: Column, chunk_bytes: int | None) -> Column:
    return F.lit(DEFAULT_ROWS).cast("long") if chunk_bytes is None else F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(chunk_bytes) / avg_row)).cast("long")
