"""The tables' columns as sources of lines, in Spark and in SQL: the same blocks, order and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.operators import blocks as b


@dataclass(frozen=True)
class LineSource:
    """``text``, ``block`` and ``order`` are expressions both engines read alike, but for dates and whole division."""

    table: str
    text: str
    block: str
    order: tuple[str, ...]

    def sql(self, expression: str) -> str:
        for a, b_ in ((" div ", " // "), ("date_format(", "strftime("), ("'yyyy-MM-dd HH:mm:ss'", "'%Y-%m-%d %H:%M:%S'"), ("'yyyy-MM-dd'", "'%Y-%m-%d'"), ("as string", "as varchar")):
            expression = expression.replace(a, b_)
        return expression


#: Blocks are ranges of a key, so that no block grows with its table.
SOURCES: dict[str, LineSource] = {
    "events": LineSource("events", "concat_ws(',', event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss'), user_id, event_type, cast(value as decimal(18,2)), props)", "cast(event_id div 100000 as string)", ("event_id",)),
    "props": LineSource("events", "props", "cast(event_id div 100000 as string)", ("event_id",)),
    "lineitem": LineSource("lineitem", "concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(18,2)), cast(l_extendedprice as decimal(18,2)), l_returnflag, l_linestatus, date_format(l_shipdate, 'yyyy-MM-dd'))", "cast(l_orderkey div 25000 as string)", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")),
    "customer": LineSource("customer", "concat_ws(',', c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2)), c_mktsegment)", "cast(c_custkey div 100000 as string)", ("c_custkey",)),
    "part": LineSource("part", "concat_ws(',', p_partkey, p_name, p_brand, p_type, p_size)", "cast(p_partkey div 100000 as string)", ("p_partkey",)),
    "orders": LineSource("orders", "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)), date_format(o_orderdate, 'yyyy-MM-dd'), o_orderpriority)", "cast(o_orderkey div 100000 as string)", ("o_orderkey",)),
    "nation": LineSource("nation", "concat_ws(',', n_nationkey, n_name, n_regionkey)", "'0'", ("n_nationkey",)),
    "url": LineSource("pages", "url", "cast(page_id div 100000 as string)", ("page_id",)),
    "html": LineSource("pages", "html", "cast(page_id div 100000 as string)", ("page_id",)),
    "documents": LineSource("documents", "text", "concat(lang, '-', cast(doc_id div 10000 as string))", ("doc_id",)),
    "conversations": LineSource("conversations", "text", "cast(conv_id div 10000 as string)", ("conv_id", "turn")),
}


def lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(block_id, line_no, line) of a source."""
    s = SOURCES[name]
    table = spark.read.parquet(f"{sf_dir}/{s.table}.parquet")
    return b.lines_of_texts(table, F.expr(s.block), [F.col(c) for c in s.order], F.expr(s.text))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(block_id, o, text) of a source: its blocks as texts that aren't split yet."""
    s = SOURCES[name]
    table = spark.read.parquet(f"{sf_dir}/{s.table}.parquet")
    return b.texts_of(table, F.expr(s.block), [F.col(c) for c in s.order], F.expr(s.text))


def lines_sql(name: str) -> str:
    """The same as a SELECT for DuckDB."""
    s = SOURCES[name]
    order = ", ".join(s.order)
    text = s.sql(s.text)
    return rf"""(
  SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY {order}, piece) - 1 AS BIGINT) AS line_no, line FROM (
    SELECT {s.sql(s.block)} AS block_id, {order}, unnest(regexp_extract_all(full_text, '[^\n]*\n|[^\n]+')) AS line,
      generate_subscripts(regexp_extract_all(full_text, '[^\n]*\n|[^\n]+'), 1) AS piece
    FROM (SELECT *, {text} || CASE WHEN {text} LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS full_text FROM {s.table})))"""
