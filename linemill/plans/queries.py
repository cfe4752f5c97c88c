"""One query for each operator of the engine, over the whole tables, and its statement for DuckDB where there is one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linemill.functions import sizes, tokens as t
from linemill.operators import blocks as b
from linemill.operators import columns as c
from linemill.operators import registry as r
from linemill.plans import engine
from linemill.plans.sources import lines, lines_sql, texts
from linemill.sources import archive
from linemill.streaming import row_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXTS = ("props", "html", "documents", "conversations")
STRUCTURED = ("events", "lineitem", "customer", "part", "url")

#: The tokeniser for DuckDB. It knows no possessive repeats; on lines without an odd number of quotes that is the same.
_QUOTED = r'(?:[^"\\]|\\.|"")*'
_TOKENS = {"strict": r"0x[0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]+)?", "aggressive": r"[a-zA-Z0-9_.:\-]+"}


def _skeleton(line: str, mode: str) -> str:
    return rf"""regexp_replace({line}, '(?s)("){_QUOTED}(")|{_TOKENS[mode]}', '\1' || chr(57344) || '\2', 'g')"""


def _variables(line: str, mode: str) -> str:
    return rf"""list_transform(regexp_extract_all({line}, '(?s)"{_QUOTED}"|{_TOKENS[mode]}'), lambda v: CASE WHEN v LIKE '"%' THEN substr(v, 2, length(v) - 2) ELSE v END)"""


def _parsed(name: str, mode: str) -> str:
    return f"(SELECT *, {_skeleton('line', mode)} AS skeleton, {_variables('line', mode)} AS vars FROM {lines_sql(name)})"


def _registry(name: str, mode: str) -> str:
    return f"""(SELECT block_id, skeleton, n_rows, first_line, length(skeleton) - length(replace(skeleton, chr(57344), '')) AS n_vars,
    row_number() OVER (PARTITION BY block_id ORDER BY first_line) - 1 AS template_id,
    row_number() OVER (PARTITION BY block_id ORDER BY n_rows DESC, first_line) - 1 AS freq_id
  FROM (SELECT block_id, skeleton, count(*) AS n_rows, min(line_no) AS first_line FROM {_parsed(name, mode)} GROUP BY ALL))"""


def _mode(name: str) -> str:
    bare = r"regexp_replace(line, '\r?\n$', '')"
    line = f"CASE WHEN contains({bare}, chr(57344)) OR contains({bare}, chr(57345)) THEN '' ELSE left({bare}, 16384) END"
    return f"""(SELECT block_id, count(*) AS n_sampled, count(DISTINCT s) AS n_distinct,
    CASE WHEN count(DISTINCT s) / count(*) > 0.10 THEN 'aggressive' ELSE 'strict' END AS mode
  FROM (SELECT block_id, {_skeleton(line, 'strict')} AS s FROM {lines_sql(name)} WHERE line_no < 1000) GROUP BY block_id)"""


def _gate(name: str) -> str:
    return f"""(SELECT *, n_templates > gate_limit AS passthrough FROM (
    SELECT block_id, mode, count(*) FILTER (line LIKE '%' || chr(10)) + 1 AS n_lines, count(DISTINCT skeleton) AS n_templates,
      CAST(greatest(floor((count(*) FILTER (line LIKE '%' || chr(10)) + 1) * CASE WHEN mode = 'aggressive' THEN 0.40 ELSE 0.25 END), 100) AS BIGINT) + 1 AS gate_limit
    FROM (SELECT l.block_id, m.mode, line, CASE WHEN m.mode = 'aggressive' THEN {_skeleton('line', 'aggressive')} ELSE {_skeleton('line', 'strict')} END AS skeleton
      FROM {lines_sql(name)} l JOIN {_mode(name)} m ON l.block_id = m.block_id) GROUP BY block_id, mode))"""


def _query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _all(spark: SparkSession, sf_dir: str, names: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(lines(spark, sf_dir, n)).select(F.lit(n).alias("source"), "*") for n in names))


def _union(names: tuple[str, ...], f: Callable[[str], str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS source, * FROM ({f(n)})" for n in names)


def scratch(spark: SparkSession) -> str:
    """A new folder below what driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="linemill-")
    return f"{top}/linemill-{uuid.uuid4().hex}"


@_query("q01_split_lines", f"SELECT * FROM {lines_sql('documents')}")
def q01(spark, d):
    return lines(spark, d, "documents")


@_query("q02_skeleton_strict", _union(TEXTS, lambda n: f"SELECT block_id, line_no, {_skeleton('line', 'strict')} AS skeleton FROM {lines_sql(n)}"))
def q02(spark, d):
    return _all(spark, d, TEXTS, lambda x: x.select("block_id", "line_no", t.skeleton(F.col("line"), "strict").alias("skeleton")))


@_query("q03_skeleton_aggressive", _union(TEXTS, lambda n: f"SELECT block_id, line_no, {_skeleton('line', 'aggressive')} AS skeleton FROM {lines_sql(n)}"))
def q03(spark, d):
    return _all(spark, d, TEXTS, lambda x: x.select("block_id", "line_no", t.skeleton(F.col("line"), "aggressive").alias("skeleton")))


@_query("q04_variables", _union(("lineitem", "url"), lambda n: f"SELECT block_id, line_no, CAST(len(vars) AS INTEGER) AS n_vars, array_to_string(vars, chr(31)) AS vars FROM {_parsed(n, 'strict')}"))
def q04(spark, d):
    return _all(spark, d, ("lineitem", "url"), lambda x: r.parsed(x, "strict").select("block_id", "line_no", F.size("vars").alias("n_vars"), F.array_join("vars", "\x1f").alias("vars")))


@_query("q05_template_registry", f"SELECT block_id, CAST(template_id AS INTEGER) AS template_id, CAST(freq_id AS INTEGER) AS freq_id, skeleton, CAST(n_vars AS INTEGER) AS n_vars, n_rows, first_line FROM {_registry('events', 'strict')}")
def q05(spark, d):
    return r.templates(r.parsed(lines(spark, d, "events"), "strict"))


@_query("q06_mode_choice", _union((*STRUCTURED, *TEXTS), lambda n: f"SELECT * FROM {_mode(n)}"))
def q06(spark, d):
    return _all(spark, d, (*STRUCTURED, *TEXTS), r.mode_choice)


@_query("q07_entropy_gate", _union(TEXTS, lambda n: f"SELECT * FROM {_gate(n)}"))
def q07(spark, d):
    return _all(spark, d, TEXTS, lambda x: r.entropy_gate(r.parsed(x)))


@_query("q08_collision_guard", "SELECT doc_id, contains(x, chr(57344)) OR contains(x, chr(57345)) AS collides FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || chr(57344) WHEN doc_id % 11 = 0 THEN chr(57345) || text ELSE text END AS x FROM documents)")
def q08(spark, d):
    injected = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(t.PLACEHOLDER))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit(t.SEPARATOR), "text")).otherwise(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.collides(injected).alias("collides"))


@_query("q09_binary_guard", r"SELECT page_id, length(regexp_replace(left(x, 4096), '[^\x01-\x08\x0E-\x1F]', '', 'g')) / least(4096, strlen(x)) > 0.01 AS is_binary FROM (SELECT page_id, repeat(chr(1), CAST(page_id % 60 AS INTEGER)) || repeat(chr(11), 50) || html AS x FROM pages)")
def q09(spark, d):
    payload = F.expr("encode(concat(repeat(chr(1), cast(page_id % 60 as int)), repeat(chr(11), 50), html), 'UTF-8')")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.likely_binary(payload).alias("is_binary"))


@_query("q10_freq_remap", f"SELECT block_id, CAST(template_id AS INTEGER) AS old_id, CAST(freq_id AS INTEGER) AS new_id, n_rows FROM {_registry('part', 'strict')}")
def q10(spark, d):
    return r.templates(r.parsed(lines(spark, d, "part"), "strict")).select("block_id", F.col("template_id").alias("old_id"), F.col("freq_id").alias("new_id"), "n_rows")


_ASSIGNED = "(SELECT p.block_id, p.line_no, CAST(t.template_id AS INTEGER) AS template_id, p.vars FROM {parsed} p JOIN {registry} t ON p.block_id = t.block_id AND p.skeleton = t.skeleton)"


def _assigned(name: str, mode: str) -> str:
    return _ASSIGNED.format(parsed=_parsed(name, mode), registry=_registry(name, mode))


def _assign(spark: SparkSession, d: str, name: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    parsed = r.parsed(lines(spark, d, name), mode)
    registry = r.templates(parsed)
    return r.assigned(parsed, registry), registry


@_query("q11_assign_ids", f"SELECT block_id, line_no, template_id FROM {_assigned('events', 'strict')}")
def q11(spark, d):
    return _assign(spark, d, "events")[0].select("block_id", "line_no", "template_id")


_CELLS = "(SELECT block_id, template_id, CAST(col_idx - 1 AS INTEGER) AS col_idx, row_ord, line_no, value FROM (SELECT block_id, template_id, line_no, row_ord, unnest(vars) AS value, generate_subscripts(vars, 1) AS col_idx FROM (SELECT *, row_number() OVER (PARTITION BY block_id, template_id ORDER BY line_no) - 1 AS row_ord FROM {})))"


@_query("q12_cells", f"SELECT * FROM {_CELLS.format(_assigned('lineitem', 'strict'))}")
def q12(spark, d):
    return c.cells(_assign(spark, d, "lineitem")[0])


@_query("q13_columns_collected", f"SELECT block_id, template_id, col_idx, count(*) AS n_values, string_agg(value, chr(31) ORDER BY row_ord) AS joined FROM {_CELLS.format(_assigned('nation', 'strict'))} GROUP BY ALL")
def q13(spark, d):
    return c.columns(_assign(spark, d, "nation")[0]).select("block_id", "template_id", "col_idx", F.size("values").cast("long").alias("n_values"), F.array_join("values", "\x1f").alias("joined"))


@_query("q14_rebuild", f"SELECT * FROM {lines_sql('lineitem')}")
def q14(spark, d):
    assigned, registry = _assign(spark, d, "lineitem")
    return c.rebuilt_from_cells(assigned.select("block_id", "line_no", "template_id"), c.cells(assigned), registry)


@_query("q15_row_range", f"SELECT * FROM {lines_sql('orders')} WHERE line_no BETWEEN 249 AND 259")
def q15(spark, d):
    return c.in_rows(lines(spark, d, "orders"), *c.row_range("250-260"))


_GROUPS = f"(SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY block_id ORDER BY group_no) - n_bytes AS BIGINT) AS start_offset FROM (SELECT block_id, line_no // 1000 AS group_no, min(line_no) AS first_row, count(*) AS num_rows, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM {lines_sql('orders')} GROUP BY ALL))"


@_query("q16_group_overlap", f"SELECT * FROM {_GROUPS} WHERE num_rows > 0 AND first_row + num_rows > 1500 AND first_row <= 3200")
def q16(spark, d):
    return c.row_groups(lines(spark, d, "orders"), 1000).where(c.overlaps(F.col("first_row"), F.col("num_rows"), 1500, 3200))


@_query("q17_id_width", _union((*STRUCTURED, *TEXTS), lambda n: f"SELECT block_id, n_templates, CASE WHEN n_templates = 1 THEN 3 WHEN n_templates < 256 THEN 2 WHEN n_templates > 65535 THEN 1 ELSE 0 END AS id_flag FROM {_gate(n)}"))
def q17(spark, d):
    return _all(spark, d, (*STRUCTURED, *TEXTS), lambda x: r.entropy_gate(r.parsed(x)).select("block_id", "n_templates", r.id_flag(F.col("n_templates")).alias("id_flag")))


@_query("q18_sample_buffer", f"""WITH cells AS (SELECT * FROM {_CELLS.format(_assigned('part', 'strict'))} WHERE template_id < 5 AND row_ord < 50),
per AS (SELECT block_id, template_id, count(*) AS n FROM cells GROUP BY ALL),
going AS (SELECT block_id, template_id FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY block_id ORDER BY template_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per) WHERE before <= 2000)
SELECT block_id, count(*) AS n_values, string_agg(value, '' ORDER BY template_id, col_idx, row_ord) AS sample FROM cells JOIN going USING (block_id, template_id) GROUP BY block_id""")
def q18(spark, d):
    return c.sample_buffer(*_assign(spark, d, "part"))


@_query("q19_avg_row_size", f"SELECT block_id, avg_row, CAST(greatest(100, floor(1048576 / avg_row)) AS BIGINT) AS rows_per_group FROM (SELECT block_id, CAST(greatest(1, floor(sum(strlen(line)) / count(*))) AS BIGINT) AS avg_row FROM {lines_sql('lineitem')} WHERE line_no < 1000 GROUP BY block_id)")
def q19(spark, d):
    found = c.average_row(lines(spark, d, "lineitem"))
    return found.select("block_id", "avg_row", c.rows_per_group(F.col("avg_row"), sizes.parse_size("1MB")).alias("rows_per_group"))


@_query("q20_column_stats", f"SELECT block_id, template_id, col_idx, count(*) AS n_values, count(DISTINCT value) AS n_distinct, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes, min(value) AS least, max(value) AS greatest FROM {_CELLS.format(_assigned('lineitem', 'strict'))} GROUP BY ALL")
def q20(spark, d):
    return c.column_stats_of_lines(r.parsed(lines(spark, d, "lineitem"), "strict"))


@_query("q21_escape", "SELECT doc_id, sha256(encode(replace(replace(x, chr(1), chr(1) || chr(1)), chr(2), chr(1) || chr(3)))) AS stuffed_sha256, true AS same FROM (SELECT doc_id, chr(1) || chr(3) || coalesce(text, '') || chr(2) || chr(1) AS x FROM documents)")
def q21(spark, d):
    whole = F.expr("concat(chr(1), chr(3), coalesce(text, ''), chr(2), chr(1))")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.encode(t.escape(whole), "UTF-8"), 256).alias("stuffed_sha256"), (t.unescape(t.escape(whole)) == whole).alias("same"))


@_query("q22_crc32")
def q22(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


def _blocks(spark: SparkSession, d: str, name: str) -> DataFrame:
    return b.blocks_of_lines(lines(spark, d, name))


_CHECKED = "SELECT block_id, true AS ok, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM {} GROUP BY block_id"


@_query("q23_encode_verify", _CHECKED.format(lines_sql("events")))
def q23(spark, d):
    return engine.verify(engine.encode(_blocks(spark, d, "events"))).select("block_id", "ok", "n_lines", "n_bytes")


@_query("q24_layout_decision")
def q24(spark, d):
    # One plan for all sources: a plan for each, four times as large together, takes the driver more memory than it has.
    named = (texts(spark, d, n).withColumn("block_id", F.concat_ws(":", F.lit(n), "block_id")) for n in ("events", "part", "url", "html"))
    found = engine.layouts(reduce(DataFrame.unionByName, named), "zstd")
    parts = F.split("block_id", ":", 2)
    return found.select(F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("block_id"), "mode", "layout", "reason", "flag", "n_templates")


#: What stands for a codec in the ranking that SQL can follow: the sizes of a table's lines with runs of digits, or of letters
#: too, taken as one character.
_RANKED = ("customer", "part", "orders", "url")
_SHRUNK = {"digits": "[0-9]+", "words": "[0-9A-Za-z]+", "signs": "[^0-9A-Za-z]+"}


@_query("q25_codec_ranking", f"""WITH l AS ({_union(_RANKED, lambda n: f'SELECT line FROM {lines_sql(n)}')}),
s AS ({' UNION ALL '.join(f"SELECT source AS file, '{a}' AS algorithm, CAST(sum(strlen(regexp_replace(line, '{p}', '0', 'g'))) AS BIGINT) AS size FROM l GROUP BY source" for a, p in _SHRUNK.items())}),
f AS (SELECT source AS file, CAST(sum(strlen(line)) AS BIGINT) AS original_size FROM l GROUP BY source)
SELECT file, CAST(row_number() OVER w AS INTEGER) AS rank, algorithm, size, CASE WHEN size > 0 THEN CAST(original_size AS DOUBLE) / size ELSE 0.0 END AS ratio,
  CAST(size - first_value(size) OVER w AS BIGINT) AS diff_vs_winner,
  CASE WHEN row_number() OVER w = 1 AND lead(size) OVER w IS NOT NULL THEN (lead(size) OVER w - size) * CAST(100.0 AS DOUBLE) / lead(size) OVER w END AS saving_pct
FROM s JOIN f USING (file) WINDOW w AS (PARTITION BY file ORDER BY size, algorithm)""")
def q25(spark, d):
    found = _all(spark, d, _RANKED, lambda x: x.select("line"))
    totals = found.groupBy(F.col("source").alias("file")).agg(F.sum(F.octet_length("line")).alias("original_size"), *(F.sum(F.octet_length(F.regexp_replace("line", p, "0"))).alias(a) for a, p in _SHRUNK.items()))
    sizes_ = totals.select("file", F.explode(F.array(*(F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("size")) for a in _SHRUNK))).alias("x")).select("file", "x.algorithm", "x.size")
    return engine.ranking(sizes_, totals.select("file", "original_size"))


@_query("q26_archive_roundtrip", f"SELECT line_no AS row_no, line FROM {lines_sql('events')}")
def q26(spark, d):
    # Row numbers of this format count within a block; with one block for each 100,000 ids both columns come back.
    path = scratch(spark) + ".archive"
    archive.write_archive(engine.encode(_blocks(spark, d, "events"), "zstd"), path, parts=True)
    return archive.read_archive(spark, path, "zstd").select("row_no", "line")


@_query("q27_indexed_row_range", f"SELECT line_no AS row_no, line FROM {lines_sql('customer')} WHERE line_no BETWEEN 249 AND 1259")
def q27(spark, d):
    path = scratch(spark) + ".indexed"
    found = lines(spark, d, "customer")
    archive.write_indexed(r.parsed(found, "strict"), path, 500, "zstd")
    return archive.read_rows_of_blocks(archive.block_starts(found, 500), path, "zstd", c.row_range("250-1260")).select("row_no", "line")


@_query("q28_preview", rf"SELECT block_id, line_no, CASE WHEN length(x) > 100 THEN left(x, 100) || '...' ELSE x END AS line FROM (SELECT block_id, line_no, regexp_replace(line, '[\r\n]+$', '') AS x FROM {lines_sql('documents')} WHERE line_no < 6)")
def q28(spark, d):
    return b.preview(lines(spark, d, "documents"))


@_query("q29_passthrough_reason", _union(TEXTS, lambda n: f"SELECT block_id, CASE WHEN passthrough THEN 'Passthrough [Entropy]' END AS reason FROM {_gate(n)}"))
def q29(spark, d):
    return _all(spark, d, TEXTS, lambda x: r.passthrough_reason(r.parsed(x)))


@_query("q30_size_report")
def q30(spark, d):
    return engine.size_report(engine.encode(_blocks(spark, d, "orders"), "zstd"))


@_query("q31_stream_row_groups", "SELECT count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, true AS ok FROM " + lines_sql("events"))
def q31(spark, d):
    out = scratch(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    text = F.expr("concat_ws(',', event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss'), user_id, event_type, cast(value as decimal(18,2)), props)")
    row_groups.encode_stream(stream.select("event_id", text.alias("line")), "event_id", "line", f"{out}/blocks", f"{out}/state", "zstd").awaitTermination()
    checked = engine.verify(spark.read.parquet(f"{out}/blocks"), "zstd")
    return checked.agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"), F.bool_and("ok").alias("ok"))


@_query("q32_wide_columns", f"SELECT block_id, line_no, vars[1] AS v0, vars[2] AS v1, vars[3] AS v2 FROM {_assigned('nation', 'strict')} WHERE template_id = 0")
def q32(spark, d):
    return c.wide(_assign(spark, d, "nation")[0], 0, 3)


@_query("q33_encoding", "SELECT doc_id, 'utf-8' AS encoding, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents")
def q33(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.encoding(F.encode("text", "UTF-8")).alias("encoding"), t.line_count(F.col("text")).alias("n_lines"))


@_query("q34_rank_templates", f"SELECT * FROM (SELECT block_id, skeleton, n_rows, CAST(rank() OVER (PARTITION BY block_id ORDER BY n_rows DESC) AS INTEGER) AS place FROM {_registry('url', 'aggressive')}) WHERE place <= 10")
def q34(spark, d):
    registry = r.templates(r.parsed(lines(spark, d, "url"), "aggressive"))
    return registry.select("block_id", "skeleton", "n_rows", F.rank().over(Window.partitionBy("block_id").orderBy(F.desc("n_rows"))).alias("place")).where("place <= 10")


@_query("q35_size_text", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' bytes' AS size_text FROM orders")
def q35(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", sizes.size_text(F.floor("o_totalprice").cast("long")).alias("size_text"))


@_query("q36_competitors")
def q36(spark, d):
    found = _all(spark, d, ("part", "customer", "nation", "url"), lambda x: b.blocks_of_lines(x))
    named = found.select(F.concat_ws("/", "source", "block_id").alias("block_id"), "payload")
    return engine.benchmark(named, ["xz", "zstd", "zlib", "bz2"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events rendered as lines, their templates mined and counted."""
    return q05(spark, d)
