"""Encode, decode, verify and measure: the engine's verbs over DataFrames of blocks.

Lines are parsed by Catalyst expressions; only the serialiser and the codec run in Python, a block at a time, on
blocks of bounded size.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linemill.functions import tokens as t
from linemill.functions.sizes import ratio
from linemill.operators import blocks as b
from linemill.operators import registry as r
from linemill.operators.columns import SAMPLE_TEMPLATES, SAMPLE_VALUES
from linemill.sources.codecs import Codec, xz
from linemill.sources.codecs import codec as codec_of
from linemill.sources.framing import RAW, SPLIT_TEMPLATES, Corrupt, Parsed, Stored, layout_of, opened, stored

ENCODED = "block_id string, crc32 long, flag int, c_reg binary, c_ids binary, c_vars binary, mode string, layout string, reason string, n_lines long, n_templates long, size_in long, size_out long"


def parsed_from(skeletons: list[str], values: list[list[str]], latin: bool) -> Parsed:
    """A block's parse from its lines in order."""
    ids: dict[str, int] = {}
    order = np.fromiter((ids.setdefault(s, len(ids)) for s in skeletons), np.int64, len(skeletons))
    columns: list[list[list[str]]] = [[[] for _ in range(s.count(t.PLACEHOLDER))] for s in ids]
    for i, row in zip(order.tolist(), values, strict=True):
        for column, v in zip(columns[i], row, strict=True):
            column.append(v)
    return Parsed(list(ids), order, columns, latin)


def parsed_of(skeletons: pa.Array, values: pa.ListArray, latin: bool) -> Parsed:
    """The same from Arrow columns, without a Python object for each line or value."""
    coded = skeletons.dictionary_encode()  # in the order of first appearance
    order, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    flat, begin = values.values, values.offsets.to_numpy()[:-1]
    columns: list[list[pa.Array]] = []
    by_id = np.argsort(order, kind="stable")
    at = np.searchsorted(order[by_id], np.arange(len(known) + 1))
    for i, s in enumerate(known):
        first = begin[by_id[at[i] : at[i + 1]]]
        columns.append([flat.take(pa.array(first + c)) for c in range(s.count(t.PLACEHOLDER))])
    return Parsed(known, order, columns, latin)


def _reason(p: Parsed, mode: str, feeds: int, collides_at: int) -> str | None:
    """Whichever comes first of a line that collides and the template beyond the gate's limit; None: the block is parsed."""
    limit = max(int((feeds + 1) * r.GATE_SHARE[mode]), r.GATE_FLOOR) + 1
    gate_at = int(np.argmax(p.ids == limit)) if len(p.skeletons) > limit else -1
    if collides_at >= 0 and (gate_at < 0 or collides_at <= gate_at):
        return "Collision Protected"
    return "Passthrough [Entropy]" if gate_at >= 0 else None


def encode(blocks: DataFrame, codec: str | Codec = "xz", mode: str | None = None, chunk_bytes: int | None = None, dictionary: int | None = None, check: bool = False) -> DataFrame:
    """ENCODED rows of (block_id, payload binary). A block that is binary, collides or has too many templates is stored raw.

    ``chunk_bytes`` cuts blocks at line feeds first; ``dictionary`` sets the dictionary of the default codec; ``check``
    restores each block at once and raises if it doesn't come back. A block is one row: it is split and parsed by array
    expressions, without a shuffle.
    """
    c = xz(dictionary) if dictionary else codec_of(codec)
    named = blocks.select(F.col("block_id").cast("string").alias("block_id"), "payload")
    named = b.chunked(named, chunk_bytes) if chunk_bytes else named
    split = named.select("block_id", "payload", t.encoding(F.col("payload")).alias("encoding"), t.likely_binary(F.col("payload")).alias("binary"), t.split_lines(t.decoded(F.col("payload"))).alias("lines"))
    sampled = F.transform(F.slice("lines", 1, r.SAMPLE_LINES), lambda x: t.skeleton(t.for_analysis(x)))
    share = F.try_divide(F.size(F.array_distinct(sampled)), F.size(sampled))
    chosen = F.lit(mode) if mode else F.when(F.size("lines") > 0, F.when(share > r.AGGRESSIVE_ABOVE, "aggressive").otherwise("strict"))
    moded = split.select("*", chosen.alias("mode"))
    parse = lambda f, kind: F.when(~F.col("binary"), F.transform("lines", lambda x: t.by_mode(x, F.col("mode"), f))).cast(kind)
    collides = F.array_position(F.transform("lines", lambda x: t.collides(x)), F.lit(True)) - 1
    feeds = F.size(F.filter("lines", lambda x: F.endswith(x, F.lit("\n"))))
    whole = moded.select("block_id", "payload", "encoding", "mode", collides.alias("collides_at"), feeds.alias("feeds"), parse(t.skeleton, "array<string>").alias("skeletons"), parse(t.variables, "array<array<string>>").alias("vars"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            small = batch.select(["block_id", "encoding", "mode", "collides_at", "feeds"]).to_pylist()
            for i, x in enumerate(small):
                data, p, reason = batch["payload"][i].as_py(), None, "Passthrough [Binary]"
                if batch["skeletons"][i].is_valid:
                    skeletons = batch["skeletons"][i].values
                    p = parsed_of(skeletons, batch["vars"][i].values, x["encoding"] == "latin-1") if len(skeletons) else None
                    reason = _reason(p, x["mode"], x["feeds"], x["collides_at"]) if p else "Passthrough [Empty]"
                p = None if reason else p
                layout = layout_of(p, c) if p else "passthrough"
                s = stored(data, p, c, layout)
                if check and b"".join(opened(s, c)) != data:
                    raise Corrupt("a block that doesn't come back")
                size = 17 + len(s.c_reg) + len(s.c_ids) + len(s.c_vars)
                out.append({"block_id": x["block_id"], "crc32": s.crc32, "flag": s.flag, "c_reg": s.c_reg, "c_ids": s.c_ids, "c_vars": s.c_vars, "mode": x["mode"], "layout": layout, "reason": reason, "n_lines": len(p.ids) if p else data.count(b"\n") + (data[-1:] not in (b"", b"\n")), "n_templates": len(p.skeletons) if p else 0, "size_in": len(data), "size_out": size})
            yield pa.RecordBatch.from_pylist(out, schema=_ENCODED)

    return whole.mapInArrow(write, ENCODED)


def layouts(texts: DataFrame, codec: str | Codec = "xz") -> DataFrame:
    """(block_id, mode, layout, reason, flag, n_templates): what ``encode`` decides of each block, without encoding it.

    texts: (block_id, o, text), of which those of a block, in order of ``o``, are its payload; each ends with a line feed, so
    that no line goes on in the next. No block is ever formed in one place: lines are parsed where their text lies, templates
    are counted before they are shuffled, and Python and the codec see the layout's sample of each block alone.
    """
    c = codec_of(codec)
    texts = texts.select(F.col("block_id").cast("string").alias("block_id"), "o", "text")
    head = b.head_lines(texts, r.SAMPLE_LINES, t.BINARY_BYTES)
    in_block = Window.partitionBy("block_id")
    so_far = F.coalesce(F.sum(F.octet_length("line")).over(in_block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = b.blocks_of_lines(head.withColumn("before", so_far).where(F.col("before") < t.BINARY_BYTES).select("block_id", "line_no", "line"))
    binary = start.select(F.col("block_id").alias("b"), t.likely_binary(F.col("payload")).alias("binary"))
    moded = r.mode_choice(head).join(binary, F.col("block_id").eqNullSafe(F.col("b"))).select("block_id", "mode", "binary")

    def of_blocks(blocks: DataFrame, *more: str) -> DataFrame:
        """The texts of these blocks, with what is known of them."""
        known = blocks.select(F.col("block_id").alias("b"), *more)
        return texts.join(F.broadcast(known), F.col("block_id").eqNullSafe(F.col("b"))).drop("b")

    def skeletons(lines: DataFrame) -> DataFrame:
        return lines.withColumn("skeleton", t.by_mode(F.col("line"), F.col("mode"), t.skeleton))

    # Lines get places that grow within a block, which is all that first appearances need.
    ordered = of_blocks(moded.where(~F.col("binary")), "mode").repartitionByRange("block_id", "o").sortWithinPartitions("block_id", "o")
    lines = ordered.select("block_id", "mode", F.explode(t.split_lines(F.col("text"))).alias("line")).withColumn("place", F.monotonically_increasing_id())
    found = skeletons(lines).groupBy("block_id", "mode", "skeleton").agg(
        F.min("place").alias("first"), F.count_if(F.endswith("line", F.lit("\n"))).alias("feeds"), F.min(F.when(t.collides(F.col("line")), F.col("place"))).alias("hit"),
    )
    counted = found.withColumn("first_hit", F.min("hit").over(in_block)).groupBy("block_id", "mode").agg(
        F.count("*").alias("n_templates"), F.sum("feeds").alias("feeds"), F.count_if(F.col("first") < F.col("first_hit")).alias("before"), F.min("hit").alias("hit"),
    )
    limit = r.gate_limit(F.col("feeds") + 1, F.col("mode"))
    gated = F.col("n_templates") > limit
    reason = F.when(F.col("hit").isNotNull() & (~gated | (F.col("before") <= limit)), "Collision Protected").when(gated, "Passthrough [Entropy]")
    judged = counted.select("block_id", "mode", "n_templates", reason.alias("reason"))
    # Ordered by all columns, though no two templates begin in one place: so both readings of ``found`` are one exchange.
    leading = found.withColumn("n", F.row_number().over(in_block.orderBy("first", "feeds", "hit"))).where(F.col("n") <= SAMPLE_TEMPLATES)
    named = leading.groupBy(F.col("block_id").alias("b")).agg(F.sort_array(F.collect_list(F.struct("n", "skeleton"))).alias("leading"))
    parsed = judged.where(F.col("reason").isNull() & (F.col("n_templates") < SPLIT_TEMPLATES)).join(named, F.col("block_id").eqNullSafe(F.col("b"))).select("block_id", "mode", F.col("leading.skeleton").alias("leading"))
    pieces = of_blocks(parsed, "mode", "leading").select("block_id", "mode", "leading", "o", F.posexplode(t.split_lines(F.col("text"))).alias("i", "line"))
    shown = skeletons(pieces).select("block_id", "mode", (F.array_position("leading", F.col("skeleton")) - 1).alias("template_id"), "o", "i", "line").where("template_id >= 0")
    values = shown.withColumn("n", F.row_number().over(Window.partitionBy("block_id", "template_id").orderBy("o", "i"))).where(F.col("n") <= SAMPLE_VALUES)
    rows = F.struct("template_id", "n", t.by_mode(F.col("line"), F.col("mode"), t.variables).alias("vars"))
    sampled = values.groupBy("block_id").agg(F.sort_array(F.collect_list(rows)).alias("rows"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout_of(_leading(rows), c) for rows in batch["rows"].to_pylist()]
            yield pa.record_batch([batch["b"], pa.array(found, pa.string())], names=["b", "layout"])

    decided = sampled.select(F.col("block_id").alias("b"), "rows").mapInArrow(decide, "b string, layout string")
    known = judged.join(decided, F.col("block_id").eqNullSafe(F.col("b")), "left").select(F.col("block_id").alias("b"), "reason", "n_templates", "layout")
    out = moded.join(known, F.col("block_id").eqNullSafe(F.col("b")), "left")
    why = F.when(F.col("binary"), "Passthrough [Binary]").otherwise(F.col("reason"))
    raw = why.isNotNull()
    return out.select(
        "block_id", "mode", F.when(raw, "passthrough").otherwise(F.coalesce("layout", F.lit("unified"))).alias("layout"), why.alias("reason"),
        F.when(raw, RAW).otherwise(r.id_flag(F.col("n_templates"))).alias("flag"), F.when(raw, 0).otherwise(F.col("n_templates")).cast("long").alias("n_templates"),
    )


def _leading(rows: list[dict]) -> Parsed:
    """The first templates of a block with the first values of their columns, from rows in order of template and line."""
    columns: dict[int, list[list[str]]] = {}
    for x in rows:
        table = columns.setdefault(x["template_id"], [[] for _ in x["vars"]])
        for column, v in zip(table, x["vars"], strict=True):
            column.append(v)
    return Parsed([""] * len(columns), np.zeros(0, np.int64), list(columns.values()))


_ENCODED = pa.schema([
    ("block_id", pa.string()), ("crc32", pa.int64()), ("flag", pa.int32()), ("c_reg", pa.binary()), ("c_ids", pa.binary()), ("c_vars", pa.binary()), ("mode", pa.string()),
    ("layout", pa.string()), ("reason", pa.string()), ("n_lines", pa.int64()), ("n_templates", pa.int64()), ("size_in", pa.int64()), ("size_out", pa.int64()),
])


def _stored(x: dict) -> Stored:
    return Stored(x["crc32"], x["c_reg"] or b"", x["c_ids"] or b"", x["c_vars"] or b"", x["flag"])


def decode(encoded: DataFrame, codec: str | Codec = "xz") -> DataFrame:
    """(block_id, payload): the bytes of each block; one that is corrupt raises."""
    c = codec_of(codec)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([x["block_id"] for x in rows], pa.string()), pa.array([b"".join(opened(_stored(x), c)) for x in rows], pa.binary())], names=["block_id", "payload"])

    return encoded.select("block_id", "crc32", "flag", "c_reg", "c_ids", "c_vars").mapInArrow(read, "block_id string, payload binary")


def verify(encoded: DataFrame, codec: str | Codec = "xz") -> DataFrame:
    """(block_id, ok, problem, n_lines, n_bytes); nothing of a corrupt block is given out."""
    c = codec_of(codec)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                try:
                    lines, problem = opened(_stored(x), c), None
                except Corrupt as e:
                    lines, problem = [], str(e)
                out.append({"block_id": x["block_id"], "ok": problem is None, "problem": problem, "n_lines": len(lines), "n_bytes": sum(map(len, lines))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block_id", pa.string()), ("ok", pa.bool_()), ("problem", pa.string()), ("n_lines", pa.int64()), ("n_bytes", pa.int64())]))

    return encoded.select("block_id", "crc32", "flag", "c_reg", "c_ids", "c_vars").mapInArrow(check, "block_id string, ok boolean, problem string, n_lines long, n_bytes long")


def size_report(encoded: DataFrame) -> DataFrame:
    """(n_blocks, size_in, size_out, ratio) over all blocks."""
    total = encoded.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("size_in"), F.lit(0)).alias("size_in"), F.coalesce(F.sum("size_out"), F.lit(0)).alias("size_out"))
    return total.withColumn("ratio", ratio(F.col("size_in"), F.col("size_out")))


def competitor_sizes(blocks: DataFrame, codecs: list[str]) -> DataFrame:
    """(block_id, algorithm, size): each payload under plain codecs; one that doesn't come back raises."""
    found = [(name, codec_of(name)) for name in codecs]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data = bytes(x["payload"])
                for name, c in found:
                    small = c.compress(data)
                    if c.decompress(small) != data:
                        raise Corrupt(f"{name} doesn't restore a block")
                    rows.append((x["block_id"], name, len(small)))
            yield pa.record_batch([pa.array([r_[0] for r_ in rows], pa.string()), pa.array([r_[1] for r_ in rows], pa.string()), pa.array([r_[2] for r_ in rows], pa.int64())], names=["block_id", "algorithm", "size"])

    return blocks.select(F.col("block_id").cast("string").alias("block_id"), "payload").mapInArrow(sizes, "block_id string, algorithm string, size long")


def benchmark(blocks: DataFrame, codecs: list[str], own: str = "xz") -> DataFrame:
    """``ranking`` of this engine ("own", over codec ``own``) and of plain codecs by block, all of them verified, with
    ``verdict``: of the winner "WIN" if it is this engine, else "LOSS"."""
    named = blocks.select(F.col("block_id").cast("string").alias("block_id"), "payload")
    mine = encode(named, own, check=True).select(F.col("block_id").alias("file"), F.lit("own").alias("algorithm"), F.col("size_out").alias("size"))
    rest = competitor_sizes(named, codecs).withColumnRenamed("block_id", "file")
    ranked = ranking(mine.unionByName(rest), named.select(F.col("block_id").alias("file"), F.octet_length("payload").cast("long").alias("original_size")))
    return ranked.withColumn("verdict", F.when(F.col("rank") == 1, F.when(F.col("algorithm") == "own", "WIN").otherwise("LOSS")))


@contextmanager
def progress(spark: SparkSession, report: Callable[[int, int], None], seconds: float = 0.5) -> Iterator[None]:
    """While the block runs, call report(tasks done, tasks) of the running stages, now and then and at the end."""
    done, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def watch() -> None:
        while not done.wait(seconds):
            found = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            if found:
                report(sum(x.numCompletedTasks for x in found), sum(x.numTasks for x in found))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
        report(1, 1)
    finally:
        done.set()
        thread.join()


def ranking(sizes: DataFrame, original: DataFrame) -> DataFrame:
    """(file, rank, algorithm, size, ratio, diff_vs_winner, saving_pct): by size; the saving is the winner's over the runner-up.

    sizes: (file, algorithm, size); original: (file, original_size).
    """
    w = Window.partitionBy("file").orderBy("size", "algorithm")
    ranked = sizes.join(original, "file").select("file", F.row_number().over(w).alias("rank"), "algorithm", "size", ratio(F.col("original_size"), F.col("size")).alias("ratio"), (F.col("size") - F.first("size").over(w)).alias("diff_vs_winner"), F.lead("size").over(w).alias("next_size"))
    saving = F.when((F.col("rank") == 1) & F.col("next_size").isNotNull(), F.try_divide((F.col("next_size") - F.col("size")) * 100.0, F.col("next_size")))
    return ranked.withColumn("saving_pct", saving).drop("next_size")
