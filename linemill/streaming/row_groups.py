"""Row groups from a stream: each micro-batch becomes groups of their own, with their own registry.

Streaming here is not a loop over chunks but a streaming query whose batches are
encoded by the same plan as a static table. A batch that is written again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linemill.functions import tokens as t
from linemill.operators import blocks as b
from linemill.plans import engine


def encode_stream(stream: DataFrame, order_col: str, text_col: str, out: str, checkpoint: str, codec: str = "xz", mode: str | None = None, block_rows: int = 100_000) -> StreamingQuery:
    """Encoded blocks of each micro-batch under out/batch=N; ends when what is there has been read."""

    def write(batch: DataFrame, n: int) -> None:
        block = F.concat(F.lit(f"{n:012d}-"), F.lpad((F.col(order_col) / block_rows).cast("long").cast("string"), 12, "0"))
        lines = b.lines_of_texts(batch, block, [F.col(order_col)], F.col(text_col))
        engine.encode(b.blocks_of_lines(lines), codec, mode).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def template_counts(stream: DataFrame, text_col: str, time_col: str, window: str = "1 hour", late: str = "1 hour", mode: str = "strict") -> DataFrame:
    """(window, skeleton, n_rows) of a stream with event time: templates counted by tumbling window under a watermark."""
    rows = stream.withWatermark(time_col, late).select(time_col, t.skeleton(F.col(text_col), mode).alias("skeleton"))
    return rows.groupBy(F.window(time_col, window), "skeleton").agg(F.count("*").alias("n_rows"))


def parsed_stream(stream: DataFrame, text_col: str, mode: str = "strict") -> DataFrame:
    """The stream with skeleton and vars: a stateless projection."""
    return stream.select("*", t.skeleton(F.col(text_col), mode).alias("skeleton"), t.variables(F.col(text_col), mode).alias("vars"), F.lit(mode).alias("mode"))


__all__ = ["encode_stream", "parsed_stream", "template_counts"]
