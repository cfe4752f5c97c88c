"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder
    of its own; on a cluster, whose executors would not see it, this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="linemill-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle and checkpoint files of finished rounds go now: Spark drops them when the driver collects its garbage,
    which a driver with little to do puts off while rounds pile up files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The keys of rows that go are broadcast only if they are known to take no more, at so many bytes a row.
GONE_BYTES, GONE_ROW = 32 << 20, 64


def without(docs: DataFrame, gone: DataFrame, broadcast_bytes: int = GONE_BYTES) -> DataFrame:
    """The rows of docs but those whose id and text's hash are a row of ``gone`` (doc_id, _lm_key).

    The texts aren't shuffled while the keys are few enough to broadcast; beyond, both sides are joined by a shuffle.
    """
    id_, key = free_name(docs, "_lm_id"), free_name(docs, "_lm_key")
    keys = reliable(gone.select(F.col("doc_id").alias(id_), F.col("_lm_key").alias(key)).distinct())
    keys = F.broadcast(keys) if keys.count() * GONE_ROW <= broadcast_bytes else keys.hint("merge")
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(key)), "left_anti")


def plain(df: DataFrame, *read: str) -> tuple[DataFrame, list[str]]:
    """The table with names of its own for all columns but those that are read, so that none clashes with what an operator
    adds; and the names, in the table's order."""
    names = [c if c in read else f"_x{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), names


def renamed(df: DataFrame, names: list[str], columns: list[str]) -> list[Column]:
    """A ``plain`` table's columns under their former names."""
    return [F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Entries of a block of ``running``.
STEPS = 256


def running(lengths: Column) -> Column:
    """For each entry of an array of ints the sum of those before it, as array<int>.

    An array that grows by one entry at a time is copied each time. So sums are made within blocks of ``STEPS`` entries,
    from where the blocks begin: the work stays near proportional up to millions of entries.
    """

    def sums(items: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(items, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_block(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(whole) - 1, F.lit(0)) / STEPS).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(whole, b * STEPS + 1, F.lit(STEPS)))
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
        return let(blocks, lambda cut: F.flatten(F.zip_with(cut, sums(F.transform(cut, total), F.lit(0)), sums)))

    return let(lengths, by_block)
