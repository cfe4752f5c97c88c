"""Exact top-k inner products of a stated query set against every vector, by distributed histogram selection.

Scores are integers. A histogram of each query's scores, summed over all blocks of candidates, tells which bin
holds the k-th highest score; that bin is split again until it is one score wide. Then each block passes on only
its scores at or above the k-th, and of those equal to it the k smallest ids, which is enough to break ties
exactly. Nothing but histograms and the passing rows is ever shuffled; no block of scores outlives the call that made it.

Candidates stay where they lie. Queries come in passes of at most ``query_block`` rows and ``QUERY_BYTES`` (dealt by hash, so
about that), which are broadcast: each task scores its candidates against them in blocks of bounded size. A pass reads the
candidates once for each level of the histograms; every query meets every candidate, which is the work that an exact
search asks for. What a pass finds is written to the shared folder, so that neither plan nor driver grows with the passes.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without an id; vectors of another length than a query score nothing with it; equal vectors tie and the smaller id
ranks first; a repeated id is a candidate as often as it occurs, but
not of its own query, and as a query its least vector counts; an empty table
gives an empty table. Scores have to fit a long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import reliable, shared_folder

BINS = 256
#: Bytes of the queries of a pass at most, as 64-bit integers; scores that a task holds at once.
QUERY_BYTES, SCORES = 32 << 20, 1 << 20


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, as array<long>, for the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
        .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))
    )


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum is below 2^53, else in 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if bound < 2**52:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries.astype(np.int64) @ candidates.astype(np.int64).T


class _Pass:
    """The queries of a pass by length of vector, with what is known of their k-th scores: at or above ``low``, below
    ``low`` plus the width of the bin that was chosen last, and ``need`` scores still to be counted there."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, bound: int, k: int):
        self.ids, self.low, self.need = ids, np.full(len(ids), -bound, np.int64), np.full(len(ids), k, np.int64)
        lengths, self.by_width = _lengths(vectors), {}
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            self.by_width[width] = rows, _matrix(vectors.take(pa.array(rows)), width)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of queries, ids of candidates, their scores and which of them count."""
        for batch in batches:
            ids, vectors = batch["vec_id"].to_numpy(), batch["q"]
            lengths = _lengths(vectors)
            for width, (rows, queries) in self.by_width.items():
                fit, step = np.flatnonzero(lengths == width), max(1, SCORES // len(rows))
                for i in range(0, len(fit), step):
                    part = fit[i : i + step]
                    found = ids[part]
                    yield rows, found, _scores(queries, _matrix(vectors.take(pa.array(part)), width)), found[None, :] != self.ids[rows][:, None]

    def histogram(self, batches: Iterator[pa.RecordBatch], step: int, width: int) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(self.ids), BINS), np.int64)
        for rows, _, scores, fine in self.scored(batches):
            scores -= self.low[rows][:, None]
            fine &= (scores >= 0) & (scores < width)  # the bin that the level above chose
            r, c = np.nonzero(fine)
            counts += np.bincount(rows[r] * BINS + scores[r, c] // step, minlength=counts.size).reshape(counts.shape)
        # Below the bin of the task's own k-th nothing can matter: the k-th of all tasks is no lower.
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        r, c = np.nonzero((counts > 0) & (above < self.need[:, None]))
        yield pa.record_batch([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(counts[r, c], pa.int64())], names=["query", "bin", "n"])

    def narrow(self, counts: np.ndarray, step: int) -> None:
        """Go to the bin of the k-th: the highest at which the count from above reaches what is needed; stay if there are
        fewer."""
        upto = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        chosen = (upto >= self.need[:, None]).sum(axis=1) - 1  # counts from above never rise with the bin
        rows = np.flatnonzero(chosen >= 0)
        self.need[rows] -= upto[rows, chosen[rows]] - counts[rows, chosen[rows]]
        self.low[rows] += chosen[rows] * step

    def passing(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Scores at or above the k-th; of equal ones the smaller ids, as the rest can't be among the first k."""
        q, v, s = (np.zeros(0, np.int64) for _ in range(3))
        for rows, found, scores, fine in self.scored(batches):
            r, c = np.nonzero(fine & (scores >= self.low[rows][:, None]))
            q, v, s = np.concatenate((q, rows[r])), np.concatenate((v, found[c])), np.concatenate((s, scores[r, c]))
            if len(q) > 2 * k * len(self.ids):
                q, v, s = _best(q, v, s, k)
        q, v, s = _best(q, v, s, k)
        yield pa.record_batch([pa.array(self.ids[q], pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])


def _lengths(vectors: pa.Array) -> np.ndarray:
    return vectors.value_lengths().to_numpy(zero_copy_only=False)


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[top], v[top], s[top]


def top_k(df: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, every: int = 20, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best other rows."""
    spark = df.sparkSession
    vectors = quantized(df, id_col, vector_col, scale)
    if vectors.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a table of few files
        vectors = vectors.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    vectors = reliable(vectors)
    found = vectors.agg(F.count_if(F.col("vec_id") % every == 0).alias("m"), F.max(F.size("q")).alias("width"), F.max(F.expr("aggregate(q, 0D, (a, x) -> a + cast(x as double) * cast(x as double))")).alias("top")).first()
    if not found["m"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = int(found["top"] * 1.000001) + 1  # of every |score|, as the largest squared length
    levels = [-(-(2 * bound + 1) // BINS)]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // BINS))
    passes = max(1, -(-int(found["m"]) // max(1, min(query_block, QUERY_BYTES // (8 * found["width"])))))
    number = F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(passes)).cast("int").alias("pass")
    queries = reliable(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")).select(number, "vec_id", "q"))
    out = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    for i in range(passes):
        mine = queries.where(F.col("pass") == i).select("vec_id", "q").toArrow().sort_by("vec_id")
        if mine.num_rows:
            _pass(vectors, _Pass(mine["vec_id"].to_numpy(), mine["q"].combine_chunks(), bound, k), levels, k).write.mode("append").parquet(out)
    rows = spark.read.schema("query_id long, vec_id long, score long").parquet(out)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    ranked = rows.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _pass(vectors: DataFrame, state: _Pass, levels: list[int], k: int) -> DataFrame:
    """The rows that pass of each task: k a query at most."""
    spark = vectors.sparkSession
    for width, step in zip([levels[0] * BINS, *levels], levels, strict=False):
        shared = spark.sparkContext.broadcast(state)
        part = vectors.mapInArrow(lambda b, s=shared, step=step, width=width: s.value.histogram(b, step, width), "query int, bin int, n long")
        summed = part.groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow()  # query_block x BINS numbers at most
        counts = np.zeros((len(state.ids), BINS), np.int64)
        counts[summed["query"].to_numpy(), summed["bin"].to_numpy()] = summed["n"].to_numpy()
        state.narrow(counts, step)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(state)
    return vectors.mapInArrow(lambda b: shared.value.passing(b, k), "query_id long, vec_id long, score long")
