"""Benchmark decontamination by winnowing.

Of the 5-grams in each window of ten words the one of least hash is the window's fingerprint, so that any ten words a
document shares with a benchmark item give both the same fingerprint; windows that follow one another mostly share
theirs, which is kept once, with its position. Documents' fingerprints are first held against a bitmap of the benchmark's
(a fixed 8 MB, whatever the benchmark's size; a bit too many only passes on a fingerprint in vain). What passes is joined
with the benchmark's fingerprints, and the hit is extended word by word to both sides of the shared 5-gram, as far as a
window that elects it can reach: five words each way. A hit of ten words or more counts, and hits that overlap merge. An
item of fewer than ten words is one window of that length and its own fingerprint.

Defined results: a null text has no words; an item without words matches nothing; items of one id count once; rows
that repeat an id are judged each by its own text; extra columns are ignored; an empty table of documents gives an
empty table, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import hex_sha256, reliable, without
from linemill.llm._tokens import ALNUM, LOWER, U, Words, flat, grams, mix, slices, window_minimum

WINDOW, GRAM = 10, 5
MAP_BITS = 26
#: The benchmark's fingerprints are broadcast only if they are known to take no more; beyond, both sides are shuffled, and
#: the rows of one fingerprint go over so many tasks.
BROADCAST_BYTES, SALTS = 8 << 20, 32
_HIT = pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("around", pa.list_(pa.string()))])


def _chosen(words: Words, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (sorted positions, hashes) of windows of n words inside a text: distinct minima of full windows, or all
    n-grams where n is less."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    inside = np.arange(len(words) - n + 1) + n <= words.last()[: len(words) - n + 1]
    if n < window:
        at = np.flatnonzero(inside)
        return at, mix(grams(words.hash, n)[at] + U(n))
    k = min(GRAM, n)
    g = grams(words.hash, k)
    at = np.unique(window_minimum(g, n - k + 1)[inside])
    return at, mix(g[at] + U(n))


def _around(data: np.ndarray, words: Words, i: int, n: int, window: int) -> list[str | None]:
    """The words that decide about a fingerprint at word i: the n-gram itself, or with the words that its windows reach."""
    k = min(GRAM, n)
    reach = 0 if n < window else n - k
    text = int(np.searchsorted(words.of_text, i, side="right")) - 1
    lo, hi = int(words.of_text[text]), int(words.of_text[text + 1])
    size = n if n < window else k
    spelt = lambda j: LOWER[data[words.start[j] : words.end[j]]].tobytes().decode("utf-8", "replace")
    return [spelt(j) if lo <= j < hi else None for j in range(i - reach, i + size + reach)]


def _item_fingerprints(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = flat(part["text"])
            words = Words(data, at, ALNUM)
            counts, ids, text = np.diff(words.of_text), part["item_id"].to_pylist(), words.text_of()
            rows: list[tuple[int, int, list, str]] = []
            for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
                where, fps = _chosen(words, n, window)
                mine = np.minimum(counts, window)[text[where]] == n
                rows += [(fp, n, _around(data, words, i, n, window), ids[text[i]]) for i, fp in zip(where[mine].tolist(), fps[mine].view(np.int64).tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string())], names=["fp", "n", "item_around", "item_id"])


def _candidates(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, lengths: list[int], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = flat(part["text"])
            words, found = Words(data, at, ALNUM), []
            for n in lengths:
                where, fps = _chosen(words, n, window)
                bit = (fps >> U(64 - MAP_BITS)).astype(np.int64)
                hit = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                found.append((where[hit], np.full(len(hit), n, np.int32), fps[hit].view(np.int64)))
            where, length, fp = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
            order = np.argsort(where, kind="stable")
            where, length, fp = where[order], length[order], fp[order]
            offsets = np.searchsorted(where, words.of_text).astype(np.int32)
            first = np.repeat(words.of_text[:-1], np.diff(offsets))
            around = pa.array([_around(data, words, i, n, window) for i, n in zip(where.tolist(), length.tolist(), strict=True)], pa.list_(pa.string()))
            hits = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(length, pa.int32()), pa.array(where - first, pa.int64()), around], fields=list(_HIT)))
            yield pa.record_batch([part["doc_id"], part["_lm_key"], pa.array(np.diff(words.of_text), pa.int64()), hits], names=["doc_id", "_lm_key", "n_words", "hits"])


def _extended(window: int) -> tuple[Column, Column, Column]:
    """(words that agree before the shared gram, words that agree behind it, whether the gram itself does)."""
    k, reach = min(GRAM, window), window - min(GRAM, window)
    equal = lambda j: F.coalesce(F.get("around", F.lit(j)) == F.get("item_around", F.lit(j)), F.lit(False))

    def agreeing(places: list[int]) -> Column:
        out = F.lit(reach)
        for count, j in reversed(list(enumerate(places))):
            out = F.when(~equal(j), F.lit(count)).otherwise(out)
        return out

    full = F.slice("around", reach + 1, k) == F.slice("item_around", reach + 1, k)
    return agreeing(list(range(reach - 1, -1, -1))), agreeing(list(range(reach + k, 2 * reach + k))), full


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items (array), contaminated) of each row of docs."""
    spark = docs.sparkSession
    # The text's hash stands in the key, so that rows that repeat an id stay apart (equal rows have equal results).
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_lm_key"), F.col("text").cast("string").alias("text"))
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    bench = reliable(bench.mapInArrow(lambda b: _item_fingerprints(b, window), "fp long, n int, item_around array<string>, item_id string").distinct())
    size = bench.agg(F.collect_set("n").alias("lengths"), F.sum(F.octet_length(F.array_join("item_around", " ")) + F.octet_length("item_id") + 256).alias("bytes")).first()

    words = bench.select(F.shiftrightunsigned("fp", 64 - MAP_BITS).alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in words.toLocalIterator():
        bitmap[r["byte"]] = r["bits"]
    shared, lengths = spark.sparkContext.broadcast(bitmap), sorted(size["lengths"] or [])

    schema = "doc_id long, _lm_key long, n_words long, hits array<struct<fp:long,n:int,at:long,around:array<string>>>"
    base = reliable(rows.mapInArrow(lambda b: _candidates(b, shared.value, lengths, window), schema))
    hits = base.select("doc_id", "_lm_key", F.explode("hits").alias("h")).select("doc_id", "_lm_key", "h.fp", "h.n", "h.at", "h.around")
    if (size["bytes"] or 0) <= broadcast_bytes:
        joined = hits.join(F.broadcast(bench), ["fp", "n"])
    else:  # a fingerprint goes to the salts that ask for it, so that no task meets all rows of a frequent one
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_lm_key"), F.lit(SALTS)))
        joined = salted.join(salted.select("fp", "n", "salt").distinct().join(bench, ["fp", "n"]), ["fp", "n", "salt"])
    before, behind, full = _extended(window)
    begin, end = F.col("at") - F.when(F.col("n") < window, 0).otherwise(before), F.col("at") + F.when(F.col("n") < window, F.col("n")).otherwise(min(GRAM, window) + behind)
    same = F.when(F.col("n") < window, F.col("around") == F.col("item_around")).otherwise(full)
    matched = joined.where(same).select("doc_id", "_lm_key", "n", "item_id", F.struct(begin.alias("at"), end.alias("end")).alias("span")).where(F.col("span.end") - F.col("span.at") >= F.col("n"))
    spans = matched.groupBy("doc_id", "_lm_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set("span")).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["at"], a["upto"]))).alias("n")),
        lambda a: a["n"],
    )
    hit = spans.select(F.col("doc_id").alias("_id"), F.col("_lm_key").alias("_key"), "items", covered.alias("n_hit"))
    joined = base.select("doc_id", "_lm_key", "n_words").join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_lm_key").eqNullSafe(F.col("_key")), "left")
    found = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (n_hit > 0).alias("contaminated"), F.col("_lm_key"))


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", hex_sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that share no window with an item."""
    return without(docs, contamination(docs, items).where("contaminated"))
