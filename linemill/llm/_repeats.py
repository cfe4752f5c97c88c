"""Exact detection of what repeats across a corpus, at the cost of one sampled position in a dozen.

A window is a stretch that counts as repeated if it occurs again: 50 bytes, or so many lines. Each window elects
one *anchor*, the least hash among the grams inside it, so equal windows elect equal anchors and consecutive
windows mostly share one. Three rounds settle, for each window, if it stands earlier in the corpus as well:

1. Which anchor grams occur more than once at all, and whether the stretch of windows that an anchor stands for
   always reads the same.
2. Of the anchors that do, which stretches stand earlier as a whole.
3. Of what is left where stretches differ, which single windows stand earlier.

Round 1 only proposes; what rounds 2 and 3 find is deleted, so their keys are 96 bits taken from the text itself and not
from the rolling hashes of the search (``Keys``). Among 10^13 of them one clash is expected in a thousand corpora.

Each round is one exchange. A chunk of documents (a range of ids) sends each key once, as a sorted run cut by key
range, so a key met in a third of all documents costs one entry a chunk: no group of a key's occurrences ever
forms. For each key range the runs of all chunks are taken in order of the ids and answered from a *logarithmic
index family*: a new run is merge-scanned against each level, then becomes a level itself, and levels of equal size
merge. The answer is a bit or two for each entry.

The texts are shuffled once, by chunk; the rounds read that same exchange again (Spark's exchange reuse). Chunks hold
about equal numbers of *bytes*, whatever the lengths of the texts at neighbouring ids; an id that holds more than a chunk
gets chunks of its own, cut by how its texts begin. Only a single text, or texts of one id that begin with the same eight
characters, stay together: a task takes a chunk, or the longest such. The driver sees the limits of the chunks, of which
there are never more than about ``MOST_CHUNKS`` (beyond, chunks grow), and nothing is broadcast. The rows of a round are
runs: chunks x buckets, with one bucket for each ``BUCKET_CHUNKS`` chunks and no more than ``MOST_BUCKETS``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import reliable
from linemill.llm._tokens import U, mix, trim

CHUNK, BUCKET = "_lm_chunk", "_lm_bucket"
RUNS = f"{BUCKET} int, {CHUNK} int, n long, a binary, b binary, c binary"
REPLIES = f"{CHUNK} int, {BUCKET} int, a binary, state binary"
#: Bits of a gram key. Different grams may share one: that only asks the later rounds more.
GRAM_BITS = 48
LAST = (1 << 63) - 1
#: At most so many limits of chunks come to the driver; a bucket for so many chunks; at most so many buckets.
MOST_CHUNKS, BUCKET_CHUNKS, MOST_BUCKETS = 1 << 17, 4, 1 << 16


def grown(total: int, chunk_bytes: int) -> tuple[int, int]:
    """(bytes of a chunk, number of buckets) for so many bytes of text."""
    chunk_bytes = max(chunk_bytes, total // MOST_CHUNKS)
    return chunk_bytes, max(1, min(MOST_BUCKETS, -(-total // (BUCKET_CHUNKS * chunk_bytes))))


@dataclass(frozen=True)
class Limits:
    """Where chunks begin: (id, first characters of the text, in hex). ``group``: chunks of one id share a number."""

    ids: list[int]
    starts: list[str]
    group: list[int]

    def chunk(self, ids: Column, start: Column) -> Column:
        """The number of limits at or below a row, less one, by binary search."""
        if len(self.ids) < 2:
            return F.lit(0)
        listed = lambda items: F.split(F.lit(",".join(map(str, items))), ",")  # noqa: E731  folded into one constant
        bounds, starts = listed(self.ids).cast("array<bigint>"), listed(self.starts)

        def below(i: Column) -> Column:
            found = F.get(bounds, i)
            return (found < ids) | ((found == ids) & (F.get(starts, i) <= start)) if any(self.starts) else found <= ids

        steps = [1 << i for i in range(len(self.ids).bit_length())][::-1]
        take = lambda at, s: (at + s < len(self.ids)) & F.coalesce(below(at + s), F.lit(False))
        return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(take(at, s), at + s).otherwise(at))


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def _start(docs: DataFrame) -> Column:
    return F.coalesce(F.hex(F.encode(F.left(docs["text"], F.lit(8)), "UTF-8")), F.lit(""))


def limits_of(docs: DataFrame, chunk_bytes: int) -> tuple[Limits, int]:
    """Ranges of about ``chunk_bytes`` of text each, or more where they would be too many; the number of buckets."""
    sized = docs.select(_id(docs).alias("id"), _start(docs).alias("start"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sized = reliable(sized.groupBy("id", "start").agg(F.sum("bytes").alias("bytes")))
    total = int(sized.agg(F.sum("bytes").alias("n")).first()["n"] or 0)
    chunk_bytes, buckets = grown(total, chunk_bytes)

    def walk(batches):
        size, last, large = None, None, False
        for batch in batches:
            out: list[tuple[int, str]] = []
            for i, start, n, whole in zip(*(batch[c].to_pylist() for c in ("id", "start", "bytes", "whole")), strict=True):
                if size is None or (i != last and (large or size + whole > chunk_bytes)) or (i == last and large and size + n > chunk_bytes):
                    out.append((i, start if i == last else ""))
                    size = 0
                size, last, large = size + n, i, whole > chunk_bytes
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["id", "start"])

    whole = sized.repartitionByRange("id").withColumn("whole", F.sum("bytes").over(Window.partitionBy("id")))
    found = whole.sortWithinPartitions("id", "start").mapInArrow(walk, "id long, start string").toArrow().sort_by([("id", "ascending"), ("start", "ascending")])
    ids, starts = found["id"].to_pylist(), found["start"].to_pylist()
    group: list[int] = []
    for i, x in enumerate(ids):
        group.append(group[-1] if i and ids[i - 1] == x else i)
    return Limits(ids, starts, group), buckets


def in_chunks(docs: DataFrame, limits: Limits) -> DataFrame:
    dealt = docs.withColumn(CHUNK, limits.chunk(_id(docs), _start(docs)).cast("int"))
    return dealt.repartition(max(1, len(limits.ids)), CHUNK)


def ordered(texts: pa.Table) -> pa.Table:
    """A chunk's rows by id, null ids last; equal ids by text, so that a repeated task sees the same order."""
    return texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def id_ranks(table: pa.Table) -> np.ndarray:
    """Equal for equal ids, and rising with them."""
    ids = table["doc_id"].combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)


def spread(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where in sorted keys each bucket begins, with the end."""
    limits = [(i << bits) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(limits, dtype=U)), [len(keys)])).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in four bytes each where they fit."""
    steps = np.diff(keys, prepend=U(0))
    if len(keys) and int(steps[1:].max(initial=0)) < 1 << 32:
        return b"4" + keys[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"8" + keys.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"8":
        return np.frombuffer(blob, U, offset=1)
    return np.concatenate((np.frombuffer(blob, U, 1, 1), np.frombuffer(blob, np.uint32, offset=9))).cumsum(dtype=U)


@dataclass
class Keys:
    """96-bit keys: 64 bits that are sorted and cut into buckets, and 32 that tell apart what shares them."""

    a: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def __len__(self) -> int:
        return len(self.a)

    def __getitem__(self, i: np.ndarray | slice) -> Keys:
        return Keys(self.a[i], self.b[i])

    def order(self) -> np.ndarray:
        order = np.argsort(self.a, kind="stable")
        a, b = self.a[order], self.b[order]
        clash = (a[1:] == a[:-1]) & (b[1:] != b[:-1])
        return np.lexsort((self.b, self.a)) if clash.any() else order

    def firsts(self) -> np.ndarray:
        """Which of sorted keys differ from the one before."""
        return np.concatenate(([True], (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1]))) if len(self) else np.zeros(0, bool)

    def distinct(self) -> tuple[Keys, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the order that sorts all, and where in that order each key begins."""
        order = self.order()
        found = self[order]
        first = np.flatnonzero(found.firsts())
        return found[first], order, first

    @staticmethod
    def joined(parts: list[Keys]) -> Keys:
        return Keys(np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts])) if parts else Keys()


def run_rows(chunk: int, keys: np.ndarray, bits: int, buckets: int, b: np.ndarray | None = None, c: np.ndarray | None = None, state: bytes = b"") -> pa.Table:
    """A chunk's sorted distinct keys (with columns b and c) cut by bucket; the state goes along and comes back."""
    at = spread(keys, bits, buckets)
    rows = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
    out = {
        BUCKET: [i for i, *_ in rows], "n": [int(hi - lo) for _, lo, hi in rows], "a": [pack(keys[lo:hi]) for _, lo, hi in rows],
        "b": [b[lo:hi].tobytes() if b is not None else None for _, lo, hi in rows], "c": [c[lo:hi].tobytes() if c is not None else None for _, lo, hi in rows],
    }
    if state:
        for k, v in ((BUCKET, chunk % buckets), ("n", -1), ("a", state), ("b", None), ("c", None)):
            out[k].append(v)
    return pa.table({BUCKET: pa.array(out[BUCKET], pa.int32()), CHUNK: pa.array([chunk] * len(out["n"]), pa.int32()), "n": pa.array(out["n"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in "abc"}})


class Levels:
    """A logarithmic family of sorted key sets: runs are added in order, equal-sized levels merge."""

    def __init__(self) -> None:
        self.levels: list[Keys] = []

    def holds(self, keys: Keys) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at, end = (np.searchsorted(level.a, keys.a, side=s) for s in ("left", "right"))
            for step in range(int((end - at).max(initial=0))):  # one, but for clashes
                here = np.minimum(at + step, len(level) - 1)
                found |= (at + step < end) & (level.b[here] == keys.b)
        return found

    def add(self, keys: Keys) -> None:
        if not len(keys):
            return
        self.levels.append(keys)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(Keys.joined([a, b]).distinct()[0])  # the stable sort merges the two runs


def _replies(rows: list[tuple[int, int, bytes | None, bytes | None]]) -> pa.Table:
    return pa.table({CHUNK: pa.array([r[0] for r in rows], pa.int32()), BUCKET: pa.array([r[1] for r in rows], pa.int32()), "a": pa.array([r[2] for r in rows], pa.binary()), "state": pa.array([r[3] for r in rows], pa.binary())})


def _runs_of(table: pa.Table) -> tuple[int, list[dict], list[tuple[int, int, bytes | None, bytes | None]]]:
    rows = sorted(table.to_pylist(), key=lambda r: (r[CHUNK], r["n"]))
    bucket = rows[0][BUCKET]
    return bucket, [r for r in rows if r["n"] >= 0], [(r[CHUNK], -1, None, r["a"]) for r in rows if r["n"] < 0]


def resolve_shared(table: pa.Table) -> pa.Table:
    """Round 1: for each entry, bit 0: the key occurs again anywhere; bit 1: with another stretch."""
    bucket, runs, echo = _runs_of(table)
    if not runs:
        return _replies(echo)
    keys = np.concatenate([unpack(r["a"]) for r in runs])
    stretch = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in runs])
    flags = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in runs])
    order = np.argsort(keys, kind="stable")
    keys, s, f = keys[order], stretch[order], flags[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    flag = np.bitwise_or.reduceat(f, first)
    shared = (count > 1) | (flag & 1).astype(bool)
    mixed = (np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first)) | (flag & 2).astype(bool)
    answer = np.empty(len(keys), np.uint8)
    answer[order] = np.repeat(shared.astype(np.uint8) | mixed.astype(np.uint8) << 1, count)
    at = np.cumsum([0] + [r["n"] for r in runs])
    return _replies([(r[CHUNK], bucket, answer[at[i] : at[i + 1]].tobytes(), None) for i, r in enumerate(runs)] + echo)


def resolve_earlier(table: pa.Table, group: list[int] | None = None) -> pa.Table:
    """Rounds 2 and 3: for each entry, whether an earlier chunk has the key; with ``group``, one of another group."""
    bucket, runs, out = _runs_of(table)
    index, waiting, current = Levels(), [], None
    for r in runs:
        keys = Keys(unpack(r["a"]), np.frombuffer(r["b"], np.uint32))
        mine = group[r[CHUNK]] if group else r[CHUNK]
        if mine != current:
            for k in waiting:
                index.add(k)
            waiting, current = [], mine
        out.append((r[CHUNK], bucket, np.packbits(index.holds(keys)).tobytes(), None))
        waiting.append(keys)
    return _replies(out)


def answers(replies: pa.Table, bits: bool, sizes: np.ndarray) -> np.ndarray:
    """A chunk's answers in the order of its sorted keys; sizes: of its run in each bucket."""
    got = {r[BUCKET]: r["a"] for r in replies.to_pylist() if r[BUCKET] >= 0}
    out = [np.frombuffer(got[i], np.uint8) for i in range(len(sizes)) if sizes[i]]
    if bits:
        out = [np.unpackbits(x, count=int(n)) for x, n in zip(out, sizes[sizes > 0], strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def state_of(replies: pa.Table) -> dict:
    return next((pickle.loads(r["state"]) for r in replies.to_pylist() if r["state"]), {})


@dataclass
class Anchors:
    """Arrays over a chunk. ``gram``: key of the anchor; ``short``: of the stretch, 32 bits; ``lo``, ``hi``: its first
    window and one behind the last, as numbers of windows; ``at``: where among them the anchor is; ``rank``: order of the
    anchor (only a smaller one is earlier)."""

    gram: np.ndarray
    short: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    rank: np.ndarray

    @staticmethod
    def joined(parts: list[Anchors]) -> Anchors:
        kinds = (U, np.uint32, np.int64, np.int64, np.int32, np.int32)
        return Anchors(*(np.concatenate([getattr(p, n).astype(k, copy=False) for p in parts]) if parts else np.zeros(0, k) for n, k in zip(Anchors.__dataclass_fields__, kinds, strict=True)))


class Texts(Protocol):
    """A chunk's texts: their anchors, and the keys and limits of windows by number."""

    def anchors(self) -> Anchors: ...

    def keys(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of what the windows read."""

    def begin(self, window: np.ndarray) -> np.ndarray: ...

    def end(self, window: np.ndarray) -> np.ndarray: ...


def short_of(first: np.ndarray, last: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits for consecutive windows that overlap: the first, the last, how many, and where among them the anchor is."""
    return (_stretch(first, last, n, at) >> U(32)).astype(np.uint32)


def _stretch(first: np.ndarray, last: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(first + last * U(0xA24BAED4963EE407) + n.astype(U) * U(0x9FB21C651E98DF25) + at.astype(U) * U(0xD6E8FEB86659FD93))


def window_keys(texts: Texts, i: np.ndarray) -> Keys:
    a, b = texts.keys(i)
    return Keys(mix(a), (mix(b) >> U(32)).astype(np.uint32))


def stretch_keys(texts: Texts, found: Anchors, i: np.ndarray) -> Keys:
    """Keys of the stretches of anchors i."""
    lo, hi, at = found.lo[i], found.hi[i], found.at[i]
    first, last = texts.keys(lo), texts.keys(hi - 1)
    return Keys(_stretch(first[0], last[0], hi - lo, at), (_stretch(first[1], last[1], hi - lo, at) >> U(32)).astype(np.uint32))


def _expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All indices lo <= i < hi of each pair, one after another."""
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(lo) else np.zeros(0, np.int64)


def _bits(found: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(found, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


class Plan:
    """What each round emits for a chunk, given the answers so far. ``read`` makes Texts of its ordered rows."""

    def __init__(self, read: Callable[[pa.Table], Texts], buckets: int):
        self.read, self.buckets = read, buckets

    def _earlier(self, keys: Keys, rank: np.ndarray, replies: pa.Table) -> np.ndarray:
        """Which keys stand in an earlier chunk, or in this one at a smaller rank."""
        unique, order, first = keys.distinct()
        if not len(unique):
            return np.zeros(0, bool)
        before = answers(replies, True, np.diff(spread(unique.a, 64, self.buckets))).astype(bool)
        low, count = np.minimum.reduceat(rank[order], first), np.diff(np.append(first, len(keys)))
        out = np.empty(len(keys), bool)
        out[order] = np.repeat(before, count) | (rank[order] > np.repeat(low, count))
        return out

    def _run(self, chunk: int, keys: Keys, state: dict) -> pa.Table:
        unique = keys.distinct()[0]
        return run_rows(chunk, unique.a, 64, self.buckets, unique.b, state=pickle.dumps(state))

    def first(self, texts: pa.Table) -> pa.Table:
        texts = ordered(texts)
        found = self.read(texts).anchors()
        gram = found.gram >> U(64 - GRAM_BITS)
        order = np.argsort(gram, kind="stable")
        gram, short, rank = gram[order], found.short[order], found.rank[order]
        at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        if not len(at):
            return run_rows(_chunk(texts), gram, GRAM_BITS, self.buckets, short, np.zeros(0, np.uint8))
        least, most = np.minimum.reduceat(short, at), np.maximum.reduceat(short, at)
        flags = (np.minimum.reduceat(rank, at) != np.maximum.reduceat(rank, at)).astype(np.uint8) | (least != most).astype(np.uint8) << 1
        return run_rows(_chunk(texts), gram[at], GRAM_BITS, self.buckets, least, flags)

    def second(self, texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return run_rows(0, np.zeros(0, U), 64, self.buckets)
        texts = ordered(texts)
        read = self.read(texts)
        found = read.anchors()
        keys, inverse = np.unique(found.gram >> U(64 - GRAM_BITS), return_inverse=True)
        flags = answers(replies, False, np.diff(spread(keys, GRAM_BITS, self.buckets)))[inverse] if len(keys) else np.zeros(0, np.uint8)
        shared = np.flatnonzero(flags & 1)
        state = {"n": len(flags), "shared": np.packbits(flags & 1).tobytes(), "mixed": np.packbits(flags[shared] >> 1).tobytes()}
        return self._run(_chunk(texts), stretch_keys(read, found, shared), state)

    def third(self, texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return run_rows(0, np.zeros(0, U), 64, self.buckets)
        texts, state = ordered(texts), state_of(replies)
        read = self.read(texts)
        found = read.anchors()
        shared = np.flatnonzero(_bits(state["shared"], state["n"]))
        whole = self._earlier(stretch_keys(read, found, shared), found.rank[shared], replies)
        single = shared[_bits(state["mixed"], len(shared)) & ~whole]
        state["whole"] = np.packbits(whole).tobytes()
        return self._run(_chunk(texts), window_keys(read, _expand(found.lo[single], found.hi[single])), state)

    def covered(self, texts: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each stretch of bytes (of the ordered chunk) whose windows stand earlier."""
        state, read = state_of(replies), self.read(texts)
        found = read.anchors()
        shared = np.flatnonzero(_bits(state["shared"], state["n"]))
        whole = _bits(state["whole"], len(shared))
        single = shared[_bits(state["mixed"], len(shared)) & ~whole]
        window = _expand(found.lo[single], found.hi[single])
        hit = window[self._earlier(window_keys(read, window), np.repeat(found.rank[single], (found.hi - found.lo)[single]), replies)]
        whole = shared[whole]
        return np.concatenate((read.begin(found.lo[whole]), read.begin(hit))), np.concatenate((read.end(found.hi[whole] - 1), read.end(hit)))


def _chunk(texts: pa.Table) -> int:
    return texts[CHUNK][0].as_py()


def runs_of(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of covered bytes, which end where a text does; ``at``: where texts begin."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(at, begin, side="right")
    new = np.flatnonzero((begin[1:] > end[:-1]) | (text[1:] != text[:-1])) + 1
    return begin[np.concatenate(([0], new))], end[np.append(new, len(end)) - 1]


def find_repeats(docs: DataFrame, read: Callable[[pa.Table], Texts], finish: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str | T.StructType, chunk_bytes: int, apart: bool = False) -> DataFrame:
    """``finish`` gets each chunk's ordered rows and the covered stretches (begin, end in the chunk's bytes). ``apart``:
    texts of one id don't count against each other (ranks have to be equal for them as well)."""
    limits, buckets = limits_of(docs, chunk_bytes)
    dealt, group = in_chunks(docs, limits), limits.group if apart and len(set(limits.group)) < len(limits.group) else None
    plan = Plan(read, buckets)
    first, covered = trim(plan.first), plan.covered
    empty = pa.schema([(f.name, pa.int64()) for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields])

    def last(texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = ordered(texts)
        return finish(texts, *covered(texts, replies)) if texts.num_rows else empty.empty_table()

    shared, earlier = trim(resolve_shared), trim(resolve_earlier)
    replies = dealt.groupBy(CHUNK).applyInArrow(lambda t: first(t), RUNS).groupBy(BUCKET).applyInArrow(lambda t: shared(t), REPLIES)
    for emit in (trim(plan.second), trim(plan.third)):
        runs = dealt.groupBy(CHUNK).cogroup(replies.groupBy(CHUNK)).applyInArrow((lambda f: lambda t, r: f(t, r))(emit), RUNS)
        replies = runs.groupBy(BUCKET).applyInArrow(lambda t: earlier(t, group), REPLIES)
    done = trim(last)
    return dealt.groupBy(CHUNK).cogroup(replies.groupBy(CHUNK)).applyInArrow(lambda t, r: done(t, r), schema)
