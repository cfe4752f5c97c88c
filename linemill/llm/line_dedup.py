"""Line deduplication: winnowing over line hashes; later repeated runs of lines are deleted.

In each window of ``RUN_LINES`` lines the least line hash is its fingerprint, so that runs of that length are sure to
share one. Fingerprints that occur again are joined by their hash, their windows are compared, which extends a
match line by line in both directions, and every window that stands earlier in the corpus is deleted: see
``_repeats``. A line of ``LONG_WORDS`` words or more is a run of its own.

Order is by doc_id (null last), then text, then position; the first occurrence stays. A window may stand earlier in the
same document. Whether it does is judged on the input, not on what is left.

Defined results: lines end at a line feed; blank lines are neither compared nor deleted; what remains is joined by
line feeds as before. A null text stays null and has no lines. Repeated rows lose all runs but those of the first.
All columns are kept, ``n_chars`` is counted anew if there is one; where the table has columns of the names of the counts,
these get an underscore more. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import free_name, hex_sha256, plain, renamed
from linemill.llm._repeats import Anchors, find_repeats, runs_of, short_of
from linemill.llm._tokens import NOT_NEWLINE, U, Words, flat, grams, mix, window_minimum

RUN_LINES, LONG_WORDS = 2, 50
_LONG = U(0x5851F42D4C957F2D)


class Lines:
    """A chunk's lines. A window is ``run_lines`` lines, its number that of the first; long lines by themselves follow."""

    def __init__(self, texts: pa.Table, run_lines: int, long_words: int):
        self.data, self.at = flat(texts["text"])
        self.lines, self.run = Words(self.data, self.at, NOT_NEWLINE, lower=False), run_lines
        spaces = np.flatnonzero(self.data == 0x20)
        words = np.searchsorted(spaces, self.lines.end) - np.searchsorted(spaces, self.lines.start) + 1
        self.long = np.flatnonzero(words >= long_words)
        self.n = max(0, len(self.lines) - run_lines + 1)

    def _line(self, window: np.ndarray, step: int) -> np.ndarray:
        """The number of the first line (or of that ``step`` lines on) of windows."""
        single = np.append(self.long, 0)[np.maximum(window - self.n, 0)] if len(self.long) else window
        return np.where(window < self.n, window + step, single)

    def begin(self, window: np.ndarray) -> np.ndarray:
        return self.lines.start[self._line(window, 0)]

    def end(self, window: np.ndarray) -> np.ndarray:
        return self.lines.end[self._line(window, self.run - 1)]

    def keys(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From digests of the lines themselves; only lines that are asked for are read."""
        steps = [self._line(window, j) for j in range(self.run)]
        asked = np.unique(np.concatenate(steps)) if len(window) else np.zeros(0, np.int64)
        view, found = memoryview(self.data), bytearray()
        for lo, hi in zip(self.lines.start[asked].tolist(), self.lines.end[asked].tolist(), strict=True):
            found += hashlib.blake2b(view[lo:hi], digest_size=16).digest()
        digest = np.frombuffer(bytes(found), "<u8").reshape(-1, 2)
        out = []
        for lane in (0, 1):
            total = np.where(window < self.n, U(0), _LONG)
            for line in steps:
                total = mix(total + digest[np.searchsorted(asked, line), lane])
            out.append(total)
        return out[0], out[1]

    def anchors(self) -> Anchors:
        lines, n, k = self.lines, self.n, self.run
        text = lines.text_of()
        window = grams(lines.hash, k)
        chosen = window_minimum(lines.hash, k).astype(np.int64)
        inside = text[:n] == text[k - 1 :] if n else np.zeros(0, bool)
        change = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])))) if n else np.zeros(0, np.int64)
        until = np.append(change[1:], n)[: len(change)]
        change, until = change[inside[change]], until[inside[change]]
        anchor = chosen[change]
        runs = Anchors(mix(lines.hash[anchor]), short_of(window[change], window[until - 1], until - change, anchor - change), change, until, anchor - change, change)
        single, extra = mix(lines.hash[self.long] ^ _LONG), np.arange(n, n + len(self.long))
        return Anchors.joined([runs, Anchors(single, (single >> U(32)).astype(np.uint32), extra, extra + 1, np.zeros(len(extra), np.int64), self.long)])


def _finish(texts: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    data, at = flat(texts["text"])
    lines = Words(data, at, NOT_NEWLINE, lower=False)
    begin, end = runs_of(at, begin, end)
    run = np.searchsorted(begin, lines.start, side="right") - 1
    gone = (run >= 0) & (lines.start < end[run]) if len(begin) else np.zeros(len(lines), bool)
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[lines.of_text])
    kept = texts["text"].to_pylist()
    for i in np.flatnonzero(removed).tolist():
        flags = iter(gone[lines.of_text[i] : lines.of_text[i + 1]].tolist())
        kept[i] = "\n".join(x for x in kept[i].split("\n") if not x or not next(flags))
    done = texts.set_column(texts.column_names.index("text"), "text", pa.array(kept, pa.string()))
    return done.append_column("_lm_lines", pa.array(np.diff(lines.of_text), pa.int64())).append_column("_lm_removed", pa.array(removed, pa.int64()))


def dedup_lines(docs: DataFrame, chunk_bytes: int = 8 << 20, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """The rows of docs without later repeated runs, with ``_lm_lines`` and ``_lm_removed`` (counts of lines)."""
    rows, kept = plain(docs, "doc_id", "text", "n_chars")
    schema = T.StructType([*rows.schema.fields, T.StructField("_lm_lines", T.LongType()), T.StructField("_lm_removed", T.LongType())])

    def finish(texts: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.Table:
        return _finish(texts, begin, end).select([*kept, "_lm_lines", "_lm_removed"])

    done = find_repeats(rows, lambda t: Lines(t, run_lines, long_words), finish, schema, chunk_bytes)
    if "n_chars" in kept:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done.select(*renamed(done, kept, docs.columns), F.col("_lm_lines").alias(free_name(docs, "_lm_lines")), F.col("_lm_removed").alias(free_name(docs, "_lm_removed")))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs without later repeated runs; those of which nothing else was left go."""
    done, removed = dedup_lines(docs), free_name(docs, "_lm_removed")
    return done.where((F.col(removed) == 0) | (F.trim("text") != "")).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_lm_lines").alias("n_lines"), F.col("_lm_removed").alias("n_removed"), hex_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))
