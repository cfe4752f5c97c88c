"""Exact substring deduplication: remove each byte covered by a 50-byte string that starts in an earlier document too.

A logarithmic index family of sorted runs answers which strings stand earlier: see ``_repeats``. The runs hold the
suffixes at sampled positions only (each 50-byte window elects the least hash among the 24-byte grams inside it),
ordered by 96-bit keys of the strings in place of the strings: a full suffix array takes eight bytes for each byte
of text, and the sample loses nothing, as equal windows elect equal positions.

Defined results: texts count as UTF-8 bytes, null as empty; a null id is larger than every id; documents of one id
don't count against each other, so repeated rows keep each other; matches never cross documents; kept bytes may
end inside a character. Extra columns are ignored, an empty table gives an empty table. A task holds a chunk, or the
longest text: about six times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import text_or_empty
from linemill.llm._repeats import Anchors, find_repeats, id_ranks, runs_of, short_of
from linemill.llm._tokens import BYTE_VALUES, U, flat, mix, window_minimum

LENGTH, GRAM = 50, 24
#: Window starts that are hashed at once.
SPAN = 1 << 17
_A = 0x9E3779B97F4A7C15 | 1
#: One odd factor for each eight bytes of a window.
_FACTORS = mix(np.arange(1, LENGTH // 8 + 2, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def _up(n: int) -> np.uint64:
    return U(pow(_A, n, 1 << 64))


class Bytes:
    """A chunk's bytes; a window is LENGTH bytes, its number where it begins."""

    def __init__(self, texts: pa.Table):
        self.data, self.at = flat(texts["text"])
        self.ranks = id_ranks(texts)

    def begin(self, window: np.ndarray) -> np.ndarray:
        return window

    def end(self, window: np.ndarray) -> np.ndarray:
        return window + LENGTH

    def keys(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over a window's words of eight bytes, each mixed by itself: windows that differ in one word never agree."""
        out = np.zeros(len(window), U), np.zeros(len(window), U)
        if not len(window):
            return out
        views = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)
        for lo in range(0, len(window), SPAN):
            part = np.zeros((min(SPAN, len(window) - lo), len(_FACTORS) * 8), np.uint8)
            part[:, :LENGTH] = views[window[lo : lo + SPAN]]
            for j, factor in enumerate(_FACTORS):
                word = mix(part.view("<u8")[:, j] + factor)
                out[0][lo : lo + SPAN] += word
                out[1][lo : lo + SPAN] += word * factor
        return out

    def anchors(self) -> Anchors:
        """Found in blocks of SPAN window starts, which cut stretches: that only asks the third round more."""
        data, at, parts = self.data, self.at, []
        fits = len(data) - LENGTH + 1
        for lo in range(0, max(0, fits), SPAN):
            hi = min(lo + SPAN, fits)
            h = {1: BYTE_VALUES[data[lo : hi + LENGTH - 1]]}
            for k in (2, 4, 8, 16, 32):  # hash(xy) = hash(x) A^|y| + hash(y)
                half = h[k // 2]
                h[k] = half[: -(k // 2)] * _up(k // 2)
                h[k] += half[k // 2 :]
            n = hi - lo
            gram = h[16][: n + LENGTH - GRAM] * _up(8)
            gram += h[8][16 : 16 + n + LENGTH - GRAM]
            chosen = window_minimum((gram >> U(32)).astype(np.uint32), LENGTH - GRAM + 1).astype(np.int64)
            start = np.arange(lo, hi)
            first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi - 1, side="right") - 1
            sizes = np.diff(np.clip(at[first : last + 2], lo, hi))
            text = np.repeat(np.arange(first, last + 1), sizes)
            inside = start + LENGTH <= np.repeat(at[first + 1 : last + 2], sizes)
            # A run of windows with one anchor, in one document.
            change = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1]))))
            until = np.append(change[1:], n)
            good = inside[change]
            change, until = change[good], until[good]
            anchor = chosen[change]
            whole = lambda i: mix((h[32][i] * _up(16) + h[16][i + 32]) * _up(2) + h[2][i + 48])  # noqa: B023, E731
            short = short_of(whole(change), whole(until - 1), until - change, anchor - change)
            parts.append(Anchors(mix(gram[anchor]), short, change + lo, until + lo, anchor - change, self.ranks[text[change]]))
        return Anchors.joined(parts)


def _finish(texts: pa.Table, begin: np.ndarray, end: np.ndarray, with_kept: bool) -> pa.Table:
    data, at = flat(texts["text"])
    begin, end = runs_of(at, begin, end)
    of_text = np.searchsorted(begin, at)
    removed = np.concatenate(([0], np.cumsum(end - begin)))[of_text]
    begin, end, view, kept, digests = begin.tolist(), end.tolist(), memoryview(data), [], []
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        pieces = []
        for j in range(of_text[i], of_text[i + 1]):
            pieces.append(view[lo : begin[j]])
            lo = end[j]
        pieces.append(view[lo:hi])
        digest = hashlib.sha256()
        for p in pieces:
            digest.update(p)
        digests.append(digest.hexdigest())
        if with_kept:
            kept.append(b"".join(pieces))
    out = pa.table({"doc_id": texts["doc_id"], "n_bytes": np.diff(at), "n_removed": np.diff(removed), "n_spans": np.diff(of_text), "kept_sha256": digests})
    return out.append_column("kept", pa.array(kept, pa.binary())) if with_kept else out


def remove_repeated_strings(docs: DataFrame, chunk_bytes: int = 8 << 20, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return find_repeats(rows, Bytes, lambda *a: _finish(*a, with_kept), schema + ", kept binary" if with_kept else schema, chunk_bytes, apart=True)
