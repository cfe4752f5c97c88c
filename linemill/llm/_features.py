"""Features of whole texts for the classifiers, and small models fitted on bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.llm._tokens import BLOCK, NOT_NEWLINE, NOT_SPACE, U, Words, byte_class, flat, mix

_CLASSES = {
    "upper": byte_class((65, 90)), "lower": byte_class((97, 122)), "digit": byte_class((48, 57)), "space": byte_class((32, 32)), "newline": byte_class((10, 10)),
    "stop": byte_class((46, 46)), "comma": byte_class((44, 44)), "shout": byte_class((33, 33), (63, 63)), "bar": byte_class((124, 124)),
    "symbol": byte_class((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (126, 126)), "bracket": byte_class((40, 41), (91, 91), (93, 93), (123, 123), (125, 125)),
    "quote": byte_class((34, 34), (39, 39)), "high": byte_class((128, 255)), "control": byte_class((0, 8), (14, 31), (127, 127)),
}
SHARES = (*_CLASSES, "same as last word", "same as word before last", "repeated words", "repeated lines", "long words", "short words", "words ending in a symbol")
NAMES = (*SHARES, *(f"root of {x}" for x in SHARES), "length", "line length")


_MEMBERS = np.stack(list(_CLASSES.values()), axis=1).astype(np.float64)


def _histograms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each byte value occurs in each text."""
    out = np.zeros((len(at) - 1, 256))
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for k in range(lo, hi, BLOCK):
            out[i] += np.bincount(data[k : min(hi, k + BLOCK)], minlength=256)
    return out


def dense(column: pa.ChunkedArray | pa.Array, words: Words | None = None) -> np.ndarray:
    """One row of NAMES for each text: shares of bytes and words, their roots, and logarithms of lengths. Empty: zeros.

    ``words``: the texts' words by NOT_SPACE, if they are at hand.
    """
    data, at = flat(column)
    n = np.maximum(1, np.diff(at))

    def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[begin[1:]] - sums[begin[:-1]]

    shares = list((_histograms(data, at) @ _MEMBERS / n[:, None]).T)
    words, lines = words or Words(data, at, NOT_SPACE), Words(data, at, NOT_NEWLINE)
    count = np.maximum(1, np.diff(words.of_text))
    text = words.text_of()
    for back in (1, 2):
        equal = np.zeros(len(words), bool)
        equal[back:] = (words.hash[back:] == words.hash[:-back]) & (text[back:] == text[:-back])
        shares.append(per_text(equal, words.of_text) / count)
    for items in (words, lines):
        owner = items.text_of()
        key = np.sort((mix(items.hash + owner.astype(U) * U(0x9E3779B97F4A7C15)) >> U(20)) | owner.astype(U) << U(44))
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        shares.append(per_text(again, items.of_text) / np.maximum(1, np.diff(items.of_text)))
    length = words.end - words.start
    shares += [per_text(length > 14, words.of_text) / count, per_text(length < 3, words.of_text) / count]
    shares.append(per_text((_CLASSES["symbol"] | _CLASSES["shout"])[data[words.end - 1]] if len(words) else np.zeros(0, bool), words.of_text) / count)
    s = np.stack(shares, axis=1) if len(at) > 1 else np.zeros((0, len(SHARES)))
    rest = np.stack([np.log1p(np.diff(at)), np.log1p(n / np.maximum(1, np.diff(lines.of_text)))], axis=1) if len(at) > 1 else np.zeros((0, 2))
    return np.concatenate((s, np.sqrt(s), rest), axis=1).astype(np.float32)


def fold(ids: Column) -> Column:
    """crc32 of an id as text, modulo 4; null ids count as the empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 4


HELD_OUT = 2


def bounded(df: DataFrame, most: int, salt: int, *keys: str) -> DataFrame:
    """``most`` rows with the least hashes of their keys: the same sample on every run, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(salt), *keys), *keys).limit(most)


class Scale:
    """Standardises by a sample's mean and deviation, and bounds what lies far outside."""

    def __init__(self, x: np.ndarray):
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.concatenate((z, np.ones((len(x), 1), z.dtype)), axis=1)


class Adam:
    def __init__(self, shape: tuple[int, ...] | int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
