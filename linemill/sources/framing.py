"""Bytes of a block: templates, ids and columns laid out for a codec, and back. Plain Python and NumPy, no Spark.

A block is header (crc32, three lengths, flag) and up to three streams; an indexed archive is a row of solid blocks,
an index of 29 bytes each, and a footer.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from linemill.functions.tokens import PLACEHOLDER, SEPARATOR
from linemill.sources.codecs import Codec

#: Layouts of header, index entry and footer (little-endian), and the flags. The index is this project's own:
#: an entry has a checksum, and the magic differs.
HEADER, ENTRY, FOOTER = struct.Struct("<IIIIB"), struct.Struct("<QQQBI"), struct.Struct("<Q5s")
MAGIC = b"LMIX\x01"
RAW, LATIN, LOW = 255, 0x80, 0x7F
NO_IDS, ONE_BYTE, TWO_BYTES, FOUR_BYTES = 3, 2, 0, 1
_WIDTH = {ONE_BYTE: "<u1", TWO_BYTES: "<u2", FOUR_BYTES: "<u4"}
#: Fixed value: a sample that shrinks less than this is stored split.
SPLIT_BELOW, SPLIT_TEMPLATES = 3.0, 256
_LIMIT = (1 << 32) - 1

VALUE_END, STUFF, COLUMN_END = b"\x00", b"\x01", b"\x02"


class Corrupt(ValueError):
    """A stored block that can't be read, or whose text doesn't match its checksum."""


@dataclass(frozen=True)
class Stored:
    crc32: int
    c_reg: bytes
    c_ids: bytes
    c_vars: bytes
    flag: int

    @property
    def solid(self) -> bool:
        return not self.c_reg and not self.c_ids

    def to_bytes(self) -> bytes:
        sizes = [len(self.c_reg), len(self.c_ids), len(self.c_vars)]
        if max(sizes) > _LIMIT:
            raise ValueError("a stream of 4 GiB or more: use smaller blocks")
        return HEADER.pack(self.crc32, *sizes, self.flag) + self.c_reg + self.c_ids + self.c_vars


@dataclass(frozen=True)
class Parsed:
    """A block's templates by id, its lines' ids, and for each template its columns of values."""

    skeletons: list[str]
    ids: np.ndarray
    columns: list[list[list[str] | pa.Array]]
    latin: bool = False


def flag_of(n_templates: int) -> int:
    if n_templates == 1:
        return NO_IDS
    return ONE_BYTE if n_templates < 256 else FOUR_BYTES if n_templates > 65_535 else TWO_BYTES


def by_frequency(p: Parsed) -> Parsed:
    """Ids renumbered so that the most frequent come first; ties keep their order."""
    count = np.bincount(p.ids, minlength=len(p.skeletons))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Parsed([p.skeletons[i] for i in order], rank[p.ids], [p.columns[i] for i in order], p.latin)


def stuffed(value: bytes) -> bytes:
    return value.replace(STUFF, b"\x01\x01").replace(VALUE_END, b"\x01\x00").replace(COLUMN_END, b"\x01\x03")


_STUFFED = re.compile(rb"\x01(.)", re.S)
_PLAIN = {b"\x01": b"\x01", b"\x00": b"\x00", b"\x03": b"\x02"}


def unstuffed(value: bytes) -> bytes:
    return _STUFFED.sub(lambda m: _PLAIN.get(m[1], m[1]), value) if STUFF in value else value


def streams(p: Parsed) -> tuple[bytes, bytes, bytes]:
    flag = flag_of(len(p.skeletons))
    registry = SEPARATOR.join(p.skeletons).encode()
    ids = b"" if flag == NO_IDS else p.ids.astype(_WIDTH[flag]).tobytes()
    out = []
    for template in p.columns:
        for column in template:
            out.append(_joined(column) + COLUMN_END)
    return registry, ids, b"".join(out)


def _joined(column: list[str] | pa.Array) -> bytes:
    """A column's values, stuffed where that is needed, with an end byte between them."""
    if isinstance(column, list):
        return VALUE_END.join(stuffed(v.encode()) for v in column)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    if (raw <= 2).any():
        return VALUE_END.join(stuffed(v) for v in column.to_pylist())
    return np.insert(raw, at[1:-1] - at[0], VALUE_END[0]).tobytes()


def sample_of(p: Parsed, templates: int = 5, values: int = 50, stop: int = 2000) -> bytes:
    out: list[str] = []
    for columns in p.columns[:templates]:
        for column in columns:
            out += column[:values] if isinstance(column, list) else column[:values].to_pylist()
        if len(out) > stop:
            break
    return "".join(out).encode()


def layout_of(p: Parsed, codec: Codec) -> str:
    sample = sample_of(p) if len(p.skeletons) < SPLIT_TEMPLATES else b""
    return "split" if sample and len(sample) / len(codec.compress(sample)) < SPLIT_BELOW else "unified"


def stored(payload: bytes, p: Parsed | None, codec: Codec, layout: str | None = None) -> Stored:
    """A block's bytes; without a parse the payload itself, compressed."""
    crc = zlib.crc32(payload)
    if p is None:
        return Stored(crc, b"", b"", codec.compress(payload), RAW)
    if (layout or layout_of(p, codec)) == "split":
        registry, ids, values = streams(p)
        flag = flag_of(len(p.skeletons)) | (LATIN if p.latin else 0)
        return Stored(crc, codec.compress(registry), codec.compress(ids), codec.compress(values), flag)
    p = by_frequency(p)
    flag = flag_of(len(p.skeletons))
    return Stored(crc, b"", b"", codec.compress(_solid(p)), flag | (LATIN if p.latin else 0))


def _solid(p: Parsed) -> bytes:
    registry, ids, values = streams(p)
    n = len(ids)
    if flag_of(len(p.skeletons)) == NO_IDS:
        n = 0 if p.columns[0] else len(p.ids)  # without variables only this tells how many lines there are
    return struct.pack("<II", len(registry), n) + registry + ids + values


def _columns(data: bytes) -> list[list[bytes]]:
    """The values of each column; escapes decide which end bytes count."""
    raw = np.frombuffer(data, np.uint8)
    plain = np.ones(len(raw), bool)
    stuff = np.flatnonzero(raw == 1)
    skip = -1
    for i in stuff.tolist():  # an escape consumes the byte behind it
        if i > skip:
            skip = i + 1
            if skip < len(plain):
                plain[skip] = False
    ends = np.flatnonzero(plain & (raw == 2))
    out, begin = [], 0
    cuts = np.flatnonzero(plain & (raw == 0))
    for end in ends.tolist():
        at = cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, end)].tolist()
        out.append([unstuffed(data[a:b]) for a, b in zip([begin, *(c + 1 for c in at)], [*at, end], strict=True)])
        begin = end + 1
    if begin != len(data):
        raise Corrupt("the last column has no end")
    return out


def restored_lines(registry: bytes, ids: bytes, n_rows: int, values: bytes, flag: int) -> list[bytes]:
    skeletons = registry.decode().split(SEPARATOR) if registry or n_rows or ids or values else []
    arity = [s.count(PLACEHOLDER) for s in skeletons]
    columns = _columns(values)
    if sum(arity) != len(columns):
        raise Corrupt("templates and columns don't fit")
    if flag & LOW == NO_IDS:
        order = np.zeros(len(columns[0]) if columns else n_rows, np.int64)
    else:
        order = np.frombuffer(ids, _WIDTH[flag & LOW]).astype(np.int64)
    if len(order) and order.max() >= len(skeletons):
        raise Corrupt("an id without template")
    code = "latin-1" if flag & LATIN else "utf-8"
    rows, at = [], 0
    for s, n in zip(skeletons, arity, strict=True):
        pieces = [x.encode() for x in s.split(PLACEHOLDER)]
        rows.append((pieces, iter(zip(*columns[at : at + n], strict=True)) if n else None))
        at += n
    out = []
    try:
        for i in order.tolist():
            pieces, values_ = rows[i]
            line = b"".join(x for pair in zip(pieces, (*next(values_), b""), strict=True) for x in pair) if values_ else pieces[0]
            out.append(line.decode().encode(code) if code == "latin-1" else line)
    except StopIteration:
        raise Corrupt("a column has too few values") from None
    return out


def opened(block: Stored, codec: Codec) -> list[bytes]:
    """The lines of a stored block, checked against its checksum before anything is given out."""
    try:
        if block.flag == RAW:
            lines = lines_of(codec.decompress(block.c_vars))
        elif block.solid:
            data = codec.decompress(block.c_vars)
            lines = _opened_solid(data, block.flag)
        else:
            lines = restored_lines(codec.decompress(block.c_reg), codec.decompress(block.c_ids), 0, codec.decompress(block.c_vars), block.flag)
    except Corrupt:
        raise
    except Exception as e:
        raise Corrupt(str(e)) from e
    if zlib.crc32(b"".join(lines)) != block.crc32:
        raise Corrupt("checksum")
    return lines


def _opened_solid(data: bytes, flag: int) -> list[bytes]:
    if len(data) < 8:
        raise Corrupt("a block of under 8 bytes")
    n_reg, n_ids = struct.unpack_from("<II", data)
    stored_ids = 0 if flag & LOW == NO_IDS else n_ids
    if 8 + n_reg + stored_ids > len(data):
        raise Corrupt("lengths exceed the block")
    return restored_lines(data[8 : 8 + n_reg], data[8 + n_reg : 8 + n_reg + stored_ids], n_ids, data[8 + n_reg + stored_ids :], flag)


# Indexed archives: each group is flag and solid streams, compressed as one; its checksum stands in the index.


def group_bytes(p: Parsed, codec: Codec) -> bytes:
    p = by_frequency(p) if layout_of(p, codec) == "unified" else p
    return codec.compress(bytes([flag_of(len(p.skeletons)) | (LATIN if p.latin else 0)]) + _solid(p))


def lines_of(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def opened_group(data: bytes, codec: Codec, crc32: int, raw: bool = False) -> list[bytes]:
    """The lines of a group, checked against its checksum before anything is given out."""
    try:
        plain = codec.decompress(data)
    except Exception as e:
        raise Corrupt(str(e)) from e
    if raw:
        lines = lines_of(plain)
    elif len(plain) < 9:
        raise Corrupt("a block of under 9 bytes")
    else:
        lines = _opened_solid(plain[1:], plain[0])
    if zlib.crc32(b"".join(lines)) != crc32:
        raise Corrupt("checksum")
    return lines


def index_bytes(entries: list[tuple[int, int, int, int, int]], at: int) -> bytes:
    """entries: (offset, size, rows, kind, crc32) of each group; at: where the index begins."""
    return struct.pack("<I", len(entries)) + b"".join(ENTRY.pack(*e) for e in entries) + FOOTER.pack(at, MAGIC)


def read_index(tail_of) -> list[tuple[int, int, int, int, int]]:
    """``tail_of(offset, size)`` reads bytes; a negative offset counts from the end."""
    at, magic = FOOTER.unpack(tail_of(-FOOTER.size, FOOTER.size))
    if magic != MAGIC:
        raise Corrupt("no index at the end")
    (n,) = struct.unpack("<I", tail_of(at, 4))
    raw = tail_of(at + 4, n * ENTRY.size)
    return [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(n)]
