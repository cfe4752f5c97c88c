"""Back-end codecs by name: the one point of extension. Register a pair of functions from bytes to bytes."""

from __future__ import annotations

import base64
import bz2
import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

#: Fixed value: the dictionary of the default codec, unless the block is smaller.
DICTIONARY = 128 << 20


@dataclass(frozen=True)
class Codec:
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]


def _xz(dictionary: int = DICTIONARY, preset: int = 9) -> Codec:
    def compress(data: bytes) -> bytes:
        # A dictionary beyond the data costs memory and gains nothing.
        size = max(4096, min(dictionary, 1 << max(12, len(data).bit_length())))
        filters = [{"id": lzma.FILTER_LZMA2, "preset": preset | lzma.PRESET_EXTREME, "dict_size": size}]
        return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC32, filters=filters)

    return Codec(compress, lzma.decompress)


CODECS: dict[str, Codec] = {
    "xz": _xz(),
    "xz-fast": _xz(preset=1),
    "zlib": Codec(lambda b: zlib.compress(b, 9), zlib.decompress),
    "bz2": Codec(bz2.compress, bz2.decompress),
    "none": Codec(bytes, bytes),
}

try:
    import zstandard
except ImportError:
    pass
else:
    CODECS["zstd"] = Codec(lambda b: zstandard.ZstdCompressor(level=22).compress(b), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b))

try:
    import brotli
except ImportError:
    pass
else:
    CODECS["brotli"] = Codec(lambda b: brotli.compress(b, quality=11, lgwin=22), brotli.decompress)


def register(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes]) -> None:
    CODECS[name] = Codec(compress, decompress)


def xz(dictionary: int) -> Codec:
    return _xz(dictionary)


def codec(name: str | Codec) -> Codec:
    """By name ('auto' is the default codec), or as ``portable`` spelt it. Names that nobody registered raise."""
    if isinstance(name, Codec):
        return name
    if name.startswith("codec:"):
        from pyspark import cloudpickle

        return cloudpickle.loads(base64.b64decode(name[6:]))
    if name != "auto" and name not in CODECS:
        raise ValueError(f"no codec {name!r}: register it, or take one of {', '.join(sorted(CODECS))}")
    return CODECS["xz" if name == "auto" else name]


BUILT_IN = frozenset(CODECS)


def portable(name: str | Codec) -> str:
    """A codec as text that every worker understands: its name if it is built in, else its functions."""
    if isinstance(name, str) and (name in BUILT_IN or name == "auto"):
        return name
    from pyspark import cloudpickle

    return "codec:" + base64.b64encode(cloudpickle.dumps(codec(name))).decode()
