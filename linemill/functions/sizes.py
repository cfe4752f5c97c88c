"""Sizes as people write them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def parse_size(text: str) -> int:
    """'64MB' and the like in bytes; whole numbers, units of 1024; anything else raises ValueError."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in _UNITS:
        raise ValueError(f"no size: {text!r}")
    return int(found[1]) * _UNITS[found[2].upper()]


def format_size(n: int) -> str:
    return f"{n:,} bytes"


def size_text(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" bytes"))


def ratio(size_in: Column, size_out: Column) -> Column:
    return F.when(size_out > 0, size_in / size_out).otherwise(F.lit(0.0))
