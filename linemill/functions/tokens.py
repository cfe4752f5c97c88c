"""The tokeniser as Column functions: what of a line is constant, what varies, and how the two join again.

All patterns repeat possessively, so that a quoted value of any length neither backtracks nor recurses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a variable in a template, and what parts the templates of a registry.
PLACEHOLDER, SEPARATOR = "\ue000", "\ue001"
#: A quoted string; then the tokens of each mode, in the order in which they are tried.
QUOTED = r'"(?:[^"\\]++|""|\\.)*+"'
TOKENS = {"strict": r"0x[0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]+)?", "aggressive": r"[a-zA-Z0-9_.:\-]+"}
#: Fixed value: so many characters of a line are read to choose the mode.
ANALYSIS_CHARS = 16_384
#: Fixed value: so many bytes of a block are looked at to tell whether it is binary.
BINARY_BYTES = 4096


def _pattern(mode: str) -> str:
    return f"(?s){QUOTED}|{TOKENS[mode]}"


def skeleton(line: Column, mode: str = "strict") -> Column:
    """The line with a placeholder for each variable; the quotes around a quoted one stay."""
    kept = QUOTED.replace('"(?:', '(")(?:', 1).removesuffix('"') + '(")'
    return F.regexp_replace(line, f"(?s){kept}|{TOKENS[mode]}", f"$1{PLACEHOLDER}$2")


def variables(line: Column, mode: str = "strict") -> Column:
    """The line's variables in order, without quotes around them."""
    found = F.regexp_extract_all(line, F.lit(_pattern(mode)), F.lit(0))
    return F.transform(found, lambda v: F.when(F.startswith(v, F.lit('"')), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def by_mode(line: Column, mode: Column, function) -> Column:
    """``skeleton`` or ``variables`` in the mode that a column names."""
    return F.when(mode == "aggressive", function(line, "aggressive")).otherwise(function(line, "strict"))


def n_vars(skeleton_: Column) -> Column:
    return (F.size(F.split(skeleton_, PLACEHOLDER, -1)) - 1).cast("int")


def parts(skeleton_: Column) -> Column:
    """The constant pieces, one more than there are variables."""
    return F.split(skeleton_, PLACEHOLDER, -1)


def interleave(pieces: Column, values: Column) -> Column:
    """The line again: piece, value, piece ... piece."""
    return F.array_join(F.flatten(F.zip_with(pieces, values, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")


def restore(skeleton_: Column, values: Column) -> Column:
    return interleave(parts(skeleton_), values)


def collides(line: Column) -> Column:
    """A line that holds a reserved character can't be represented."""
    return F.contains(line, F.lit(PLACEHOLDER)) | F.contains(line, F.lit(SEPARATOR))


def for_analysis(line: Column) -> Column:
    """What mode choice reads of a line: its end stripped, bounded, empty if it collides."""
    bare = F.regexp_replace(line, r"\r?\n$", "")
    return F.when(collides(bare), F.lit("")).otherwise(F.left(bare, F.lit(ANALYSIS_CHARS)))


def split_lines(text: Column) -> Column:
    """Lines up to and including their line feed; other line ends stay inside; no empty piece."""
    return F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")


def with_terminator(text: Column) -> Column:
    """A table's value as lines of a block: it ends with a line feed."""
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def line_count(text: Column) -> Column:
    """Line feeds plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def escape(value: Column) -> Column:
    """Bytes 01, 00 and 02 stuffed, in this order, so that 00 and 02 are free to end values and columns."""
    for raw, stuffed in (("\x01", "\x01\x01"), ("\x00", "\x01\x00"), ("\x02", "\x01\x03")):
        value = F.replace(value, F.lit(raw), F.lit(stuffed))
    return value


def unescape(value: Column) -> Column:
    """In one pass over the pieces that start with 01; replacing one after another would mistake 01 03 of the data."""
    found = F.regexp_extract_all(value, F.lit("(?s)\x01.|[^\x01]+"), F.lit(0))
    plain = F.transform(found, lambda p: F.when(p == "\x01\x01", "\x01").when(p == "\x01\x00", "\x00").when(p == "\x01\x03", "\x02").otherwise(p))
    return F.array_join(plain, "")


def decoded(payload: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else byte by byte."""
    return F.when(F.is_valid_utf8(payload.cast("string")), F.decode(payload, "UTF-8")).otherwise(F.decode(payload, "ISO-8859-1"))


def encoding(payload: Column) -> Column:
    return F.when(F.is_valid_utf8(payload.cast("string")), F.lit("utf-8")).otherwise(F.lit("latin-1"))


def likely_binary(payload: Column) -> Column:
    """Over one in a hundred of the first 4096 bytes are control characters other than 9 to 13."""
    head = F.decode(F.substring(payload, 1, BINARY_BYTES), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F]", ""))
    return F.coalesce(F.try_divide(odd, F.least(F.octet_length(payload), F.lit(BINARY_BYTES))) > 0.01, F.lit(False))
