"""Chat formatting: the hash of a record's nested field paths selects a declarative mapping to canonical turns.

A record is JSON text of any layout. Its field paths (names and nesting, not types or values) make a signature;
``fingerprint`` hashes it, and a table of mappings, keyed by the same hash, says where the turns stand. Adding a
layout means adding a ``Mapping``, not code. Turns are rendered into one string under a template that marks turns
and escapes control strings inside texts reversibly; a mask lists the code points on which loss is taken.

All of it is DataFrame expressions: no Python on the executors, and one shuffle where flat rows are gathered into
records.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. Inside roles and texts one backslash is put between
``<`` and ``|`` (also if backslashes stand there already), so no control string survives in them, and taking one
out again restores them exactly. A line feed inside a role is written ``<|nl|>``.

Defined results: a null text or role is empty; turns are ordered by turn number, then role, then text, nulls
first, and repeated rows are turns of their own; a record that is null, no JSON, or has a layout without mapping
keeps its row, with null turns and ``mapping`` null; an empty table gives an empty table. Flat rows are gathered into nested
records (a struct, as a table of nested fields has them), which go the same way as JSON text: fingerprint of the field paths,
mapping, turns. Only their leaves are never written as JSON, so texts and conversations may be as long as Spark's strings and
arrays. JSON records that can't be read and are long enough to be beyond the limits of Spark's JSON reader raise instead of
losing their turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from linemill.llm._common import free_name, hex_sha256, let, running, text_or_empty

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"
#: A string of a record that Spark reads as JSON has at most so many characters (a record 128 MiB).
JSON_LIMIT = 20_000_000
_TYPES = r": (?:[A-Z_]+(?:\([0-9, ]+\))?)(?=[,>])"


@dataclass(frozen=True)
class Mapping:
    """``shape``: the layout as nested dicts and one-item lists, leaves None. Then either ``turns`` (path of the array
    of messages) with ``role`` and ``text`` (their field names), or ``parts``: (role, path) in order, empty parts left
    out. ``roles`` renames role values."""

    name: str
    shape: dict
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


_FROM = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn rows", {"turns": [{"role": None, "text": None}]}, "$.turns", text="text"),
    Mapping("messages", {"messages": [{"content": None, "role": None}]}, "$.messages"),
    Mapping("nested messages", {"conversation": {"messages": [{"content": None, "role": None}]}}, "$.conversation.messages"),
    Mapping("from and value", {"conversations": [{"from": None, "value": None}]}, "$.conversations", "from", "value", roles=_FROM),
    Mapping("instruction", {"instruction": None, "output": None}, parts=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction with input", {"input": None, "instruction": None, "output": None}, parts=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("system, instruction", {"instruction": None, "output": None, "system": None}, parts=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("prompt and completion", {"completion": None, "prompt": None}, parts=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt and response", {"prompt": None, "response": None}, parts=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question and answer", {"answer": None, "question": None}, parts=(("user", "$.question"), ("assistant", "$.answer"))),
)


def shape_text(shape: dict | list | None) -> str:
    """A layout in the form that ``signature`` has: field names sorted, types left out."""
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(f"{k}{': ' + x if (x := shape_text(shape[k])) else ''}" for k in sorted(shape)) + ">"
    return f"ARRAY<{shape_text(shape[0])}>" if isinstance(shape, list) else ""


def signature(record: Column, kind: DataType | None = None) -> Column:
    """The nested field paths of a record, without the types of the leaves. ``kind``: the type of one that isn't JSON text."""
    variant = F.to_variant_object(_paths(record, kind)) if isinstance(kind, StructType) else F.try_parse_json(record)
    return F.regexp_replace(F.schema_of_variant(variant), _TYPES, "")


def _paths(value: Column, kind: DataType) -> Column:
    """A nested value with empty leaves, and each kind of item once in its arrays: the same field paths, however long it is."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_paths(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.array_distinct(F.transform(value, lambda x: _paths(x, kind.elementType)))
    if isinstance(kind, MapType):
        raise TypeError("a nested record has structs and arrays; write maps as JSON text")
    return F.when(value.isNotNull(), F.lit(""))


def fingerprint(record: Column, kind: DataType | None = None) -> Column:
    return F.xxhash64(signature(record, kind))


def canonical_turns(df: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``mapping`` (its name) and ``turns`` (array of role, text) to records: JSON text, or structs."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("fingerprint", "mapping", "turns")]
    record, kind = F.col(record_col), df.select(record_col).schema[0].dataType
    if isinstance(kind, StructType):
        nested = free_name(df, "_nested")
        hashed = F.when(record.isNotNull(), fingerprint(record, kind))
        return _mapped(df.select(*others, record.alias(nested), hashed.alias("fingerprint")), others, nested, mappings, kind)
    unread = F.when(F.try_parse_json(record).isNull() & (F.length(record) >= JSON_LIMIT), F.raise_error(F.lit("a record of 20,000,000 characters or more can't be read as JSON")).cast("long"))
    hashed = unread.when(F.try_parse_json(record).isNotNull(), fingerprint(record))
    variant = free_name(df, "_variant")
    read = df.select(*others, F.try_parse_json(record).alias(variant), hashed.alias("fingerprint"))
    return _mapped(read, others, variant, mappings)


def _mapped(read: DataFrame, others: list[Column], record_col: str, mappings: tuple[Mapping, ...], kind: StructType | None = None) -> DataFrame:
    """Each record's fingerprint selects its mapping, which takes the turns; ``kind``: the record's type if it is no variant."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        hit = F.col("fingerprint") == F.xxhash64(F.lit(shape_text(m.shape)))
        name, turns = F.when(hit, m.name).otherwise(name), F.when(hit, _turns(F.col(record_col), m, kind)).otherwise(turns)
    return read.select(*others, "fingerprint", name.alias("mapping"), turns.alias("turns"))


def _at(record: Column, kind: DataType, path: str) -> tuple[Column, DataType | None]:
    """The field at a path ``$.a.b`` of a struct and its type; none if its type has no such field."""
    for step in path.split(".")[1:]:
        if not isinstance(kind, StructType) or step not in kind.names:
            return F.lit(None), None
        record, kind = record[step], kind[step].dataType
    return record, kind


def _turns(record: Column, m: Mapping, kind: StructType | None = None) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    if m.turns is None:
        found = [(role, F.try_variant_get(record, path, "string") if kind is None else _at(record, kind, path)[0].cast("string")) for role, path in m.parts]
        return F.filter(F.array(*(turn(F.lit(role), text) for role, text in found)), lambda t: F.coalesce(F.length(t["text"]), F.lit(0)) > 0)
    if kind is None:
        raw = F.try_variant_get(record, m.turns, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
    else:
        raw, of = _at(record, kind, m.turns)
        if not isinstance(of, ArrayType) or not isinstance(of.elementType, StructType) or not {m.role, m.text} <= set(of.elementType.names):
            return F.lit(None).cast(TURNS)

    def renamed(t: Column) -> Column:
        role = given = t[m.role].cast("string")
        for old, new in m.roles.items():
            role = F.when(given == old, new).otherwise(role)
        return turn(F.coalesce(role, F.lit("")), F.coalesce(t[m.text].cast("string"), F.lit("")))

    return F.transform(raw, renamed)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def render(df: DataFrame, turns_col: str = "turns", learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``mask``: for each turn the code points (start, end) that take loss, or null."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("formatted", "mask")]

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*learn_roles).alias("learn"))

    def masked(pieces: Column) -> Column:
        begins = running(F.transform(pieces, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END) + 1))
        start = lambda p, at: at + F.length(p["head"])
        return F.zip_with(pieces, begins, lambda p, at: F.when(p["learn"], F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["body"])).alias("end"))))

    pieces = free_name(df, "_pieces")
    staged = df.select(*others, F.transform(turns_col, piece).alias(pieces))
    formatted = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return staged.select(*others, formatted.alias("formatted"), let(F.col(pieces), masked).alias("mask"))


def read_back(df: DataFrame, formatted_col: str = "formatted", mask_col: str = "mask") -> DataFrame:
    """Add ``read_turns`` (role, text) and ``loss_texts``, both taken from the formatted string and the mask alone."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("read_turns", "loss_texts")]
    pieces = F.filter(F.split(F.col(formatted_col), r"<\|im_start\|>", -1), lambda p, i: i > 0)
    read, parts = free_name(df, "_read"), free_name(df, "_cut")
    staged = df.select(*others, pieces.alias(read))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(text).alias("text"))

    # Where each piece begins (behind its start marker), so that a span is cut from its piece and not from the whole.
    begins = F.transform(running(F.transform(read, lambda p: F.length(p) + len(START))), lambda at: at + len(START))
    staged = staged.select(*others, read, F.arrays_zip(F.col(read).alias("piece"), begins.alias("begin"), F.col(mask_col).alias("span")).alias(parts))
    cut = F.transform(
        F.filter(parts, lambda x: x["span"].isNotNull()),
        lambda x: unescaped(F.substring(x["piece"], x["span"]["start"] - x["begin"] + 1, x["span"]["end"] - x["span"]["start"])),
    )
    return staged.select(*others, F.transform(read, turn).alias("read_turns"), cut.alias("loss_texts"))


def nested_records(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, record): flat rows of (key, order, role, text) gathered into one nested record each."""
    turn = F.struct(F.col(order).alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))
    gathered = rows.select(F.col(key), turn.alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return gathered.select(key, F.struct(turns.alias("turns")).alias("record"))


def records_from_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, record): the same as JSON text."""
    return nested_records(rows, key, order).select(key, F.to_json("record").alias("record"))


def turns_from_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, fingerprint, mapping, turns) of flat rows of (key, order, role, text): ``canonical_turns`` of their records."""
    return canonical_turns(nested_records(rows, key, order), "record", mappings).select(key, "fingerprint", "mapping", "turns")


def chat_report(rows: DataFrame) -> DataFrame:
    """Format every conversation and digest what is read back from the formatted strings and masks."""
    done = read_back(render(turns_from_rows(rows.select("conv_id", "turn", "role", "text"))))
    loss = F.array_join("loss_texts", "")
    text = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), hex_sha256(text).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), hex_sha256(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
