"""Personal data in text: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression of one projection: no shuffle, no Python on the executors.

Positions come from pairing what a pattern matched with what lies between the matches: ``split`` and
``regexp_extract_all`` walk the same leftmost, non-overlapping matches, so running sums over both give each
match's start. A text of any length and of any number of matches costs time in proportion to it: patterns start only at
the first character of a run or where the last match ended, and repeat possessively, so that neither backtracking nor
recursion grows with the text, and sums are made in blocks.

Defined results: a null text counts as empty (no spans); an empty table gives an empty table; repeated rows and
repeated ids are judged row by row; other columns of the input are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.llm._common import hex_sha256, let, plain, running, text_or_empty

#: Characters on either side of a candidate in which context words count, up to the next candidate of its kind.
CONTEXT_CHARS = 40
#: What a context word adds to a score, and the score from which a span of the optional kinds is reported.
CONTEXT_GAIN, REPORT_AT = 0.3, 0.6


@dataclass(frozen=True)
class Kind:
    """``pattern``: candidates; ``needs``: a pattern without which the text is not searched; ``score``: a confirmed
    span's score without context; ``always``: report every confirmed span, whatever its score."""

    name: str
    pattern: str
    needs: str
    words: str
    score: float
    always: bool = True


#: Characters of account numbers by country, the country's code and check digits included.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """The length that a country prescribes, so that what follows in capitals or digits is left out; for other codes as
    many characters as there are, up to where a listed country begins."""
    listed = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
    known = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{listed})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?:{known}|{other})(?![A-Za-z0-9])"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "e-?mail|contact|mailto|write", 0.7),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|host|server|address|addr", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "card|visa|master|credit|debit|payment", 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|tel|call|mobile|fax|whatsapp", 0.6),
    Kind("iban", _iban_pattern(), r"[A-Z]{2}[0-9]{2}", "iban|bank|account|konto|compte|cuenta", 0.6, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social security|tax id", 0.4, False),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,64}(?![A-Za-z0-9_])", r"[A-Za-z0-9_]{24}", r"token|secret|passw|api.?key|private.?key|bearer", 0.4, False),
)
BASE = ("email", "ip", "card", "phone")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """The remainder of an account number, first four characters moved to the end, A to Z read as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c)
    return F.aggregate(
        F.filter(F.split(moved, "(?!^)"), lambda c: c != ""),  # the split's last piece is empty
        F.lit(0),
        lambda acc, c: F.when(code(c) >= 65, (acc * 100 + code(c) - 55) % 97).otherwise((acc * 10 + code(c) - 48) % 97),
    )


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return _mod97(found) == 1
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$")
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(kind: Kind) -> Column:
    """The confirmed spans of one kind, from the columns that hold its matches and the text between them."""
    found, between = F.col(f"_{kind.name}_found"), F.col(f"_{kind.name}_between")
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    sides = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.slice(between, F.lit(2), F.size(found)), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    items = F.zip_with(found, sides, lambda m, s: F.struct(m.alias("m"), s["before"].alias("before"), s["after"].alias("after")))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["before"])
        near = F.concat_ws(" ", F.right(x["before"], F.lit(CONTEXT_CHARS)), F.left(x["after"], F.lit(CONTEXT_CHARS)))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{kind.words})"), CONTEXT_GAIN).otherwise(0.0)
        return F.when(_confirmed(kind.name, x["m"]), F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), score.alias("score")))

    def placed(pairs: Column) -> Column:
        begins = running(F.transform(pairs, lambda x: F.length(x["before"]) + F.length(x["m"])))
        spans = F.zip_with(pairs, begins, span)
        return F.filter(spans, lambda x: x.isNotNull() if kind.always else x.isNotNull() & (x["score"] >= REPORT_AT))

    return F.when(F.size(found) > 0, let(items, placed)).otherwise(empty)


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add column ``out``: array of (kind, start, end, score), in the order of ``kinds``, then start."""
    df, names, columns = *plain(df, text_col), df.columns
    kept = [F.col(n).alias(n) for n, c in zip(names, columns, strict=True) if c != out]
    text = text_or_empty(text_col)
    none = F.expr("cast(array() as array<string>)")
    matched = df.select(*kept, *(x for k in kinds for x in (
        F.when(text.rlike(k.needs), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"_{k.name}_found"),
        F.when(text.rlike(k.needs), F.split(text, k.pattern, -1)).otherwise(none).alias(f"_{k.name}_between"),
    )))
    back = [F.col(n).alias(c) for n, c in zip(names, columns, strict=True) if c != out]
    return matched.select(*back, F.concat(*(_spans(k) for k in kinds)).alias(out))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replace each reported span by ``[KIND]``; of overlapping spans the one that starts first (then the longer) wins."""
    order = F.array_sort(F.transform(F.col(spans_col), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -s["minus_end"]).alias("at"))

    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    staged = df.select(*others, text_or_empty(text_col).alias("_text"))
    done = F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length(F.col("_text")))))
    return staged.select(*others, done.alias(text_col)).select(*df.columns)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of ``find_pii``: counts of the base kinds, a hash of their spans, and all spans as text."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter(F.col("pii"), lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(F.col("pii"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), hex_sha256(spans_text(base)).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"),
        *(count(k.name) for k in KINDS if k.name not in BASE), F.coalesce(F.array_max(F.transform(F.col("pii"), lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
