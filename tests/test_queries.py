"""Every query of the engine against its statement in DuckDB, over whole small tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linemill.plans.queries import ORACLES, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_duckdb(spark, name):
    same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_checksums_like_zlib(spark):
    import zlib

    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {x.doc_id: x.crc32 for x in QUERIES["q22_crc32"](spark, SF).collect()} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}


def _payloads(spark, *names):
    from linemill.operators import blocks as b
    from linemill.plans.sources import lines

    return {(n, x.block_id): bytes(x.payload) for n in names for x in b.blocks_of_lines(lines(spark, SF, n)).collect()}


def test_layouts_by_recomputation(spark):
    import re

    from linemill.sources import framing
    from linemill.sources.codecs import codec

    found = _payloads(spark, "events", "part", "url", "html")
    got = {(x.source, x.block_id): x for x in QUERIES["q24_layout_decision"](spark, SF).collect()}
    assert set(got) == set(found)
    quoted = r'"(?:[^"\\]|""|\\.)*"'
    kinds = {"strict": r"0x[0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]+)?", "aggressive": r"[a-zA-Z0-9_.:\-]+"}
    for key, payload in found.items():
        lines = [x.decode() for x in framing.lines_of(payload)]
        cut = lambda kind, x: re.sub(rf"(?s){quoted}|{kinds[kind]}", lambda m: '"\0"' if m[0][0] == '"' else "\0", x)
        sample = [cut("strict", re.sub(r"\r?\n$", "", x)) for x in lines[:1000]]
        mode = "aggressive" if len(set(sample)) / len(sample) > 0.1 else "strict"
        templates = list(dict.fromkeys(cut(mode, x) for x in lines))
        limit = max(int((len(lines) + 1) * {"aggressive": 0.4, "strict": 0.25}[mode]), 100) + 1
        assert got[key].mode == mode and (got[key].reason is None) == (len(templates) <= limit)
        if got[key].reason:
            assert (got[key].layout, got[key].flag, got[key].n_templates) == ("passthrough", framing.RAW, 0)
            continue
        columns = []
        for s in templates:
            rows = [[v[1:-1] if v[0] == '"' else v for v in re.findall(rf"(?s){quoted}|{kinds[mode]}", x)] for x in lines if cut(mode, x) == s]
            columns.append([list(c) for c in zip(*rows, strict=True)])
        sampled: list = []
        for table in columns[:5]:
            for column in table:
                sampled += column[:50]
            if len(sampled) > 2000:
                break
        text = "".join(sampled).encode()
        split = len(templates) < 256 and text and len(text) / len(codec("zstd").compress(text)) < 3.0
        assert (got[key].layout, got[key].n_templates) == ("split" if split else "unified", len(templates))
        assert got[key].flag == (3 if len(templates) == 1 else 2 if len(templates) < 256 else 0)


def test_sizes_by_recomputation(spark):
    from linemill.operators import blocks as b
    from linemill.plans import engine
    from linemill.plans.sources import lines

    found = _payloads(spark, "orders")
    row = QUERIES["q30_size_report"](spark, SF).first()
    out = sum(17 + len(x.c_reg) + len(x.c_ids) + len(x.c_vars) for x in engine.encode(b.blocks_of_lines(lines(spark, SF, "orders")), "zstd").collect())
    assert (row.n_blocks, row.size_in, row.size_out) == (len(found), sum(map(len, found.values())), out) and abs(row.ratio - row.size_in / out) < 1e-9


def test_competitors_by_recomputation(spark):
    from linemill.sources.codecs import codec

    found = _payloads(spark, "part", "customer", "nation", "url")
    got = QUERIES["q36_competitors"](spark, SF).collect()
    want = {(f"{n}/{i}", a): len(codec(a).compress(p)) for (n, i), p in found.items() for a in ("xz", "zstd", "zlib", "bz2")}
    assert {(x.file, x.algorithm): x.size for x in got if x.algorithm != "own"} == want
    by: dict = {}
    for x in sorted(got, key=lambda x: (x.file, x.rank)):
        by.setdefault(x.file, []).append(x)
    for rows in by.values():
        assert [x.size for x in rows] == sorted(x.size for x in rows) and len(rows) == 5
        assert rows[0].verdict == ("WIN" if rows[0].algorithm == "own" else "LOSS") and rows[0].diff_vs_winner == 0
        assert abs(rows[0].saving_pct - (rows[1].size - rows[0].size) * 100 / rows[1].size) < 1e-9


def test_layouts_without_whole_blocks(spark, monkeypatch):
    from linemill.sources import codecs

    def compress(data):
        if len(data) > 20_000:
            raise ValueError("more than a sample")
        return known.compress(data)

    known = codecs.CODECS["zstd"]
    want = QUERIES["q24_layout_decision"](spark, SF).collect()
    monkeypatch.setitem(codecs.CODECS, "zstd", codecs.Codec(compress, known.decompress))
    assert sorted(QUERIES["q24_layout_decision"](spark, SF).collect()) == sorted(want) and len(want) >= 4


def test_layouts_like_encode(spark):
    from linemill.operators import blocks as b
    from linemill.plans import engine

    words = [f"{'abcdefghij'[i // 100]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i % 10]}" for i in range(1000)]
    cases = {
        "plain": [f"{i},\"x {i % 7}\",end" for i in range(3000)],
        "no variables": ["same"] * 30,
        "some": [f"{words[i % 90]} {i}\r\n{words[i % 5]}" for i in range(1200)],
        "wide ids": [f"{words[i % 290]} {i}" for i in range(4000)],
        "gated": [f"{words[i % 150]} <{'.' * (i % 150)}> {i}" for i in range(130)] + ["x"] * 20,
        "aggressive gate": ["!" * i + words[i] for i in range(400)],
        "collision": ["a 1", "b \ue001 2", "", "\n\n"],
        "gate, then collision": ["!" * i + "a" for i in range(300)] + ["\ue000"],
        "collision, then gate": ["!" * i + "a" for i in range(50)] + ["\ue000"] + ["!" * i + "a" for i in range(50, 300)],
        "late control characters": ["fine 1"] * 700 + ["\x01" * 100],
        "binary": ["a\x01"] * 3000,
        "binary within short lines": [""] * 2500 + ["\x02" * 50] + ["a"] * 3000,
        "invalid": ["a 1"],
        None: [None, "null block 5", "", "0x1F é€ \U0001f600"],
    }
    rows = [(k, i // 2 if k == "plain" else i, x) for k, xs in cases.items() for i, x in enumerate(xs)]
    for at in (100, 101, 102):  # where the template is met that is one too many: a collision there, one before and one behind
        rows += [(f"at {at}", i, "!" * i + ("\ue000" if i == at else "a")) for i in range(140)]
    df = spark.createDataFrame(rows, "k string, n long, x string").repartition(7)
    df = df.unionByName(spark.sql("select 'invalid' k, 9L n, cast(X'61FF0A62FE' as string) x"))
    args = (F.col("k"), [F.col("n"), F.col("x")], F.col("x"))
    names = ["block_id", "mode", "layout", "reason", "flag", "n_templates"]
    want = engine.encode(b.blocks_of_lines(b.lines_of_texts(df, *args)), "zstd").select(*names).collect()
    got = engine.layouts(b.texts_of(df, *args), "zstd")
    assert got.columns == names and [x.dataType for x in got.schema] == [x.dataType for x in spark.createDataFrame([], engine.ENCODED).select(*names).schema]
    got = got.collect()
    assert len(got) == len(want) == len(cases) + 3 and {x.block_id: x for x in got} == {x.block_id: x for x in want}
    assert {x.layout for x in want} == {"split", "unified", "passthrough"} and {x.reason for x in want} == {None, "Collision Protected", "Passthrough [Entropy]", "Passthrough [Binary]"}
    assert engine.layouts(b.texts_of(df.limit(0), *args)).count() == 0
