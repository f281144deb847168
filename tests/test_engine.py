import random

import pytest
from pyspark.sql import functions as F

from tallyloom.engine import Engine
from tallyloom.operators import render
from tallyloom.operators.filters import Filters
from tallyloom.plans.fixtures import frame
from tallyloom.sources import files


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(frame(spark, "messages").cache(), frame(spark, "sessions").cache(), parses=frame(spark, "parses"))


def test_grep(engine):
    rows = engine.grep("parser", fixed=True).collect()
    assert [r.id for r in rows][:2] == ["m19", "m18"] and all(r.id != "m20" for r in rows)
    assert {r.id: r.copies for r in rows}["m16"] == 1
    assert [(r.line, r.line_text) for r in engine.grep_lines(r"parse\.py", filters=Filters(kinds=("assistant",))).collect()] == [(2, "It lives in src/parse.py")]
    assert {r.session_id: r.messages for r in engine.grep_sessions("parser").collect()}["s-beta-9"] == 2


def test_search(engine):
    rows = engine.search("parser fixed").collect()
    assert rows[0].id == "m09" and "parser" in rows[0].snippet.snippet
    assert engine.search("nothing-like-it parser", matching="all").count() == 0
    assert engine.search("nothing-like-it parser", matching="any").count() > 0
    with pytest.raises(ValueError):
        engine.search("x", matching="some")


def test_sessions_and_reading(engine):
    first = engine.list_sessions(Filters(limit=2)).collect()
    assert [r.id for r in first][:2] == ["c7", "c3"] and len(first) == 3
    assert [r.id for r in engine.read("m05", 1, 1).orderBy("offset").collect()] == ["m04", "m05", "m06"]
    assert engine.read_address("s-alpha/20480", 0, 0).first().id == "m05"
    with pytest.raises(ValueError):
        engine.read_address("s-beta")
    assert engine.digests().where("conversation_id = 'c1'").first().commands == 1
    assert engine.trace("abc1234" + "0" * 33).first().session_id == "s-alpha-1"
    assert engine.diagnostics().count() == 4


def test_rendering(spark, engine):
    assert render.header({"n": 3, "title": "two words", "none": None}) == 'n=3 title="two words"'
    assert len(render.header({f"k{i}": "x" * 50 for i in range(20)}).encode()) <= 260
    page = render.text_page([{"session_id": "s", "ordinal": i, "kind": "user", "copies": 1, "lines": [(1, "x" * 100)]} for i in range(50)], {"total": 50}, 1000)
    assert len(page.encode()) < 1100 and "next offset" in page
    signed = render.sign("5.c1", "scope", 3, b"key")
    assert render.verify(signed, "scope", 3, b"key") == "5.c1"
    for scope, revision in (("other", 3), ("scope", 4)):
        with pytest.raises(ValueError):
            render.verify(signed, scope, revision, b"key")
    got = render.within_budget(engine.messages, F.octet_length("text"), [F.col("ordinal"), F.col("id")], ["session_id"], 3, 100)
    assert all(r["rank"] <= 3 and r.running_bytes <= 100 for r in got.collect()) and got.count() > 3
    assert '"id":"m01"' in render.as_json(engine.messages.where("id = 'm01'")).first().json


def test_files(spark):
    schema = "path string, identity string, size long, ctime long, head string, anchor string"
    known = spark.createDataFrame([("a", "i", 10, 1, "h", "x"), ("b", "i", 10, 1, "h", "x"), ("c", "i", 10, 1, "h", "x"), ("d", "i", 10, 1, "h", "x"), ("e", "i", 1, 1, "h", "x")], schema)
    seen = spark.createDataFrame([("a", "i", 10, 1, "h", "x"), ("b", "i", 20, 2, "h", "x"), ("c", "i", 20, 2, "h", "y"), ("d", "j", 10, 1, "h", "x"), ("f", "i", 1, 1, "h", "x")], schema)
    assert {r.path: r.decision for r in files.decisions(known, seen).collect()} == {"a": "unchanged", "b": "append", "c": "rewrite", "d": "rewrite", "e": "gone", "f": "new"}
    data = random.Random(1).randbytes(300_000)
    sizes = dict(least=2_000, mean=8_000, most=40_000)
    ends = files.cut_points(data, **sizes)
    assert ends[-1] == len(data) and all(b - a <= 40_000 for a, b in zip([0, *ends], ends))
    moved = files.cut_points(b"some more bytes" + data, **sizes)
    assert len({e - 15 for e in moved} & set(ends)) > 0.7 * len(ends)
    rows = files.chunked(spark.createDataFrame([("p", bytearray(data)), ("q", bytearray())], "path string, content binary"), **sizes).collect()
    assert [r.offset + r["size"] for r in rows] == ends and [r.is_tail for r in rows] == [False] * (len(ends) - 1) + [True]
    text = "start\n" + "noise\n" * 10_000 + "src/a.py:10: error here\n" + "noise\n" * 10_000 + "end"
    assert len(files.capped(text)) < 16_500 and "src/a.py:10: error here" in files.capped(text) and files.capped("short") == "short"
    side = files.with_companions(spark.createDataFrame([("/s/a.jsonl",)], "path string"), spark.createDataFrame([("/s/a/meta.json",), ("/s/b/meta.json",)], "path string"))
    assert [r.companion for r in side.collect()] == ["/s/a/meta.json"]
