"""Versions of page tables: empty pages, failed commits, roll-back, trimming, page names."""

import pytest

from folioflow.plans import fitting
from folioflow.sources import tables
from folioflow.sources.snapshots import Snapshots

SCHEMA = "page_id string, v int"
TABLE = {" ": 300}


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), SCHEMA)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), SCHEMA)
    pages = lambda *names: spark.createDataFrame([(n,) for n in names], "page_id string")
    assert table.read().count() == 0 and table.log() == []
    assert table.commit(rows(("009", 1), ("9", 2), ("10", 3), ("010", 4))) == 0
    assert held(table.read()) == [("009", 1), ("010", 4), ("10", 3), ("9", 2)]
    table.commit(rows(("9", 5), ("9", 6), ("x", 7)), pages("9", "10"))  # 10 becomes empty, x is not asked for
    assert held(table.read()) == [("009", 1), ("010", 4), ("9", 5), ("9", 6)]
    # a commit that stops before its line is never seen
    rows(("009", 99)).write.parquet(str(tmp_path / "t/rows/000000000002-lost"))
    pages("009").write.parquet(str(tmp_path / "t/pages/000000000002-lost"))
    assert held(table.read()) == [("009", 1), ("010", 4), ("9", 5), ("9", 6)]
    table.commit(rows((None, 8)))
    table.restore(0)
    assert held(table.read()) == held(table.read(0)) == [("009", 1), ("010", 4), ("10", 3), ("9", 2)]
    table.commit(rows(("10", 10)))
    assert held(table.read()) == [("009", 1), ("010", 4), ("10", 10), ("9", 2)] and table.read(2).count() == 5
    with pytest.raises(ValueError):
        table.read(17)
    assert held(table.versions_of(1).where("page_id = '10'")) == [("10", 4, 0)]


def test_trimming(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), SCHEMA)
    states = []
    for i in range(7):
        table.commit(spark.createDataFrame([(str(i % 3), i)], SCHEMA))
        states.append(held(table.read()))
    table.retain(3)
    assert [x[0] for x in table.log()] == [3, 4, 5, 6] and table.log()[0][3]
    assert [held(table.read(v)) for v in (3, 4, 5, 6)] == states[3:]
    assert len(list((tmp_path / "t/rows").iterdir())) == 4
    table.retain(3)
    assert [x[0] for x in table.log()] == [3, 4, 5, 6]
    table.restore(4)
    table.retain(1)  # the last version still needs an older one
    assert held(table.read()) == states[4] and len(table.log()) == 5


def test_mask_pages_keep_their_names(spark, tmp_path):
    path = str(tmp_path / "masks")
    tables.write_masks(spark.createDataFrame([("009", 0, 1, 2, 5), ("010", 0, 1, 2, 5), ("10", 0, 4, 2, 5)], tables.MASKS), path)
    assert {tuple(r) for r in tables.read_masks(spark, path).select("page_id", "y").collect()} == {("009", 1), ("010", 1), ("10", 4)}
    tables.write_masks(spark.createDataFrame([], tables.MASKS), path, spark.createDataFrame([("010",)], "page_id string"))
    assert {r["page_id"] for r in tables.read_masks(spark, path).collect()} == {"009", "10"}


def test_overlong_texts_are_too_long(spark):
    box = "named_struct('x1', 0, 'y1', 0, 'x2', 200, 'y2', 200) AS bbox"
    phrase = "some more words "
    cases = [("a", "short text", phrase * 300), ("b", "short text", "x" * 102), ("c", phrase * 300, "short"), ("d", "short text", phrase * 30), ("e", "short text", "short text"), ("f", "", "x"), ("g", "x", None)]
    rows = spark.createDataFrame(cases, "id string, original string, translated string").selectExpr("*", box)
    found = {r["id"]: r for r in fitting.too_long(rows, TABLE).collect()}
    assert {k: r["too_long"] for k, r in found.items()} == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": False, "g": False}
    assert found["a"]["size_ratio"] < 0.75 and found["a"]["target"] == int((300 * len(phrase) - 1) * 0.6)
