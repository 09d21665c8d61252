"""Tables of masks, cache and fonts in temporary folders."""

from folioflow.sources import pages, tables

RUNS = "page_id string, mask_id long, y int, x0 int, x1 int"


def test_masks(spark, tmp_path):
    path = str(tmp_path / "masks")
    assert tables.read_masks(spark, path).count() == 0
    tables.write_masks(spark.createDataFrame([("a", 0, 1, 2, 5), ("b", 4, 1, 2, 5), ("b", 4, 3, 0, 9)], RUNS), path)
    tables.write_masks(spark.createDataFrame([("a", 7, 1, 2, 5)], RUNS), path)
    held = tables.read_masks(spark, path).select("page_id", "mask_id", "y", "x0", "x1")
    assert {(r["page_id"], r["mask_id"]) for r in held.collect()} == {("a", 7), ("b", 4)}
    both = tables.add_masks(held, spark.createDataFrame([("b", 0, 8, 1, 2), ("b", 3, 8, 1, 2), ("c", 9, 8, 1, 2)], RUNS))
    assert {(r["page_id"], r["mask_id"]) for r in both.collect()} == {("a", 7), ("b", 4), ("b", 5), ("b", 6), ("c", 0)}
    box = {r["page_id"]: tuple(r["bbox"]) for r in tables.mask_boxes(held).collect()}
    assert box == {"a": (2, 1, 5, 2), "b": (0, 1, 9, 4)}


def test_pixels(spark):
    grey = spark.createDataFrame([("p", 1, 0, [0, 9, 200, 0, 128]), ("p", 1, 1, [0, 0]), ("p", 1, 2, None)], "page_id string, mask_id long, y int, values array<int>")
    find = lambda above: sorted(tuple(r) for r in tables.runs_of_pixels(grey, above).select("y", "x0", "x1").collect())
    assert find(0) == [(0, 1, 3), (0, 4, 5)] and find(127) == [(0, 2, 3), (0, 4, 5)]


def test_cache(spark, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    none = tables.read_cache(spark, first)
    tables.write_cache(none, spark.createDataFrame([("k", "a"), ("l", "")], tables.CACHE), first)
    tables.write_cache(tables.read_cache(spark, first), spark.createDataFrame([("k", "b")], tables.CACHE), second)
    assert {tuple(r) for r in tables.read_cache(spark, second).collect()} == {("k", "b"), ("l", "")}
    stats = str(tmp_path / "stats")
    tables.write_stats(tables.cache_stats(tables.read_cache(spark, second), second), stats)
    assert tuple(spark.read.json(stats).select("entries", "file").first()) == (2, second)
    tables.clear_cache(spark, second)
    assert tables.read_cache(spark, second).count() == 0
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "good.json").write_text('{"k": "è", "l": "x"}')
    (tmp_path / "json" / "bad.json").write_text('{"k": "è"')
    assert {tuple(r) for r in tables.import_cache(spark, str(tmp_path / "json")).collect()} == {("k", "è"), ("l", "x")}


def test_fonts_and_ranges(spark, tmp_path):
    for name in ("b.otf", "c.ttf", "a.otf", "a.TTF", "x.txt", "d.ttf"):
        (tmp_path / name).write_bytes(b"x" if name != "d.ttf" else b"")
    found = sorted((r["pos"], r["path"].rsplit("/", 1)[-1]) for r in tables.fonts(spark, str(tmp_path)).collect())
    assert [name for _, name in found] == ["a.TTF", "c.ttf", "a.otf", "b.otf"]
    parse = lambda text: pages.parse_range(text, "export")
    assert [parse(x) for x in ("", "3", "2-5", "-4", "0-2", "3-")] == [(0, None), (2, 3), (1, 5), (0, 4), (0, 2), (2, None)]
