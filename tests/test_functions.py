"""Small functions on literal cases, readers and writers on temporary folders."""

from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import predicates as p
from folioflow.functions import text as t
from folioflow.operators import edits, runs
from folioflow.plans import translate
from folioflow.sources import pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_white_space_of_any_script(spark):
    lit = F.lit
    assert one(spark, t.strip(lit("　 A\xa0"))) == "A"
    assert one(spark, t.clean(lit("a\xa0 \xa0b"))) == "a b"
    assert one(spark, t.is_sound_effect(lit("BOOM\xa0"))) and not one(spark, t.is_sound_effect(lit("HAHAHA")))
    assert not one(spark, t.is_all_caps(lit("漢字"))) and one(spark, t.is_all_caps(lit("ÀB 1"))) and not one(spark, t.is_all_caps(lit("漢 AB")))


def test_replies(spark):
    reply = "[balloon 3] CIAO\n[balloon 12] NO\nnoise\n[balloon 3] AGAIN"
    assert [tuple(r) for r in one(spark, t.tagged_lines(F.lit(reply)))] == [(3, "CIAO"), (12, "NO"), (3, "AGAIN")]
    rows = spark.createDataFrame([("p", 3, "HI", ""), ("p", 12, "NOPE", ""), ("p", 13, " ", "")], "page_id string, pos int, original string, translated string")
    cache = spark.createDataFrame([], "key string, translation string")
    done, gained = translate.translate(rows, cache, lambda _: reply, "English", "Italian")
    assert {(r["pos"], r["translated"]) for r in done.collect()} == {(3, "AGAIN"), (12, "NO"), (13, "")}
    assert gained.count() == 2
    assert one(spark, t.shorter_reply(F.lit('\n "Testo: ciao"\nx'), F.lit("HELLO"))) == "CIAO"
    assert one(spark, t.trim_reply(F.lit("`\"YES\nNO\"`"))) == "YES NO"


def test_glossary(spark):
    assert translate.glossary_fingerprint({}) == "" and translate.glossary_fingerprint({"b": 1, "a": "è"}) == translate.glossary_fingerprint({"a": "è", "b": 1})
    found = translate.with_glossary(spark.createDataFrame([("a", 1), ("b", 2)], "comic string, page int"), spark.createDataFrame([("a", "g")], "comic string, glossary string"))
    assert {(r["page"], r["glossary"]) for r in found.collect()} == {(1, "g"), (2, None)}


def test_boxes(spark):
    box = lambda *x: g.box(*(F.lit(v) for v in x))
    assert tuple(one(spark, g.inscribed_box(box(0, 0, 100, 100)))) == (14, 14, 85, 85)
    assert tuple(one(spark, g.clamp(box(-5, 2, 300, 2), F.lit(100), F.lit(50)))) == (0, 2, 100, 3)
    assert [tuple(b) for b in one(spark, edits.halves(box(0, 0, 9, 4)))] == [(0, 0, 4, 4), (4, 0, 9, 4)]
    assert tuple(one(spark, g.split_words(F.split(F.lit("a b c d e f g"), " "), F.lit(0.25)))) == ("a b", "c d e f g")


def test_predicates(spark):
    assert [one(spark, p.is_valid_text(F.lit(x))) for x in ("a", "-", " ", None)] == [True, False, False, False]
    assert [one(spark, p.positive_number(F.lit(x))) for x in ("3.7", "0", "x", "-2", "0.5")] == [3, None, None, None, None]
    assert one(spark, p.positive_number(F.lit(" 1.5 "), "float")) == 1.5
    assert one(spark, p.extends_to_box(F.lit(True), F.lit(None).cast("boolean"))) and not one(spark, p.shares_size(F.lit(False), F.lit("NO!!"), F.lit(True)))
    row = spark.createDataFrame([(0, "center"), (0, None), (12, None)], "manual_font_size int, manual_align string")
    assert [r[0] for r in row.select(p.has_manual_style(dict(row.dtypes))).collect()] == [True, False, True]


def test_edits(spark):
    schema = "page_id string, pos int, balloon_id long, bbox struct<x1:int,y1:int,x2:int,y2:int>, said string, size int"
    rows = spark.createDataFrame([("p", 0, 4, (0, 0, 10, 30), "a b c", 9), ("p", 1, 7, (0, 0, 30, 10), "d", 5), ("q", 0, None, (0, 0, 2, 2), None, 1)], schema)
    found = edits.split_in_two(rows, F.col("pos") >= 0, ["said"]).orderBy("page_id", "pos", "part").collect()
    assert [(r["balloon_id"], r["said"]) for r in found] == [(4, "a b"), (8, "c"), (7, "d"), (9, ""), (None, None), (1, "")]
    styled = edits.style_to_all(rows, F.col("pos") == 1, ["size"])
    assert {(r["page_id"], r["size"]) for r in styled.collect()} == {("p", 5), ("q", 1)}
    bubbles = spark.createDataFrame([("p", 7), ("p", 50)], "page_id string, balloon_id long")
    assert edits.append_unclaimed(rows, bubbles, ["page_id", "balloon_id"]).count() == 4
    both = [one(spark, c) for c in edits.confirm_text(F.lit("A"), F.lit(" - "))]
    assert both == ["", ""]


def test_masks_against_pixels(spark):
    import random

    draw, masks = random.Random(3), {}
    for page in range(3):
        for mask in range(12):
            y, x = draw.randrange(15), draw.randrange(15)
            masks[page, mask] = {(y + j, x + i) for j in range(draw.randrange(1, 12)) for i in range(draw.randrange(1, 12)) if draw.random() > 0.03}
    masks = {k: v for k, v in masks.items() if v}
    rows = spark.createDataFrame([(*k, y, x, x + 1) for k, v in masks.items() for y, x in v], "page_id int, mask_id int, y int, x0 int, x1 int")
    found = {(r["page_id"], r["a_mask"], r["b_mask"]): (r["common"], r["share"]) for r in runs.contained(rows).collect()}
    expected = {(a[0], a[1], b[1]): (len(u & v), len(u & v) / len(u)) for a, u in masks.items() for b, v in masks.items() if a[0] == b[0] and a != b and u & v}
    assert found == expected
    gone = set()
    for k in sorted(masks):  # in list order; a dropped mask absorbs nothing
        if any(o[0] == k[0] and o != k and o not in gone and len(masks[o]) >= len(masks[k]) and len(masks[k] & masks[o]) / len(masks[k]) >= 0.8 for o in masks):
            gone.add(k)
    assert {(r["page_id"], r["mask_id"]) for r in runs.drop_contained(rows).collect()} == set(masks) - gone
    left = runs.difference(rows.where("mask_id < 6"), rows.where("mask_id >= 6").select("page_id", "y", "x0", "x1"))
    pixels = {(r["page_id"], r["mask_id"], r["y"], x) for r in left.collect() for x in range(r["x0"], r["x1"])}
    cover = {page: set().union(*(v for k, v in masks.items() if k[0] == page and k[1] >= 6)) for page in range(3)}
    assert pixels == {(*k, *q) for k, v in masks.items() if k[1] < 6 for q in v - cover[k[0]]}


def test_pages_on_disk(spark, tmp_path):
    for name in ("a/2.PNG", "a/1.jpg", "a/notes.txt", "b/1.webp"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    found = pages.list_pages(spark, str(tmp_path / "in"))
    assert {(r["comic"], r["page_id"], r["ordinal"]) for r in found.collect()} == {("a", "1", 0), ("a", "2", 1), ("b", "1", 0)}
    assert {(r["comic"], r["n_pages"]) for r in pages.page_counts(found).collect()} == {("a", 2), ("b", 1)}
    assert pages.slice_pages(found, limit=1).count() == 2
    assert (pages.parse_range("3"), pages.parse_range("3", "desktop"), pages.parse_range("2-4", "desktop")) == ((0, 3), (2, 3), (1, 4))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "glossary.json").write_text('{"note": "n", "termini": {"x": "y"}, "vietate": ["z"]}')
    glossary = pages.read_glossary(spark, str(tmp_path / "a" / "glossary.json"))
    assert one_row(glossary.select("comic", translate.glossary_section(F.col("glossary")))) == ("a", "\nTerms: x -> y\nContext: n\nNever use: z\n")
    (tmp_path / "d.json").write_text('{"page_id": "p", "detections": [{"balloon_id": 5, "bbox": [1, 2, 3, 4]}, {"balloon_id": 6, "bbox": [5, 6, 7, 8]}]}')
    rows = pages.read_detections(spark, str(tmp_path / "d.json"))
    pages.write_detections(rows, str(tmp_path / "out"))
    again = pages.read_detections(spark, str(tmp_path / "out"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect())) and rows.count() == 2


def one_row(df):
    return tuple(df.first())
