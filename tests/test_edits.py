"""Review edits on literal rows."""

from pyspark.sql import functions as F

from folioflow.operators import edits

ROWS = "page_id string, pos int, original string, translated string, ocr_suspect boolean, overflow boolean"


def rows_of(spark):
    data = [("p", 0, "HI", "ciao", True, False), ("p", 1, "YES", "", True, True), ("p", 2, None, "si", False, True), ("q", 5, " no ", None, None, None)]
    return spark.createDataFrame(data, ROWS).withColumn("bbox", F.expr("named_struct('x1', 0, 'y1', 0, 'x2', 50, 'y2', 40)"))


def texts(df):
    return {(r["page_id"], r["pos"]): (r["original"], r["translated"]) for r in df.collect()}


def test_moves(spark):
    moves = spark.createDataFrame([("p", 1)], "page_id string, pos int").withColumn("bbox", F.expr("named_struct('x1', -5, 'y1', 90, 'x2', 300, 'y2', 500)"))
    sizes = spark.createDataFrame([("p", 200, 100)], "page_id string, width int, height int")
    found = {(r["page_id"], r["pos"]): r for r in edits.move_boxes(rows_of(spark).withColumn("balloon_split", F.lit(True)), moves, sizes).collect()}
    assert tuple(found["p", 1]["bbox"]) == (0, 90, 200, 100) and tuple(found["q", 5]["bbox"]) == (0, 0, 50, 40) and len(found) == 4
    flags = lambda r: (r["manual_text_box"], r["balloon_split"], r["manual_respect_shape"])
    assert flags(found["p", 1]) == (True, False, False) and flags(found["p", 0]) == (None, True, None)


def test_recreated(spark):
    given = rows_of(spark).withColumn("manual_balloon_tail", F.when(F.col("pos") == 0, "east"))
    found = {r["pos"]: (r["manual_fill_color"], r["manual_border"], r["manual_balloon_shape"], r["manual_balloon_tail"]) for r in edits.recreate_balloons(given, F.col("pos") < 2).collect()}
    assert found == {0: ("#ffffff", True, "ellipse", "east"), 1: ("#ffffff", True, "ellipse", "south"), 2: (None,) * 4, 5: (None,) * 4}


def test_texts(spark):
    rows = rows_of(spark)
    answers = spark.createDataFrame([("p", 0, " - "), ("p", 1, " nuovo\n"), ("q", 9, "x")], "page_id string, pos int, said string")
    done = edits.confirm_rows(rows, answers)
    assert texts(done) == {("p", 0): ("", ""), ("p", 1): ("YES", "nuovo"), ("p", 2): (None, "si"), ("q", 5): (" no ", None)}
    assert {r["pos"]: r["ocr_suspect"] for r in done.collect()} == {0: False, 1: False, 2: False, 5: None}
    table = spark.createDataFrame([("p", 0, "uno"), ("p", 2, "-"), ("p", 3, "far"), ("q", 0, None)], "page_id string, line int, said string")
    assert texts(edits.save_table(rows, table)) == {("p", 0): ("HI", "uno"), ("p", 1): ("YES", ""), ("p", 2): ("", ""), ("q", 5): (" no ", "")}
    assert texts(edits.copy_through(rows)) == {("p", 0): ("HI", "HI"), ("p", 1): ("YES", "YES"), ("p", 2): (None, ""), ("q", 5): (" no ", "no")}
    assert {tuple(r) for r in edits.page_status(rows).collect()} == {("p", 3, 1, 1), ("q", 1, 0, 0)}
