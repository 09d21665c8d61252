"""What goes through in one pass, against rounds."""

from random import Random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators import masks, merge, rounds


@pytest.fixture
def no_tables(monkeypatch):
    def refuse(*_):
        raise AssertionError("a table was written between rounds")

    return lambda: monkeypatch.setattr(rounds, "written", refuse)


def test_small_keys_match_in_one_pass(spark, monkeypatch, no_tables):
    random = Random(4)
    rows = [(p, random.randint(0, 9), random.randint(0, 9), random.randint(0, 5)) for p in "abc" for _ in range(60)]
    pairs = spark.createDataFrame(rows, "page string, a int, b int, cost int")
    ask = lambda: sorted(map(tuple, rounds.greedy_matching(pairs, ["page"], "a", "b", "cost").collect()))
    monkeypatch.setattr(rounds, "FOLD", 55)
    mixed = ask()
    monkeypatch.setattr(rounds, "FOLD", 4096)
    no_tables()
    assert ask() == mixed and mixed


def test_small_pages_are_cut_in_one_pass(spark, monkeypatch, no_tables):
    random = Random(9)
    rows = [(p, m, y, y + random.randint(20, 60), x, x + random.randint(20, 60)) for p in "abc" for m in range(5) for y, x in [(random.randint(0, 50), random.randint(0, 50))]]
    bands = spark.createDataFrame(rows, "page_id string, mask_id int, y0 int, y1 int, x0 int, x1 int")
    ask = lambda: sorted(map(tuple, masks.subtract_overlaps(bands).collect()))
    monkeypatch.setattr(masks, "MOST_PIXELS", 0)
    slow = ask()
    monkeypatch.setattr(masks, "MOST_PIXELS", 1 << 26)
    no_tables()
    assert ask() == slow and slow


def test_fonts_are_scored_by_kind(spark):
    """No rows of fonts are sorted; equal fonts go by place, then by path."""
    fonts = spark.createDataFrame([(i // 2, f"font{i}", *(None if (i >> k) % 5 == 0 else bool(i >> k & 1) for k in range(4))) for i in range(40)], "pos int, path string, is_bold boolean, is_handwritten boolean, avoid boolean, preferred boolean")
    wanted = spark.createDataFrame([(k, bool(k & 1), bool(k & 2), bool(k & 4)) for k in range(8)], "k int, is_bold boolean, is_handwritten boolean, is_all_caps boolean")
    got = {r["k"]: (r["font_path"], r["score"]) for r in merge.best_font(wanted, fonts, "k").collect()}
    score = F.greatest(merge.font_score(*(F.col(c) for c in ("is_bold", "is_handwritten", "is_all_caps", "f.is_bold", "f.is_handwritten", "f.avoid", "f.preferred"))), F.lit(-1))
    every = wanted.crossJoin(fonts.select(F.struct("*").alias("f"))).select("k", F.struct(score.alias("s"), (-F.col("f.pos")).alias("p"), "f.path").alias("r"))
    assert got == {r["k"]: (r["r"]["path"], r["r"]["s"]) for r in every.groupBy("k").agg(F.max("r").alias("r")).collect()}


def test_doubled_words_of_odd_texts(spark):
    texts = [None, "", "a a", "the The end", "no, no no", "!! !!", "x\n- - y y.", "ΟΔΟΣ οδος", "w w w"]
    bare = lambda w: "".join(c for c in w if c.isalnum() or c == "_").lower()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in df.select("i", "x", t.doubled_words(F.col("x")).alias("d")).collect():
        words = (r["x"] or "").split()
        expected = [bare(a) for a, b in zip(words, words[1:]) if bare(a) and bare(a) == bare(b) and a[-1] not in ",.;:!?…—-" and bare(a) not in t.REPEATABLE_WORDS]
        assert (r["d"] or []) == expected, r
