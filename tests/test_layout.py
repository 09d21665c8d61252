"""Wrapping and fitting against brute force."""

from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import layout
from folioflow.plans import fitting

TABLE = {" ": 300, "i": 250, "m": 900}


def width(line):
    return sum(TABLE.get(c, layout.WIDE) for c in line)


def fewest(words, limit):
    """All ways to set the words on the fewest lines that fit, by trying every set of breaks."""
    for k in range(len(words)):
        ways = []
        for cuts in combinations(range(1, len(words)), k):
            edges = [0, *cuts, len(words)]
            lines = [" ".join(words[a:b]) for a, b in zip(edges, edges[1:])]
            if all(width(x) <= limit for x in lines):
                ways.append(lines)
        if ways:
            return ways
    return []


def texts():
    random = Random(5)
    word = lambda: "".join(random.choice("aimxé") for _ in range(random.randint(1, 6)))
    return [" ".join(word() for _ in range(random.randint(0, 9))) for _ in range(60)] + ["", " 　", None, "x" * 40]


def test_fit_box(spark):
    rows = [(i, s) for i, s in enumerate(texts())]
    given = spark.createDataFrame(rows, "i int, s string").withColumn("w", layout.wrap(F.col("s"), TABLE, F.lit(40), F.lit(9)))
    out = layout.fit_box(given, "s", F.lit(40), F.lit(50), TABLE, 8, 14)
    sizes = set()
    for r in out.collect():
        words = (r["s"] or "").split()
        size, lines, overflow = r["size"], r["lines"], r["overflow"]
        ways = {n: fewest(words, 40000 / n) for n in range(14, 7, -1)}
        fits = [n for n, w in ways.items() if not words or w and n * 1.15 * len(w[0]) <= 50]
        assert overflow == (not fits)
        sizes.add(size)
        if not fits:
            assert size == 8 and len(lines) <= 5
            continue
        assert size == fits[0] and " ".join(lines).split() == words
        if words:
            slack = lambda way: sum((40000 - width(x) * size) ** 2 for x in way)
            assert slack(lines) == min(slack(w) for w in ways[size]), (lines, ways[size])
        assert " ".join(r["w"]).split() == words
        assert all(width(x) <= 40000 / 9 or " " not in x for x in r["w"])
        for a, b in zip(r["w"], r["w"][1:]):  # the next word did not fit
            assert width(a + " " + b.split()[0]) > 40000 / 9
    assert len(sizes) > 3


@pytest.mark.parametrize("word, lines", [("abcdefghij", ["abcd-", "efghij"]), ("abc", ["abc"])])
def test_broken_words(word, lines):
    ruler = layout.Ruler(TABLE, lambda w: [2, 4, 8] if len(w) == 10 else [])
    assert ruler.broken_lines([word], 3600) == lines


def test_cut_lines():
    ruler = layout.Ruler(TABLE)
    assert ruler.shortened("abcdefgh", 3600) == "abcde…" and ruler.shortened("abcdefgh", 600) == "abc" and ruler.shortened("abc", 1) == "abc"


def test_shorten(spark):
    box = "named_struct('x1', 0, 'y1', 0, 'x2', 200, 'y2', 200)"
    long = "wide words here " * 30
    rows = spark.createDataFrame([
        ("p", 0, "hello there you", long), ("p", 1, "hello there you", "short one"), ("p", 2, "x" * 30, long.upper()),
        ("p", 3, "hello there you", "fail " * 90), ("q", 0, None, None),
    ], "page_id string, pos int, original string, translated string").selectExpr("*", f"{box} AS bbox")

    def client(said, target, original):
        if said.startswith("fail"):
            raise RuntimeError
        return "tiny" if said.isupper() else f" shorter {target > 0} "

    found = {(r["page_id"], r["pos"]): (r["translated"], r["shortened"]) for r in fitting.shorten(rows, client, TABLE).collect()}
    assert found[("p", 0)] == ("shorter True", True)
    assert found[("p", 1)] == ("short one", False)
    assert found[("p", 2)] == (long.upper(), False)  # less than half of the original
    assert found[("p", 3)][1] is False and found[("q", 0)] == (None, False)


def test_long_texts_stop_at_their_box():
    """Lines beyond the box are not set: a text of 100,000 words asks for the widths of few."""
    asked = []

    class Counting(layout.Ruler):
        def __call__(self, piece):
            asked.append(piece)
            return super().__call__(piece)

    ruler = Counting({" ": 300})
    whole = layout.Ruler({" ": 300}).broken_lines(["word"] * 1000, 9000)
    assert ruler.broken_lines(["word"] * 100000, 9000, 5)[:5] == whole[:5] and len(asked) < 100


def test_units_and_sizes(spark):
    """Widths against a sum over characters, sizes against all of them."""
    table = {" ": 300, "i": 300, "m": 850, "W": 850, "": 0}
    texts = ["", "mi Wim", "über 😀 mmm", "a " * 40, "W" * 30, "i m " * 12]
    words = [t.split() for t in texts]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>").withColumn("u", layout.units(F.col("w"), table))
    df = df.withColumn("s", layout.fit_size(F.col("u"), 300, F.lit(60), F.lit(90), 5, 31, 1.15))
    for r in df.collect():
        assert r["u"] == [sum(table.get(c, layout.WIDE) for c in w) for w in r["w"]]
        fits = []
        for size in range(5, 32):
            room, lines, used = 1000 * 60 // size, 0, None
            for u in r["u"]:
                stays = used is not None and used + 300 + u <= room
                lines, used = lines + (not stays), used + 300 + u if stays else u
            if max(r["u"], default=0) <= room and size * 1.15 * lines <= 90:
                fits.append(size)
        assert r["s"] == max(fits, default=None), r
