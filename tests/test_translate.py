"""The translation step with clients that answer, fail, repeat and shorten."""

import hashlib
import json
import re

from folioflow.plans import translate
from folioflow.sources import pages

ROWS = "page_id string, comic string, pos int, original string, translated string"
CACHE = "key string, translation string"


def key(text, mark=""):
    return hashlib.sha256(f"English:Italian:{text}{mark}".encode()).hexdigest()


def echo(prompt):
    """Answers in upper case, and once for a balloon that nobody asked for."""
    found = re.findall(r"^\[balloon (\d+)\] (.*)$", prompt, re.M)
    return "\n".join([f"[balloon {k}] first", *(f"[balloon {k}] {s.upper()}" for k, s in found), "[balloon 77] NO"]) if (k := found[0][0]) else ""


def said(df):
    return {(r["page_id"], r["pos"]): r["translated"] for r in df.collect()}


def test_batches_and_cache(spark):
    rows = [("p", "c", i, f"text {i}" if i != 4 else " ", None) for i in range(24)] + [("q", "d", 0, "text 0", "old"), ("q", "d", 77, None, "old")]
    cache = spark.createDataFrame([(key("text 0"), ""), (key("text 1"), "known")], CACHE)
    prompts = spark.sparkContext.accumulator(0)

    def client(prompt):
        prompts.add(1)
        if "text 15" in prompt:
            raise TimeoutError
        return echo(prompt)

    done, gained = translate.translate_pages(spark.createDataFrame(rows, ROWS), cache, client, "English", "Italian")
    found = said(done)
    # rows with text go by tens: 0-10 without 4, 11-20, 21-23
    assert found["p", 0] == "" and found["p", 1] == "known" and found["p", 2] == "TEXT 2" and found["p", 10] == "TEXT 10"
    assert all(found["p", i] == "" for i in range(11, 21)) and found["p", 21] == "TEXT 21" and found["p", 4] == "" and found["q", 77] == ""
    assert prompts.value == 3 and len(found) == len(rows)  # page q was known
    assert {r["key"]: r["translation"] for r in gained.collect()} == {key(f"text {i}"): f"TEXT {i}" for i in [2, 3, *range(5, 11), 21, 22, 23]}
    forced, _ = translate.translate_pages(spark.createDataFrame(rows[:3], ROWS), cache, echo, "English", "Italian", force=True)
    assert said(forced) == {("p", i): f"TEXT {i}" for i in range(3)}


def test_glossaries(spark, tmp_path):
    held = {"termini": {"Boss": "Capo"}, "note": "noir", "other": [1, "è"]}
    for comic, text in (("c", json.dumps(held)), ("d", "{}"), ("e", "{broken")):
        (tmp_path / comic).mkdir()
        (tmp_path / comic / "glossary.json").write_text(text)
    glossaries = pages.read_glossary(spark, str(tmp_path / "*" / "glossary.json"))
    mark = translate.glossary_fingerprint(held)
    assert {r["comic"]: r["fingerprint"] for r in glossaries.collect()} == {"c": mark, "d": "", "e": ""}
    rows = spark.createDataFrame([("p", "c", 0, "hey Boss", None), ("q", "d", 0, "hey Boss", None), ("r", "none", 0, "hey Boss", None)], ROWS)
    cache = spark.createDataFrame([(key("hey Boss"), "plain")], CACHE)
    seen = lambda prompt: f"[balloon 0] {'Boss -> Capo' in prompt} {'noir' in prompt} {prompt.startswith('Translate these English')} {prompt.endswith('[balloon 0] hey Boss')}"
    done, gained = translate.translate_pages(rows, cache, seen, "English", "Italian", glossaries=glossaries)
    assert said(done) == {("p", 0): "True True True True", ("q", 0): "plain", ("r", 0): "plain"}
    assert [r["key"] for r in gained.collect()] == [key("hey Boss", mark)]


def test_shorter_texts(spark):
    long = "some wide words " * 40
    rows = spark.createDataFrame([("p", "c", 0, "hello there you", None), ("p", "c", 1, "fine", None)], ROWS).selectExpr("*", "named_struct('x1', 0, 'y1', 0, 'x2', 200, 'y2', 200) AS bbox")
    client = lambda prompt: f"[balloon 0] {long}\n[balloon 1] bene"
    cache = spark.createDataFrame([], CACHE)
    done, gained = translate.translate_pages(rows, cache, client, "English", "Italian", shorter=lambda text, target, original: "much shorter", table={" ": 300})
    assert said(done) == {("p", 0): "much shorter", ("p", 1): "bene"}
    assert {r["pos"]: r["shortened"] for r in done.collect()} == {0: True, 1: False}
    assert {r["translation"] for r in gained.collect()} == {long.strip(), "bene"}
