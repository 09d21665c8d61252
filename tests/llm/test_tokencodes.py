"""Token codes against plain encoding: spans, random access, edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import tokencodes
from folioflow.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, ids, start = [], [], 0
    for doc_id, text in rows:
        found = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        ids += found
        start += len(found)
    return out, ids


@pytest.mark.parametrize(("n", "most"), [(1, 10), (5, 300), (513, 70_000), (5000, 2**32), (1024, 300), (512, 70_000), (512, 200), (2048, 1 << 17)])
def test_codes(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n).astype("<u4")
    ids[::3] = 0
    made = tokencodes.Codes.of(ids)
    codes = tokencodes.Codes(made.levels, made.marks, [r.tobytes() for r in made.ranks])
    assert [codes.at(i) for i in range(n)] == ids.tolist()
    for _ in range(300):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (codes.span(a, b) == ids[a:b]).all()


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    found = QUERIES["op11_token_codes"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(rows)[0])


@pytest.mark.parametrize("segment", [7, 1 << 18])
def test_random_access(spark, sf, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(tokencodes, "SEGMENT_IDS", segment)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2000")
    ids = plain([tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])[1]
    tokencodes.write_codes(docs.repartition(5), PATH, str(tmp_path / "codes"))
    wanted = [*random.Random(1).choices(range(len(ids)), k=500), 0, 0, len(ids) - 1, len(ids), -1, None]
    asked = spark.createDataFrame([(p, "x") for p in wanted], "position long, note string")
    found = tokencodes.lookup(spark, str(tmp_path / "codes"), asked).collect()
    assert len(found) == len(wanted) and all(r["note"] == "x" for r in found)
    assert all(r["token_id"] == (ids[r["position"]] if r["position"] is not None and 0 <= r["position"] < len(ids) else None) for r in found)


def test_edges(spark, tmp_path):
    long = "alpha beta <|endoftext|> gamma " * 20_000
    rows = [(1, None), (2, ""), (3, long), (4, "one two"), (4, "one two"), (None, "none"), (None, "other"), (-5, "x"), (6, " \n ")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, start long, shard int").repartition(3)
    tokencodes.write_codes(docs, PATH, str(tmp_path / "a"))
    found = sorted((tuple(r) for r in tokencodes.spans(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, -5, 1, 2, 3, 4, 4, 6]
    texts = {r[0]: r[1] for r in rows[:5]} | {-5: "x", 6: " \n "}
    by_hash = ["none", "other"] if found[0][2:] == plain([(None, "none")])[0][0][2:] else ["other", "none"]
    assert found == plain([*((None, t) for t in by_hash), *((k, texts[k]) for k in [-5, 1, 2, 3, 4, 4, 6])])[0]
    tokencodes.write_codes(docs.limit(0), PATH, str(tmp_path / "b"))
    assert tokencodes.spans(spark, str(tmp_path / "b")).count() == 0
    asked = spark.range(3).select(F.col("id").alias("position"))
    assert [r["token_id"] for r in tokencodes.lookup(spark, str(tmp_path / "b"), asked).collect()] == [None] * 3
