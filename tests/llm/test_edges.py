"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, jaccard, langid, licenses, media, mixing, packing, ruleclf, rules, secrets, textstats

CLASHES = "id gone times copy spans text_hash row size shard n cls gid prefix label node score lang_pred kept media start n_words".split()
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 20_000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, LONG, None, "a"), (4, "one two three", "en", "b"), (4, "one two three", "en", "b"),
    (None, "password = abcdefghijklmnop", "en", "a"), (5, "one two three", "en", "b"), (6, " \n\t ", "en", "c"), (7, "12 34 !?", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1), (1, 0), (3, None), (4, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_chat(spark):
    schema = "conv_id long, seq long, message_id long, kind string, role string, text string, formatted string"
    log = [
        (1, 0, 0, "message", "user", "hi", "x"), (1, 1, 1, "message", "assistant", "a", "x"), (1, 2, 1, "delta", None, "b", "x"),
        (1, 3, 1, "regenerate", None, None, "x"), (1, 4, 1, "delta", None, "[INST] c", "x"), (1, 5, 0, "edit", None, "hello", "x"),
        (1, 6, 6, None, "user", None, "x"), (1, 7, 7, "message", "user", "gone", "x"), (1, 8, 7, "delete", None, None, "x"),
        (None, 0, None, "message", None, "<|im_end|>\n", "x"), (2, 0, 0, "other", "user", "no", "x"),
    ]
    events = spark.createDataFrame(log, schema)
    read = chat.read_back(chat.render(chat.fold_messages(events)))
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read.collect()}
    assert found == {1: [("user", "hello"), ("assistant", "[INST] c"), ("user", "")], None: [("", "<|im_end|>\n")]}
    assert {r["loss_text"] for r in read.where("conv_id = 1").collect()} == {"[INST] c"}
    assert chat.digests(chat.read_back(chat.render(chat.fold_messages(events.limit(0))))).count() == 0


def test_media(docs, none, tmp_path):
    found = media.media_features(media.store_texts(docs, str(tmp_path / "a"))).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    empty = hashlib.sha256(bytes(64)).hexdigest()
    assert {r["payload_sha256"] for r in found if r["doc_id"] in (1, 2)} == {empty}
    assert media.media_features(media.store_texts(none, str(tmp_path / "b"))).count() == 0


def test_secrets(docs, none):
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert found[None]["n_assign"] == 1 and found[None]["spans"] == "assign:0:27"
    assert found[1]["spans"] == found[3]["spans"] == "" and secrets.scan(docs).count() == len(ROWS)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert [r["text"] for r in clean.where("doc_id is null").collect()] == ["[redacted]"]
    assert secrets.scan(none).count() == secrets.redact(none).count() == 0


def test_rules(docs, none, labels):
    found = rules.judged(docs, labels).collect()
    assert len(found) == len(ROWS) and all(r["base_failed"] and not r["kept"] for r in found)
    assert rules.judged(none, labels.limit(0)).count() == 0


def test_jaccard(docs, none):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (6, 0, 6), (3, 8, 3), (4, 1, 4), (5, 1, 4), (7, 1, 7), (None, 1, None)} == found
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "None"])
    assert jaccard.link(none).count() == jaccard.deduplicated(none).count() == 0


def test_language(docs, none):
    found = langid.identify(docs, {"en": "one two three four " * 20, "xx": "alpha beta gamma delta " * 20})
    said = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert said[1] == said[2] == said[6] == said[7] == "und" and said[3] == "xx" and said[4] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.training_texts(none) == {} and langid.identify(none, {}).count() == 0


def test_packing(docs, none):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    found = packing.pack(docs, path).collect()
    assert {(r["length"], r["doc_tokens"]) for r in found if r["doc_id"] in (1, 2, 6)} == {(1, 1)}
    assert sum(r["length"] for r in found if r["doc_id"] == 3) == next(r["doc_tokens"] for r in found if r["doc_id"] == 3) > 160_000
    assert packing.pack(none, path).count() == 0


def test_licenses(spark, docs, none):
    assert licenses.scan(docs).count() == licenses.scan(none).count() == 0
    text = LONG + "Released under the MIT License." + LONG
    found = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r["license"], text[r["start"] : r["end"]]) for r in found] == [("MIT", "Released under the MIT License")] * 2


def test_mixing(docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert {r["target"] for r in found if r["doc_id"] == 2} == {0.0}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in ROWS}
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


def test_classifier(docs, none, labels):
    stats = textstats.statistics(docs)
    for known in (labels, labels.limit(0)):
        found = ruleclf.scored(stats, ruleclf.fit(stats, known)).collect()
        assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    empty = textstats.statistics(none)
    assert ruleclf.scored(empty, ruleclf.fit(empty, labels)).count() == 0


def test_language_learns_every_label(spark):
    def words(lang, n):  # a language's own 30 letters, words of 1 to 6 of them
        draw = random.Random(1000 * lang + n)
        return " ".join("".join(chr(0x4E00 + 30 * lang + draw.randrange(30)) for _ in range(draw.randint(1, 6))) for _ in range(n))

    # 40 languages of 1,200 letters; 38 has only titles, 39 only a book.
    texts = [(f"l{k:02}", words(k, 100 + i)) for k in range(38) for i in range(4)]
    texts += [("l38", words(38, 1 + i)) for i in range(30)] + [("l39", words(39, 4_000)), ("l40", "!"), (None, words(7, 90))]
    samples = langid.training_texts(spark.createDataFrame(texts, "lang string, text string"))
    assert sorted(samples) == [f"l{k:02}" for k in range(40)]
    assert len(samples["l39"]) > 12_000 and sum(x == "\n" for x in samples["l38"]) == 29
    labels, _ = langid.predict_batch([words(k, 50) for k in range(40)], tuple(sorted(samples.items())))
    assert labels == [f"l{k:02}" for k in range(40)]


def test_language_of_few_training_letters_does_not_win():
    english = "the cat sat on the mat and the dog lay by the fire while the rain fell on the roof " * 20
    assert langid.predict_batch(["the dog sat by the fire"], (("en", english), ("ok", "o")))[0] == ["en"]


def test_language_training_counts_texts_once(spark):
    rare = spark.range(300).select(F.lit("rare").alias("lang"), F.concat(F.lit("some words of text number "), F.col("id"), F.lit(" and more" * 25)).alias("text"))
    hot = spark.range(200_000).select(F.lit("rare").alias("lang"), F.concat(F.lit("one of the texts that all have " * 7), F.col("id") % 64).alias("text"))
    samples = langid.training_texts(rare.union(hot))
    assert len(samples["rare"]) >= langid.TRAIN_CHARS and len(set(samples["rare"].split("\n"))) == samples["rare"].count("\n") + 1


def test_licenses_full_edited_and_by_version():
    held = tuple(sorted(licenses.TEMPLATES.items()))
    found = lambda text: [(x[0], x[5]) for x in licenses.matches(text, held)]
    for name in ("MIT-text", "ISC", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0-text", "Unlicense-text", "Apache-2.0-text", "GPL-2-text", "GPL-3-text", "AGPL-3-text", "LGPL-2.1-text"):
        text = LONG[:900] + " " + licenses.TEMPLATES[name] + " " + LONG[:900]
        (match,) = licenses.matches(text, held)
        assert match[0] == name and match[5] == 1 and licenses._WORDS.findall(text[match[1] : match[2]]) == licenses._WORDS.findall(licenses.TEMPLATES[name])
    # Every 20th word replaced, and twelve words put in three times.
    words = licenses.TEMPLATES["GPL-3-text"].split()
    words[::20] = ["edited"] * len(words[::20])
    for at in (3000, 2000, 1000):
        words[at:at] = ["inserted"] * 12
    assert [x for x, _ in found(" ".join(words))] == ["GPL-3-text"]
    notice = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    )
    names = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
    for short, version in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
        assert found(notice.format(names[short], version)) == [(f"{short}-{version}-or-later-grant", 1)]
    unversioned = notice[: notice.index(", either")]
    assert [found(unversioned.format(names[k])) for k in names] == [[(f"{k}-notice", 1)] for k in names]


def test_packing_quoted_special_tokens():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = ["a text that quotes <|endoftext|> in it", "<|startoftext|>", "Glued<|EndOfText|>on", "a | b", "no token", None]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokenizer(path).texts(texts)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_jaccard_one_row_of_each_component(spark):
    """Rows decide, not ids: an id with two texts loses only the one that has a copy."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    schema = "doc_id long, text string"
    kept = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in jaccard.deduplicated(spark.createDataFrame(rows, schema)).collect())
    assert kept([(2, a), (4, a), (4, b)]) == [("2", a), ("4", b)]
    assert kept([(2, a), (2, a), (None, a), (9, b)]) == [("2", a), ("9", b)]
    assert kept([(None, a), (None, a), (None, b)]) == [("None", a), ("None", b)]
    assert len(kept([(1, ""), (1, ""), (2, "")])) == 3


def test_jaccard_clusters_against_brute_force(spark):
    """Chains of edited copies, heavily edited ones, subsets, and passages that unlike texts share."""
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10_000)}" for _ in range(n)]
    passage, texts = words(60), []
    for _ in range(6):
        base = words(draw.choice([3, 8, 40, 200]))
        texts.append(base)
        for _ in range(30):
            copy = list(draw.choice(texts[-5:]))
            for _ in range(draw.randrange(1 + len(copy) // 30)):
                copy[draw.randrange(len(copy))] = draw.choice(["x", "y", words(1)[0]])
            texts.append(copy if draw.random() < 0.8 else copy[: max(1, int(len(copy) * draw.uniform(0.6, 1)))])
    texts += [words(draw.randrange(1, 90)) + passage + words(draw.randrange(1, 90)) for _ in range(60)]
    draw.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.link(rows).collect()} == {(i, find(i)) for i in range(len(sets))}


def test_rules_against_brute_force(spark):
    """Cutoffs and verdicts recomputed from collected counts, and false rejections counted."""
    sf = "/root/testdata/sf0.1"
    stats, labels = textstats.statistics(spark.read.parquet(f"{sf}/documents.parquet")).cache(), spark.read.parquet(f"{sf}/labels.parquet")
    measured = stats.select("doc_id", rules.base_failed().alias("failed"), rules.stratum().alias("s"), rules.in_holdout().alias("h"), F.array(*(rules.cell(m) for m in rules.measures().values())).alias("c"))
    rows = {r["doc_id"]: r for r in measured.collect()}
    quality = {}
    for r in labels.collect():
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], 1), r["quality"])
    good = [rows[k] for k, q in quality.items() if q == 1 and not rows[k]["failed"]]

    def bound(bad, n, error):  # smallest share on a grid under which so few rejections are as rare as the error
        return next(p / 1e5 for p in range(1, 100_000) if sum(math.comb(n, i) * (p / 1e5) ** i * (1 - p / 1e5) ** (n - i) for i in range(bad + 1)) <= error)

    expected = {}
    for s in range(3):
        fit, holdout = ([r["c"] for r in good if r["s"] == s and r["h"] == h] for h in (False, True))
        for share in rules.LEVELS:
            cut = []
            for i in range(5):
                ok = [k for k in range(1, rules.CELLS + 1) if sum(c[i] >= k for c in fit) <= share * len(fit)]
                cut.append(min(ok))
            bad = sum(any(c[i] >= cut[i] for i in range(5)) for c in holdout)
            if bound(bad, len(holdout), 0.05 / 3) > rules.RISK:
                break
            expected[s] = cut
    chosen = rules.cutoffs(stats, labels)
    found = {s: [next((x["cell"] for x in chosen if x["stratum"] == s and x["rule"] == n), rules.CELLS) for n in rules.measures()] for s in expected}
    assert expected and found == expected
    kept = {r["doc_id"]: r["kept"] for r in rules.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).select("doc_id", "kept").collect()}
    rejected = lambda r: r["failed"] or r["s"] in expected and any(c >= k for c, k in zip(r["c"], expected[r["s"]]))
    assert all(kept[k] == (not rejected(r)) for k, r in rows.items())
    assert sum(not kept[r["doc_id"]] for r in good) <= rules.RISK * len(good)
    assert sum(not kept[k] for k, q in quality.items() if q == 0) >= 0.9 * sum(q == 0 for q in quality.values())


def test_hypergeometric_draws(spark):
    """Inversion over a grid of uniforms gives the exact law, also where odds are tiny and where the support is cut."""
    for left, right, quota in ((30, 50, 20), (2000, 2100, 2050), (3, 2, 4), (0, 5, 2), (5, 0, 2)):
        n = 4000
        split = f"array(struct({left}D AS left, {right}D AS right, {quota}D AS quota, (id + 0.5D) / {n} AS u))"
        found = Counter(r["k"] for r in spark.range(n).select(F.expr(f"{mixing.draws(split)}[0].left").alias("k")).collect())
        exact = {k: math.comb(left, k) * math.comb(right, quota - k) / math.comb(left + right, quota) for k in range(max(0, quota - right), min(left, quota) + 1)}
        assert all(abs(found[k] / n - p) <= 1.01 / n for k, p in exact.items()) and sum(found[k] for k in exact) == n


def test_mixing_shards_add_up(spark):
    """Shard quotas hold whole blocks and sum to the rest of each source; ties and equal sizes give the same result again."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    first, again = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "source", "target", "taken", "shard").collect())) for _ in range(2))
    assert first == again
    for source in {r[2] for r in first}:
        mine = [r for r in first if r[2] == source]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 1 and all(r[4] <= 3 * r[1] for r in mine)
    mixed = mixing.mixed(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    shard = {r[0]: r[5] for r in first}
    assert len({(shard[r["doc_id"]], r["p"]) for r in mixed}) == len({shard[r["doc_id"]] for r in mixed})  # a shard is in one partition
    run = [r["doc_id"] for r in mixed if shard[r["doc_id"]] == shard[mixed[0]["doc_id"]]]
    assert run != sorted(run)


def test_media_members_fail_alone(spark, tmp_path):
    """A flipped byte costs one member, which says so; the others are read."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 30).alias("text")).coalesce(1)
    stored = media.store_texts(docs, str(tmp_path / "a"))
    assert stored.where("error is null").count() == 40
    (archive,) = (f for f in (tmp_path / "a").rglob("*") if zipfile.is_zipfile(f))
    member = zipfile.ZipFile(archive).infolist()[7]
    data = bytearray(archive.read_bytes())
    data[member.header_offset + 30 + len(member.filename) + member.compress_size // 2] ^= 0xFF
    archive.write_bytes(data)
    found = stored.collect()
    assert len(found) == 40 and sum(r["error"] is not None for r in found) == 1
    assert all((r["media"] is None) == (r["error"] is not None) for r in found)


def test_licenses_again_and_again():
    held = tuple(sorted(licenses.TEMPLATES.items()))
    line = "Released under the MIT License."
    for text, n in ((f"{line}\n{line}", 2), (f"{line}\nx\ny\n{line}", 2), ("\n".join([line] * 300), 300)):
        assert [x[0] for x in licenses.matches(text, held)] == ["MIT"] * n
