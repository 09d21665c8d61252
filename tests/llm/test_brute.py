"""Language ID, license scans, the classifier and the pipeline against plain versions, row by row."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from folioflow.llm import langid, licenses, ruleclf, textstats
from folioflow.llm.common import is_held_out, written

from .test_queries import WORD, base_spans, brute_targets


def letters(text):
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))


def phrases(part, train):
    """Phrases of the greedy parse of a block into its longest matches, and letters that the training text lacks."""
    count, new, phrase = 1, 0, ""
    for c in part:
        if phrase + c in train:
            phrase += c
        else:
            count, new, phrase = count + 1, new + (c not in train), c if c in train else ""
    return count, new


def parsed(text, samples):
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    trains = {k: letters(v) for k, v in samples.items()}
    spelled = math.log2(len(set("".join(trains.values()))) + 1)
    said = letters(text)
    costs = {}
    for k, train in trains.items():
        found = [phrases(said[i : i + langid.BLOCK], train) for i in range(0, len(said), langid.BLOCK)]
        costs[k] = sum(n * math.log2(max(2, len(train))) + new * spelled for n, new in found) / len(said)
    best = min(sorted(costs), key=lambda k: costs[k])
    weight = {k: math.exp(-langid.SHARPNESS * (c - costs[best])) for k, c in costs.items()}
    return best, weight[best] / sum(weight.values())


def test_language_by_substrings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.training_texts(docs.where(~is_held_out()))
    texts = [r["text"] for r in docs.where("n_chars < 1500").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choices("abcdeé ñß漢", k=n)) for n in (1, 2, 5, 60, 511, 512, 513, 1100)] + [None, "", "12 !", "a", "ÄÖ\nx", "q" * 600]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    for r in langid.identify(rows, samples).collect():
        label, score = parsed(texts[r["doc_id"]], samples)
        assert (r["lang_pred"], r["score"]) == (label, pytest.approx(score, rel=1e-9)), texts[r["doc_id"]]


def test_language_ties(spark):
    samples = {"b": "one two three", "a": "one two three", "c": "uno due tre"}
    rows = spark.createDataFrame([(1, "two one"), (2, "due"), (3, "xyz")], "doc_id int, text string")
    found = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(rows, samples).collect()}
    assert found[1][0] == "a" and found[2][0] == "c"
    assert found == {k: (parsed(t, samples)[0], round(parsed(t, samples)[1], 9)) for k, t in ((1, "two one"), (2, "due"), (3, "xyz"))}


def best_matched(template, words):
    """Matched words of the best local alignments (match 2, anything else -1): the most among those of the best score."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        now = [(0, 0)]
        for j, w in enumerate(words):
            hit = (above[j][0] + 2, above[j][1] + 1) if t == w else (above[j][0] - 1, above[j][1])
            cell = max(hit, (above[j + 1][0] - 1, above[j + 1][1]), (now[j][0] - 1, now[j][1]))
            now.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, now[-1])
        above = now
    return best[1]


def test_licenses_by_full_alignment(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = {f"T{k}": " ".join(rng.choices(vocabulary, k=n)) for k, n in enumerate((12, 30, 60))}  # an edited copy keeps four words in a row, so a fingerprint
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 30))
        name = rng.choice([*templates, None])
        if name:
            body = templates[name].split()
            for _ in range(rng.randrange(0, max(2, len(body) // 6))):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([[], ["odd"], [body[at], "new"]])
            words += body + rng.choices(vocabulary, k=rng.randrange(0, 30))
        docs.append((i, " ".join(words).title() if i % 2 else "\n".join(words)))
    docs += [(900, None), (901, ""), (902, templates["T0"]), (902, templates["T0"]), (903, templates["T1"] + " . " + templates["T1"])]
    found = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id int, text string"), templates).collect():
        found[r["doc_id"]].append(r)
    texts, hits = dict(docs), 0
    for i, text in texts.items():
        words = re.findall(r"w\d+|odd|new", (text or "").lower())
        best = {k: best_matched(t.split(), words) for k, t in templates.items()}
        for r in found[i]:
            body = templates[r["license"]].split()
            inside = re.findall(r"w\d+|odd|new", text[r["start"] : r["end"]].lower())
            assert r["matched_words"] <= best_matched(body, inside) and r["template_words"] == len(body)
            assert r["coverage"] == r["matched_words"] / len(body) >= licenses.COVERAGE
        # every template that a full alignment covers is found, or what was found there has more matched words
        for k, n in best.items():
            if n >= licenses.COVERAGE * len(templates[k].split()):
                hits += 1
                assert any(r["license"] == k and r["matched_words"] == n or r["matched_words"] >= n for r in found[i]), (i, k, n)
    assert hits > 60 and [len(found[k]) for k in (900, 901, 902, 903)] == [0, 0, 2, 2]


def test_license_ties(spark):
    same = "alpha beta gamma delta epsilon zeta"
    found = licenses.scan(spark.createDataFrame([(1, f"x {same} y")], "doc_id int, text string"), {"B": same, "A": same, "C": same + " eta"}).collect()
    assert [(r["license"], r["start"], r["end"]) for r in found] == [("A", 2, 2 + len(same))]


def plain_features(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    count = lambda pattern: len(re.findall(pattern, text))
    n, c, k = max(1, len(words)), max(1, chars), max(1, len(lines))
    return {
        "log_words": math.log(1 + len(words)), "word_length": chars / n, "symbols": count(r"[#*$%&|<>]") / c, "dup_lines": (len(lines) - len(set(lines))) / k,
        "repeats": len(repeated) / n, "line_words": len(words) / k, "upper": count("[A-Z]") / c, "digits": count("[0-9]") / c, "marks": count("[!?]") / n,
        "distinct": len(set(words)) / n,
    }


def test_classifier_rule_by_rule(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "A! 1\nA! 1"), (-4, "\x0b \x0c")], "doc_id long, text string")
    stats = written(textstats.statistics(docs.unionByName(extra)), "stats")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~is_held_out())
    model = ruleclf.fit(stats, labels)
    assert model["rules"] or model["lines"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.unionByName(extra).collect()}
    for r in ruleclf.scored(stats, model).collect():
        f = plain_features(texts[r["doc_id"]])
        total = model["intercept"]
        for weight, rule in model["rules"]:
            total += weight * all(f[n] <= c if op == "<=" else f[n] > c for n, op, c in rule)
        for weight, name, low, width in model["lines"]:
            total += weight * min(max((f[name] - low) / width, 0), 1)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [prose(rng.randrange(20, 120)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "a") for i in range(8)]  # exact copies
    rows += [(120 + i, base[i] + " tail", "en", "b") for i in range(8) if len(base[i].split()) > 40]  # near copies
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 34 !?", None, "b"), (203, "漢字 かな", None, "a"), (None, prose(30), "en", None)]
    rows += [(210, prose(20) + " password = abcdefghij1234567 " + prose(20), "en", "a"), (211, prose(30) + " AKIA" + "Q" * 20, "de", "b"), (3, base[3], "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    held, table = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, str(tmp_path)), name)
        assert table.columns == docs.columns
        held.append([tuple(r) for r in table.collect()])
    spoken, single, clean, mix = held
    assert Counter(r[:2] for r in spoken) == Counter(r[:2] for r in rows if any(map(str.isalpha, r[1] or "")))
    # one row of every component stays, the first by id
    sets = [shingles(r[1]) for r in spoken]
    root = list(range(len(spoken)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(spoken)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(spoken):
        groups[find(i)].append(r)
    first = lambda group: min(group, key=lambda r: (r[0] is None, r[0] or 0))[0]
    assert sorted(map(str, (r[0] for r in single))) == sorted(str(first(g)) for g in groups.values())
    assert all(r in spoken for r in single)
    # secrets go, all else stays
    before, after = {r[0]: r for r in single}, {r[0]: r for r in clean}
    assert before.keys() == after.keys() and {210, 211} <= before.keys()
    for k, r in after.items():
        assert not base_spans(r[1]) and r[4] == len(r[1])
        assert (r[:4] == before[k][:4]) == (not base_spans(before[k][1])) or "redacted" in r[1]
    # the mix comes near its targets; whole documents, three times at most
    sizes = {r[0]: len(WORD.findall(r[1])) for r in clean}
    by_source, drawn, times = Counter(), Counter(), Counter(r[0] for r in mix)
    for r in clean:
        by_source[r[3]] += sizes[r[0]]
    for r in mix:
        assert r == after[r[0]]
        drawn[r[3]] += sizes[r[0]]
    for source, target in brute_targets(by_source).items():
        assert abs(drawn[source] - target) <= by_source[source] / 2  # every document is rounded to whole copies
    assert max(times.values()) <= 3
    # packing: every token of every drawn copy, once
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for r in mix:
        wanted[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed, filled = Counter(), Counter()
    for p in pieces:
        packed[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]] += p["length"]
    assert packed == wanted and max(filled.values()) <= 4096
