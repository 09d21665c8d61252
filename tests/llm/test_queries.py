"""Every registered query of the subpackage against a plain Python version."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import media
from folioflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in rows(spark, sf, "op1_chat_format")}
    assert found.keys() == turns.keys()
    for k, v in turns.items():
        v.sort()
        loss = "".join(t for _, role, t in v if role == "assistant")
        assert found[k]["n_turns"] == len(v)
        assert found[k]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in v))
        assert (found[k]["loss_chars"], found[k]["loss_sha256"]) == (len(loss), sha(loss))
        assert found[k]["formatted_chars"] >= sum(len(t) for _, _, t in v)


def test_media(spark, sf, docs):
    found = {r["doc_id"]: r for r in rows(spark, sf, "op2_media_columns")}
    assert found.keys() == docs.keys()
    for k, d in docs.items():
        data = (d["text"] or "").encode()
        payload = media.padded(data)
        r = found[k]
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        png = media.encode_png(payload, len(data))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        assert r["feature"] == media.feature_of(payload)


def base_spans(text):
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
        ("access", r"AKIA[A-Z0-9]+", 0),
        ("hex", r"[0-9a-f]+", 0),
    )
    out = []
    for i, (kind, pattern, flags) in enumerate(kinds):
        for m in re.finditer(pattern, text, flags | re.A):
            if len(m.group(2) if i == 0 else m.group()) >= (12, 18, 16)[i]:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets(spark, sf, docs):
    for r in rows(spark, sf, "op3_secret_scan"):
        base = base_spans(docs[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == sha(",".join(base))
        for k in ("assign", "access", "hex"):
            assert r[f"n_{k}"] == sum(x.startswith(k) for x in base)
        assert set(base) <= set(r["spans"].split(","))  | ({""} if not base else set())


def test_quality_rules(spark, sf, docs):
    found = {r["doc_id"]: r for r in rows(spark, sf, "op4_quality_rules")}
    assert found.keys() == docs.keys()
    for k, d in docs.items():
        text = d["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = list(zip(words, words[1:], words[2:]))
        often = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        r = found[k]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_jaccard(spark, sf, docs):
    sets = {}
    for k, d in docs.items():
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or ""))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, sf, "op5_ngram_jaccard_join")}
    assert found == {k: (len(s), find(k)) for k, s in sets.items()}


def test_language(spark, sf, docs):
    found = {r["doc_id"]: r for r in rows(spark, sf, "op6_language_id")}
    assert found.keys() == docs.keys()
    assert all(r["held_out"] == held_out(k) and 0 <= r["score"] <= 1 for k, r in found.items())
    judged = [k for k in docs if held_out(k)]
    right = sum(found[k]["lang_pred"] == docs[k]["lang"] for k in judged)
    assert right >= 0.95 * len(judged)


def test_packing(spark, sf, docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    encode = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, sf, "op7_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    for k, ps in pieces.items():
        ids = np.array([*encode.encode(docs[k]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    used = padded = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        used += at
        padded += at if at & (at - 1) == 0 else 4096
    assert padded <= used * 1.05


def test_licenses(spark, sf, docs):
    found = rows(spark, sf, "op8_license_scan")
    lines = {
        "MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    }
    for r in found:
        text = docs[r["doc_id"]]["text"]
        assert r["coverage"] >= 0.8 and 0 <= r["start"] < r["end"] <= len(text)
    wanted = {(k, name) for k, d in docs.items() for name, line in lines.items() if line in (d["text"] or "")}
    assert wanted <= {(r["doc_id"], r["license"]) for r in found}
    assert all(lines[r["license"]] in docs[r["doc_id"]]["text"] for r in found if r["license"] in lines and r["coverage"] == 1)


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        level = free / max(1, sum(w[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= over


def test_mixing(spark, sf, docs):
    sizes = {k: len(WORD.findall(d["text"] or "")) for k, d in docs.items()}
    by_source = Counter()
    for k, d in docs.items():
        by_source[d["source"]] += sizes[k]
    targets, taken = brute_targets(by_source), Counter()
    found = rows(spark, sf, "op9_source_mix")
    assert Counter(r["doc_id"] for r in found) == Counter(docs.keys())
    for r in found:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[source]
        assert r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    assert sorted(map(str, found)) == sorted(map(str, rows(spark, sf, "op9_source_mix")))


def test_classifier(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in rows(spark, sf, "op10_quality_classifier")}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held_out(k) for k, r in found.items())
    judged = [k for k in labels if held_out(k)]
    right = sum(found[k]["predicted"] == labels[k] for k in judged)
    assert right >= 0.9 * len(judged)
