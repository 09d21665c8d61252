"""The divergence audit against plain counting, on random groups and edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in holders[lang].items() if n >= 10)
        groups = {s: c for (k, s), c in counts.items() if k == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 10]
    return sorted(out)


def found(docs):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect())


@pytest.mark.parametrize(("sources", "seat", "rounds", "block"), [(1, 4, 8, 100), (2, 1, 1, 5), (7, 1, 2, 7), (9, 2, 8, 3), (12, 1, 3, 1000), (5, 8, 8, 2)])
def test_random_groups(spark, monkeypatch, sources, seat, rounds, block):
    monkeypatch.setattr(divergence, "SEAT_GROUPS", seat)
    monkeypatch.setattr(divergence, "ROUNDS_AT_ONCE", rounds)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rng = random.Random(sources)
    words = ["Über", "émile", "x1y", "A", "b", "ab", "AB", "c-d", "zz"] + [f"w{'abcdefgh'[i % 8]}{'ijkl'[i // 8]}" for i in range(30)]
    rows = [
        (i, " ".join(rng.choices(words[: rng.randrange(1, 40)], k=rng.randrange(0, 30))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}")
        for i in range(300)
    ]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "12 !?", "en", "b"), (4, "only once", "fr", "a"), (4, "only once", "fr", "b"), (5, "x" * 200_000 + " y", "en", None)]
    rows += [(6, "same same word", "es", s) for s in "aabbccc"] * 3 + [(7, "", "es", "d")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("k") for c in ("term", "n", "docs", "block", "seat", "kept")})
    assert found(docs) == brute(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_every_two_seats_meet_once(spark):
    for seats in (2, 4, 6, 10):
        rows = spark.range(seats).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(seats - 2))))
        met = rows.withColumn("host", divergence.host(F.col("id"), F.lit(seats), F.col("round"))).where("host is not null").collect()
        assert sorted(tuple(sorted((r["id"], r["host"]))) for r in met) == [(a, b) for a in range(seats) for b in range(a + 1, seats)]
        for turn in range(seats - 1):
            assert sorted(x for r in met if r["round"] == turn for x in (r["id"], r["host"])) == list(range(seats))
