"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded training text gives, from any
position of a text, the longest match with the training text. A text is parsed
greedily into such longest matches; the language whose automaton needs the
fewest phrases, normalised by log2 of its training length, wins. A letter that
the language's training text lacks costs its spelling besides, so that a language
of few training letters does not win by its cheap phrases.

Texts are parsed in blocks of ``BLOCK`` characters, so that all blocks of a batch
and many languages advance together as numpy lanes through packed transition
tables; a block border ends a phrase in every language alike. Whole texts are
parsed. Characters are lower-cased; runs of anything but letters are one space.
Every letter of any training text is told apart.

Training: every label is learned, from distinct texts with a letter, of any length,
until ``TRAIN_CHARS`` characters are reached. Texts are cut into pieces of ``PIECE``
characters; first come the first pieces of texts of ``SHORT`` characters or more,
then their second pieces and so on, then shorter texts; within these in the order
of a hash of the text. These are the only rows that reach the driver.

Defined results: ``und`` with score 0 for a null text or one without a letter;
ties go to the language first in code-point order; without any training text all
texts get ``und``; repeated rows each get a result; null ids are kept; empty
tables give no rows; other columns are not read in predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, worker_model

TRAIN_CHARS = 24_000
SHORT, PIECE = 200, 4_000
BLOCK = 512
#: Languages that are parsed at once.
TOGETHER = 64
#: Letters that are parsed at once.
LANES = 1 << 22
SHARPNESS = 8.0


def training_texts(docs: DataFrame, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """Training text of each language, from ``text`` and ``lang`` of ``docs``."""
    u = F.xxhash64("text").bitwiseAND((1 << 63) - 1)
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", u.alias("u"), F.char_length("text").alias("n"))
    # Pieces are taken step by step; a step holds those of one rank whose hashes have the same number of bits.
    most = -(-chars // PIECE)
    rank = F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.ceil(F.col("n") / PIECE).cast("int")) - 1))
    step = F.when(F.col("n") < SHORT, most).otherwise(F.col("piece")) * 64 + F.ceil(F.log2(F.col("u") + 1.0)).cast("int")
    size = F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE)
    cut = lambda rows: rows.withColumn("piece", rank).withColumns({"step": step, "size": size})
    sizes = cut(fit.select("lang", "u", "n").distinct()).groupBy("lang", "step").agg(F.sum("size").alias("size"))
    # Up to its last step a language has the characters wanted, or all it has.
    last: dict[str, int] = {}
    have: dict[str, int] = {}
    for r in sorted(sizes.collect(), key=lambda r: r["step"]):
        if have.get(r["lang"], 0) < chars:
            last[r["lang"]] = r["step"]
            have[r["lang"]] = have.get(r["lang"], 0) + r["size"]
    if not last:
        return {}
    lasts = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last int")
    some = cut(fit.join(F.broadcast(lasts), "lang")).where("step <= last").select(
        "lang", "u", "piece", "step", "size", F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text")
    ).dropDuplicates(["lang", "u", "piece"])
    upto = Window.partitionBy("lang").orderBy("step", "u").rowsBetween(Window.unboundedPreceding, -1)
    rows = some.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") < chars)
    texts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["before"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in sorted(texts.items())}


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other characters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    plain = np.where(_is_letter(points), points, 32)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    return plain[keep]


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def _is_letter(points: np.ndarray) -> np.ndarray:
    return _letter_table()[points]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all factors of ``symbols``."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in follow[p]:
            follow[p][s] = now
            p = link[p]
        if p >= 0:
            q = follow[p][s]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(s) == q:
                    follow[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


def packed(follow: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, owner, to``: the transition of a state by a symbol lies in slot ``base[state] + symbol``,
    modulo the size (a power of two), if that slot's owner is the state; else there is none."""
    size = 1 << max(2 * sum(map(len, follow)), *follow[0]).bit_length()
    order = sorted(range(len(follow)), key=lambda x: -len(follow[x]))
    while True:
        owner, to, base, at = [-1] * size, [0] * size, [0] * len(follow), 1
        for state in order:
            edges, tries = follow[state], 0
            while tries < size and any(owner[at + s & size - 1] >= 0 for s in edges):
                at, tries = (at * 5 + 1) & size - 1, tries + 1  # visits all places
            if tries == size:
                break
            base[state] = at
            for s, goal in edges.items():
                owner[at + s & size - 1], to[at + s & size - 1] = state, goal
        else:
            break
        size *= 2
    return np.array(base, np.int32), np.array(owner, np.int32), np.array(to, np.int32)


class Tables:
    """Packed tables of some languages one after another; each language's size is kept."""

    def __init__(self, automata: list[list[dict[int, int]]], symbols: int):
        parts = [packed(a) for a in automata]
        states, slots = [len(p[0]) for p in parts], [len(p[1]) for p in parts]
        self.first = np.cumsum([0, *states[:-1]]).astype(np.int32)
        self.start = np.cumsum([0, *slots[:-1]]).astype(np.int64)
        self.mask = np.array(slots, np.int64) - 1
        self.base = np.concatenate([p[0] for p in parts])
        self.owner = np.concatenate([np.where(p[1] < 0, -1, p[1] + f) for p, f in zip(parts, self.first)]).astype(np.int32)
        self.to = np.concatenate([p[2] + f for p, f in zip(parts, self.first)]).astype(np.int32)
        # Where a phrase that begins with a symbol leads; a symbol that a language lacks stays at the start.
        root = self.follow(self.first[None, :], np.arange(symbols))
        self.lacks, self.again = root < 0, np.where(root < 0, self.first[None, :], root)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, -1 for none. A row for each symbol, a column for each language."""
        slot = (self.base[state] + symbol[:, None] & self.mask) + self.start
        return np.where(self.owner[slot] == state, self.to[slot], -1)


def _build(samples: tuple[tuple[str, str], ...]) -> tuple[list[str], np.ndarray, list[Tables], np.ndarray, float]:
    """Names, symbol of each code point, tables of ``TOGETHER`` languages each, bits a phrase and a spelled letter."""
    texts = {k: _letters(v) for k, v in samples}
    symbol = np.zeros(0x110000, np.int32)  # 0: unknown
    known = np.unique(np.concatenate(list(texts.values())))
    symbol[known] = np.arange(1, len(known) + 1)
    automata = [suffix_automaton(symbol[v].tolist()) for v in texts.values()]
    bits = np.log2([max(2, len(v)) for v in texts.values()])
    return list(texts), symbol, [Tables(automata[i : i + TOGETHER], len(known) + 1) for i in range(0, len(automata), TOGETHER)], bits, float(np.log2(len(known) + 1))


def phrases(blocks: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Phrases, and letters new to it, of each block in each language. ``blocks``: symbols, -1 after a block's end;
    rows in falling order of their length."""
    n, first = len(blocks), tables.first
    count, new = np.zeros((2, n, len(first)), np.int64)
    state = np.repeat(first[None, :], n, axis=0)
    alive = (blocks >= 0).sum(axis=0)
    for i in range(blocks.shape[1]):
        k = alive[i]
        if not k:
            break
        s = blocks[:k, i]
        to = tables.follow(state[:k], s)
        ends = to < 0
        state[:k] = np.where(ends, tables.again[s], to)  # a new phrase begins with this letter
        count[:k] += ends
        new[:k] += tables.lacks[s]
    return count + 1, new


def predict_batch(texts: list, samples: tuple) -> tuple[list, list]:
    """Language and score of each text."""
    if not samples:
        return ["und"] * len(texts), [0.0] * len(texts)
    names, symbol, tables, bits, spelled = worker_model(("languages", samples), lambda: _build(samples))
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    rows = [symbol[_letters(t)] if t else np.zeros(0, np.int32) for t in texts]
    owner = np.repeat(np.arange(len(rows)), [-(-len(r) // BLOCK) for r in rows])
    if not len(owner):
        return labels, scores
    blocks = np.full((len(owner), BLOCK), -1, np.int32)
    at = 0
    for r in rows:
        n = -(-len(r) // BLOCK)
        blocks.reshape(-1)[at * BLOCK : at * BLOCK + len(r)] = r
        at += n
    order = np.argsort(-(blocks >= 0).sum(axis=1), kind="stable")
    blocks = blocks[order]
    costs = np.zeros((len(owner), len(names)))
    count, new = (np.concatenate(x, axis=1) for x in zip(*(phrases(blocks, t) for t in tables)))
    costs[order] = count * bits + new * spelled
    total = np.zeros((len(rows), len(names)))
    np.add.at(total, owner, costs)
    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            cost = total[i] / len(rows[i])
            weight = np.exp(-SHARPNESS * (cost - cost.min()))
            best = int(cost.argmin())
            labels[i], scores[i] = names[best], float(weight[best] / weight.sum())
    return labels, scores


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs``; other columns all stay, those of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    frozen = tuple(sorted(samples.items()))
    names = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels, scores = batch.column("text").to_pylist(), [], []
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size >= LANES:
                    for out, found in zip((labels, scores), predict_batch(held, frozen)):
                        out += found
                    held, size = [], 0
            for out, found in zip((labels, scores), predict_batch(held, frozen)):
                out += found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(docs, of, schema)
