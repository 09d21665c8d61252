"""How far the term use of sources diverges, within each language.

Counting: tasks count terms of their rows by (lang, source), so that a source with
most rows is summed before the shuffle. A term is kept for a language if at least
``LEAST_DOCS`` of its documents hold it. Kept terms are dealt into blocks by hash
and numbered within their block; a group's vector is one compressed piece a block.

Systolic rotation: the groups of a language take seats, ``SEAT_GROUPS`` to a seat.
Within each block, seats stay where they are as residents, and compressed copies
travel by the circle method of a round-robin tournament: every two seats meet in
exactly one round, at the seat of one of them. ``ROUNDS_AT_ONCE`` rounds run as
one job, so that no more copies than that are under way. A meeting gives the
values of both directions (they are equal, as the measure is symmetric); a seat
also meets itself once. There each group also meets its language's vector, and a
heap keeps its ``TOP`` best terms of the block.

All sums are integers: p and q are below 2^31, so the squares fit 64 bits.

Defined results: null text, lang and source are ''; a group without terms has its
pairs (all 0 where no term is kept) and no term rows; a language with one source
has no pairs; equal values rank by item; repeated rows count as documents of their
own; very long texts are whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_path, sized, written

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Kept terms of a block, on average; groups of a seat; rounds of a job.
BLOCK_TERMS, SEAT_GROUPS, ROUNDS_AT_ONCE = 1 << 13, 4, 8
#: Entries of a task's counts; at that many they are handed on.
HELD_TERMS = 200_000

#: ASCII bytes other than letters part terms; A-Z are lowered; bytes of other letters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; one row without a term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = {}
        holders: dict[tuple, Counter] = {}
        entries = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in words.items():
                terms = [None, *found]
                seen = holders[lang, source]
                columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *found.values()], [0, *(seen[t] for t in found)]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                key = (lang, source)
                if key not in words:
                    words[key], holders[key] = Counter(), Counter()
                before = len(words[key])
                terms = text.translate(_TABLE).split()
                words[key].update(terms)
                holders[key].update(set(terms))
                entries += len(words[key]) - before
                if entries > HELD_TERMS:
                    yield from handed()
                    words, holders, entries = {}, {}, 0
        yield from handed()

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    raw = map_batches(plain, count, "lang string, source string, term binary, n long, docs long")
    summed = raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))


def _div(n: str) -> Column:
    """p of the count in column ``n``, in whole numbers of any size."""
    return F.expr(f"cast((cast(`{n}` + 2 as decimal(20,0)) * {SCALE}) div cast(total + 2 * kept as decimal(20,0)) as bigint) + 1")


def _packed(index: pd.Series, share: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress(np.concatenate([np.diff(i, prepend=0), p]).astype("<u4").tobytes(), 1) for i, p in zip(index, share)])


def _opened(packed: bytes, size: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's dense vector of a block, and the places of the terms that occur."""
    raw = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    where = np.cumsum(raw[: len(raw) // 2])
    dense = np.full(size, rest, np.int64)
    dense[where] = raw[len(raw) // 2 :]
    return dense, where


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Audit:
    """The tables of one audit: kept terms, compressed vectors, seats."""

    def __init__(self, docs: DataFrame):
        self.counts = written(term_counts(docs), "terms")
        by_term = self.counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = written(by_term.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n"), "kept")
        sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
        langs = self.counts.select("lang").distinct().join(sizes, "lang", "left").na.fill(0, ["kept", "total"])
        self.langs = written(langs, "langs")
        per_lang = sized(self.langs, 64)
        block = F.pmod(F.xxhash64("term"), F.floor(F.col("kept") / BLOCK_TERMS) + 1).cast("int")
        number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
        self.terms = written(kept.join(per_lang, "lang").withColumn("block", block).withColumn("at", number), "numbered")
        self.blocks = written(self.terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size")), "blocks")
        self.groups = written(self._seated(), "groups")
        self.vectors = written(self._vectors(), "vectors")

    def _seated(self) -> DataFrame:
        """``lang, source, total, kept, seat, seats``; sources take seats in order of a hash.

        ``rest`` is p of a kept term that the group lacks. The number of seats is even, so one may stay empty.
        """
        held = self.counts.join(self.terms.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = self.counts.where("term is null").select("lang", "source").join(held, ["lang", "source"], "left").na.fill(0, ["total"])
        groups = groups.join(sized(self.langs.select("lang", "kept"), 64), "lang").withColumn("_none", F.lit(0))
        along = Window.partitionBy("lang")
        number = F.row_number().over(along.orderBy(F.xxhash64("source"), "source")) - 1
        needed = F.ceil(F.count("*").over(along) / SEAT_GROUPS)
        seats = F.greatest(needed + needed % 2, F.lit(2)).cast("int")
        rest = F.when(F.col("kept") > 0, _div("_none")).otherwise(0)
        return groups.withColumns({"seats": seats, "rest": rest, "seat": number.cast("int")}).withColumn("seat", F.col("seat") % F.col("seats")).drop("_none")

    def _vectors(self) -> DataFrame:
        """One compressed piece for each group and block of its language, and for each language itself (no source)."""
        pack = F.pandas_udf(_packed, "binary")
        by_term = self.counts.join(self.terms.select("lang", "term", "block", "at"), ["lang", "term"])
        of_groups = by_term.join(sized(self.groups, 128), ["lang", "source"]).withColumn("p", _div("n"))
        of_langs = self.terms.withColumn("p", _div("n")).select("lang", F.lit(None).cast("string").alias("source"), "block", "at", "p", F.lit(-1).alias("seat"), F.lit(0).alias("seats"), F.lit(0).cast("long").alias("rest"))
        entries = of_groups.select(*of_langs.columns).unionByName(of_langs)
        pieces = entries.groupBy("lang", "source", "block", "seat", "seats", "rest").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("terms"))
        packed = pieces.select("lang", "source", "block", "seat", "seats", "rest", F.col("terms.at").alias("at"), F.col("terms.p").alias("p"))
        packed = packed.withColumn("vector", pack("at", "p")).drop("at", "p")
        # A group without terms in a block still takes part in its meetings.
        places = self.groups.join(sized(self.blocks, 64), "lang").select("lang", "source", "block", "seat", "seats", "rest")
        nothing = F.unhex(F.lit(zlib.compress(b"").hex()))
        empty = places.join(packed.select("lang", "source", "block"), ["lang", "source", "block"], "left_anti").withColumn("vector", nothing)
        return packed.unionByName(empty).join(sized(self.blocks, 64), ["lang", "block"])

    def meetings(self) -> DataFrame:
        """``lang, source, item, value`` of all ordered pairs, and ``block, at, value`` of the best terms of each group."""
        spark = self.vectors.sparkSession
        path = shared_path(spark, "meetings")
        seats = self.groups.agg(F.max("seats")).first()[0] or 0
        residents = self.vectors.where("seat >= 0")
        itself = residents.unionByName(self.vectors.where("seat < 0").join(residents.select("lang", "block", F.col("seat").alias("_seat")).distinct(), ["lang", "block"]).withColumn("seat", F.col("_seat")).drop("_seat"))
        for first in range(-1, max(seats - 1, 0), ROUNDS_AT_ONCE):
            rounds = range(max(first, 0), min(first + ROUNDS_AT_ONCE, seats - 1))
            visitors = itself.withColumn("host", F.col("seat")) if first < 0 else None
            if len(rounds):
                travelling = residents.withColumn("round", F.explode(F.array(*map(F.lit, rounds)))).where("round < seats - 1")
                travelling = travelling.withColumn("host", host(F.col("seat"), F.col("seats"), F.col("round"))).where("host is not null").drop("round")
                visitors = travelling if visitors is None else visitors.unionByName(travelling)
            hosts = residents.groupBy("lang", "block", "seat")
            visits = visitors.select(*(F.col(c).alias(c) for c in ("lang", "block", "source", "rest", "vector")), F.col("host").alias("seat"))
            hosts.cogroup(visits.groupBy("lang", "block", "seat")).applyInPandas(_met, MET).write.mode("append").parquet(path)
        return spark.read.schema(MET).parquet(path)


MET = "lang string, source string, item string, block int, at int, value long"


def host(seat: Column, seats: Column, turn: Column) -> Column:
    """Where a seat travels in a round of the circle method; null if it stays.

    All seats but the last stand in a circle. In round r, r + i and r - i meet, at
    r + i; the seat at r meets the last one, at the last one in even rounds.
    """
    last = seats - 1
    behind = F.pmod(turn - seat, last)
    opposite = F.pmod(turn + behind, last)
    moves = F.when((behind >= 1) & (behind < seats / 2), opposite).when((behind == 0) & (turn % 2 == 0), last)
    return F.when(seat == last, F.when(turn % 2 == 1, F.pmod(turn, last))).otherwise(moves)


def _met(residents: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """One seat's meetings in a block: its groups with each group that visits, and with the language's vector."""
    out: list[tuple] = []
    if residents.empty or visitors.empty:
        return pd.DataFrame(out, columns=["lang", "source", "item", "block", "at", "value"])
    lang, block, size = residents["lang"].iloc[0], int(residents["block"].iloc[0]), int(residents["size"].iloc[0])
    home = set(residents["source"])
    own = [(s, *_opened(v, size, r)) for s, v, r in zip(residents["source"], residents["vector"], residents["rest"])]
    for source, packed, rest in zip(visitors["source"], visitors["vector"], visitors["rest"]):
        dense, _ = _opened(packed, size, rest)
        for mine, p, where in own:
            if source is None:
                at = where[p[where] > dense[where]]
                gains = _apart(p[at], dense[at])
                best = heapq.nsmallest(TOP, zip((-gains).tolist(), at.tolist()))
                out += [(lang, mine, None, block, i, -value) for value, i in best]
            elif source != mine:
                value = int(_apart(p, dense).sum())
                out.append((lang, mine, source, block, None, value))
                if source not in home:  # at home, the other one makes its own row
                    out.append((lang, source, mine, block, None, value))
    found = pd.DataFrame(out, columns=["lang", "source", "item", "block", "at", "value"])
    return found.astype({"at": "Int32"})


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of each two sources, and each source's own terms."""
    tables = Audit(docs)
    met = tables.meetings()
    pairs = met.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Where a language keeps no term there is nothing to meet over: all values are 0.
    bare = tables.groups.where("kept = 0").select("lang", "source")
    zeros = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("item != source").withColumn("value", F.lit(0).cast("long"))
    best = met.where("item is null").drop("item").join(tables.terms.select("lang", "block", "at", F.col("term").alias("item")), ["lang", "block", "at"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs.unionByName(zeros), "pair").unionByName(ranked(best, "term").where(F.col("rank") <= TOP))
