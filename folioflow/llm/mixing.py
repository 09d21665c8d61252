"""Mixing sources to target weights with a splitting tree, in DataFrame functions only.

Targets: sources weigh 5, 2, 1, repeating by code point, nulls last, and share
all words; none takes more than ``CAP`` times its own words, what is over goes to
the others by weight. That is water-filling: the capped sources are those with
the smallest words per weight, found by running sums over the small source table.

Draws: whole copies come first (the integer part of target / words). The rest is
a quota of words for each source, counted in blocks: a source's documents are dealt
to 2^DEPTH output shards by hash and, within a shard, permuted by another hash; a
block is the next ``1 / BLOCKS`` of the source's words in this order. A binary
tree splits the source's exact quota of blocks over the shards: at a node that
holds ``n`` blocks, of which ``l`` lie below its left child, the left child's quota
is drawn from the hypergeometric law of ``q`` draws without replacement, by exact
inversion in log space; the right child gets the rest. The quotas of the shards thus
are multivariate hypergeometric, add up exactly and never exceed what a shard
holds. Words beyond whole blocks fill up the shards in order. Each shard draws its
first blocks, which are disjoint; only the last document of a draw is taken in
part. All randomness is a hash of ids and a seed: reruns agree. ``mixed`` then
brings each output shard together and shuffles it locally.

A hot source is split over all shards; per source only an array of 2^DEPTH
numbers is gathered. Texts are never shuffled.

Defined results: null text has size 0; null source is a source of its own;
repeated rows are documents of their own; null ids are hashed as such; sources
without words get target 0; an empty table gives no rows; other columns are kept
by ``mix`` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sized, whole_text, word_count, written

WEIGHTS = (5, 2, 1)
CAP = 3
DEPTH = 8
SEED = 17
#: Blocks of a source, about; so many values a draw can have.
BLOCKS = 4096
#: ln(n!) for small n; above, Stirling's series.
SMALL_FACTORIALS = [math.lgamma(n + 1) for n in range(16)]


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows; one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("w", F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    most = cap * F.col("source_size")
    ratio = most / F.col("w")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    # Sources are capped as long as the level, if they were not, would be above their ratio.
    levels = weighed.withColumns({"level": level, "ratio": ratio})
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("z"), "source", "level"))).over(everything)
    return levels.withColumn("level", open_level["level"]).select(
        "source", "source_size",
        F.when(F.col("ratio") < F.col("level"), most.cast("double")).otherwise(F.coalesce(F.least(F.col("level") * F.col("w"), most.cast("double")), most.cast("double"))).alias("target"),
    )


def log_factorial(n: str) -> str:
    """SQL for ln(n!) of a whole number given as double, to 1e-11."""
    series = f"({n} + 0.5) * ln({n}) - {n} + {0.5 * math.log(2 * math.pi)!r}D + (1 / 12D - (1 / 360D - 1 / (1260D * {n} * {n})) / ({n} * {n})) / {n}"
    return f"if({n} < 16, element_at(array({', '.join(f'{x!r}D' for x in SMALL_FACTORIALS)}), int({n}) + 1), {series})"


def _log_choose(n: str, k: str) -> str:
    return f"({log_factorial(n)} - ({log_factorial(k)}) - ({log_factorial(f'({n} - {k})')}))"


def draws(splits: str) -> str:
    """SQL: of structs ``left, right, quota, u`` of doubles, an array of ``left, quota``, where ``left`` now is a
    hypergeometric draw: the blocks that come from the left when ``quota`` are drawn from left + right, by
    inversion of the uniform ``u``. Log odds follow from the smallest value's by the ratio of neighbours."""
    ends = "greatest(0D, s.quota - s.right) AS low, least(s.left, s.quota) AS high"
    first = f"{_log_choose('t.s.left', 't.low')} + {_log_choose('t.s.right', '(t.s.quota - t.low)')} - {_log_choose('(t.s.left + t.s.right)', 't.s.quota')}"
    ratio = "(x.t.s.left - k) * (x.t.s.quota - k) / ((k + 1) * (x.t.s.right - x.t.s.quota + k + 1))"
    found = f"""aggregate(
      sequence(int(x.t.low), int(x.t.high)), struct(0D AS sum, x.t.low AS k, x.log AS log),
      (acc, k) -> if(acc.sum >= x.t.s.u, acc, struct(acc.sum + exp(acc.log) AS sum, double(k) AS k, acc.log + if({ratio} > 0, ln({ratio}), 0D) AS log))
    ).k"""
    return f"""transform(
      transform(transform({splits}, s -> struct(s, {ends})), t -> struct(t, {first} AS log)),
      x -> struct(bigint(if(x.t.low >= x.t.high, x.t.low, {found})) AS left, bigint(x.t.s.quota) AS quota)
    )"""


def shard_quotas(leaves: DataFrame, aims: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """``source, shard, quota``: each source's partial words, as blocks split down the tree and words that remain.

    ``leaves``: ``source, shard, size``; ``aims``: ``source, source_size, target``.
    """
    rest = F.round(F.col("target")).cast("long") - copies() * F.col("source_size")
    rest = F.least(F.greatest(rest, F.lit(0)), F.col("source_size"))
    block = F.greatest(F.ceil(F.col("source_size") / BLOCKS), F.lit(1)).cast("long")
    add = lambda a, x: a + x
    tree = leaves.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "size"))).alias("m")).select(
        F.col("source").alias("s"),
        F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("words"),
    )
    tree = aims.join(tree, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({"rest": rest, "block": block})
    tree = tree.withColumn(f"n{depth}", F.transform("words", lambda w: F.floor(w / F.col("block"))))
    blocks = F.aggregate(f"n{depth}", F.lit(0).cast("long"), add)
    tree = tree.withColumn("q0", F.array(F.least(F.floor(F.col("rest") / F.col("block")), blocks)))

    def below(level: int) -> Column:
        """Blocks below every node of a level, as sums over the leaves."""
        span = 1 << (depth - level)
        part = lambda i: F.slice(f"n{depth}", i * span + 1, F.lit(span))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << level) - 1)), lambda i: F.aggregate(part(i), F.lit(0).cast("long"), add))

    tree = written(written(tree, "leaves").withColumns({f"n{level}": below(level) for level in range(1, depth)}), "nodes")

    def split(level: int) -> Column:
        """Quotas of a level's children; reads the level's quotas once."""
        uniform = f"(pmod(xxhash64(source, {level}, i, {seed}), {1 << 40}L) + 0.5D) / {1 << 40}D"
        children = ", ".join(f"double(element_at(n{level + 1}, 2 * i + {k})) AS {side}" for k, side in ((1, "left"), (2, "right")))
        splits = f"transform(q{level}, (q, i) -> struct({children}, double(q) AS quota, {uniform} AS u))"
        return F.expr(f"flatten(transform({draws(splits)}, x -> array(x.left, x.quota - x.left)))")

    for level in range(depth):  # from the root down
        tree = tree.withColumn(f"q{level + 1}", split(level))
    # What whole blocks leave is taken from the shards' other words, one shard after the other.
    drawn = F.aggregate(f"q{depth}", F.lit(0).cast("long"), add) * F.col("block")
    over = tree.withColumn("over", F.col("rest") - drawn).select(
        "source", "block", "over", F.posexplode(F.arrays_zip(F.col(f"q{depth}").alias("q"), F.col("words").alias("w"))).alias("shard", "x")
    )
    free = F.col("x.w") - F.col("x.q") * F.col("block")
    before = F.coalesce(F.sum(free).over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("over") - before, F.lit(0)), free)
    return over.select("source", "shard", (F.col("x.q") * F.col("block") + more).alias("quota"))


def copies() -> Column:
    """Whole copies of every document: the integer part of target / words."""
    return F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, shard, position`` of each row.

    ``shard`` is the output shard, ``position`` a hash that shuffles its rows locally.
    """
    rows = docs.select(
        "doc_id", "source", word_count(whole_text()).alias("size"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << depth)).cast("int").alias("shard"),
    )
    rows = written(rows, "sizes")
    aims = targets(rows, weights, cap)
    quotas = shard_quotas(rows.groupBy("source", "shard").agg(F.sum("size").alias("size")), aims, depth, seed)
    plan = written(
        quotas.alias("q").join(aims.alias("a"), F.col("q.source").eqNullSafe(F.col("a.source")))
        .select("q.source", "shard", "quota", "source_size", "target"), "quotas"
    )
    drawn_by = Window.partitionBy("d.source", "d.shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(drawn_by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.alias("d").join(
        plan.alias("p"), (F.col("d.shard") == F.col("p.shard")) & F.col("d.source").eqNullSafe(F.col("p.source"))
    )
    part = F.least(F.greatest(F.col("quota") - before, F.lit(0)), F.col("size"))
    return joined.select(
        "doc_id", "size", "d.source", "source_size", "target",
        (copies() * F.col("size") + part).cast("long").alias("taken"),
        F.col("d.shard").alias("shard"), F.xxhash64("doc_id", F.lit(seed + 2)).alias("position"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as its taken words, in whole copies, round to.

    Only the last document of a draw is taken in part; rounding keeps it whole or
    leaves it out. Rows with one id share their copies. All columns stay. The rows
    of an output shard come together, in the order of a hash of id and copy.
    """
    key, times, copy, shard = (fresh(c, docs) for c in ("id", "times", "copy", "shard"))
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(
        F.rint(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(times), F.first("shard").alias(shard)
    )
    plan = written(plan.where(F.col(times) > 0), "plan")
    rows = docs.join(sized(plan, 40), F.col("doc_id").eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.repartition(shard).sortWithinPartitions(shard, F.xxhash64(key, copy, F.lit(SEED + 2))).select(*docs.columns)
