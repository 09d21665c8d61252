"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose statistic reaches a cutoff. Labelled documents are
split in two by a hash of the id. On the first half, good documents propose
cutoffs for each stratum (by length in words): at level k each rule's cutoff is
the smallest of a fixed grid that at most ``LEVELS[k]`` of them reach, so levels
reject more and more. On the other half, the holdout, the levels of a stratum are
tested in this order: a level passes while the exact (Clopper-Pearson) upper bound
of the share of good documents that any of its rules rejects stays within
``risk``; the last one before the first failure is taken. Testing in a fixed
order needs no correction within a stratum; between strata the confidence error
``delta`` is divided by their number (Bonferroni), so with probability 1 - delta
no stratum loses more than ``risk`` of its good documents. A stratum whose holdout
is too small for any level (below log(strata / delta) / risk good documents, about
135) rejects nothing but what fails the base rule.

Spark counts good documents by grid cell, then by level; only these two tables of
fixed size reach the driver. Verdicts are column expressions.

Defined results: null and empty texts have no words and fail the base rule;
repeated and conflicting labels make a document good only if all say so; null
labels are ignored; repeated rows each get a verdict; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textstats import statistics

LENGTH_STRATA = (150, 600)
CELLS = 256
LEVELS = (0.0, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.03)
RISK, DELTA = 0.03, 0.05


def measures() -> dict[str, Column]:
    """Statistics scaled so that 0..1 covers the range in which a cutoff may lie."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "upper": F.col("n_upper") / chars,
        "marks": F.least(F.col("n_marks") / words, F.lit(1.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.col("n_words") >= x).cast("int") for x in LENGTH_STRATA)


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return total * math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a binomial share, at confidence 1 - error."""
    if rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, rejected + 1, n - rejected) < 1 - error else (low, mid)
    return high


def good_ids(labels: DataFrame) -> DataFrame:
    """Documents that all their labels call good."""
    return labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def in_holdout() -> Column:
    """True for the half of labelled documents on which cutoffs are tested."""
    return F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)) == 1


def cell(measure: Column) -> Column:
    return F.least(F.floor(measure * CELLS), F.lit(CELLS - 1)).cast("int")


def proposals(counts: dict[tuple, int], strata: int, rules: int) -> dict[tuple, int]:
    """The cell from which (stratum, level, rule) rejects, from counts by (stratum, rule, cell); ``CELLS``: never."""
    out = {}
    for s in range(strata):
        for r in range(rules):
            n, above, k = sum(counts.get((s, r, c), 0) for c in range(CELLS)), 0, CELLS
            for level, share in enumerate(LEVELS):
                while n and k > 1 and above + counts.get((s, r, k - 1), 0) <= share * n:
                    k -= 1
                    above += counts.get((s, r, k), 0)
                out[s, level, r] = k
    return out


def passed(rejected: list[int], n: int, strata: int, risk: float, delta: float) -> int | None:
    """The last level before the first whose bound exceeds the risk; None if that is the first."""
    last = None
    for level, bad in enumerate(rejected):
        if not n or upper_bound(bad, n, delta / strata) > risk:
            break
        last = level
    return last


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[dict]:
    """The chosen cutoff of each (stratum, rule); strata and rules without one are left out."""
    found = measures()
    names, strata = list(found), len(LENGTH_STRATA) + 1
    good = stats.where(~base_failed()).join(good_ids(labels), "doc_id", "left_semi").select(
        stratum().alias("stratum"), in_holdout().alias("holdout"), F.array(*(cell(m) for m in found.values())).alias("cells")
    )
    cells = good.where("not holdout").select("stratum", F.posexplode("cells").alias("rule", "cell"))
    counts = {(r["stratum"], r["rule"], r["cell"]): r["n"] for r in cells.groupBy("stratum", "rule", "cell").agg(F.count("*").alias("n")).collect()}
    tried = proposals(counts, strata, len(names))

    def rejected(level: int) -> Column:
        tests = [
            (F.col("stratum") == s) & (F.get("cells", F.lit(r)) >= k) for (s, at, r), k in tried.items() if at == level and k < CELLS
        ]
        return F.count_if(F.coalesce(reduce(or_, tests, F.lit(False)), F.lit(False))).alias(f"level{level}")

    tested = good.where("holdout").groupBy("stratum").agg(F.count("*").alias("n"), *(rejected(i) for i in range(len(LEVELS)))).collect()
    chosen = []
    for row in sorted(tested, key=lambda r: r["stratum"]):
        level = passed([row[f"level{i}"] for i in range(len(LEVELS))], row["n"], strata, risk, delta)
        for i, name in enumerate(names):
            if level is not None and (k := tried[row["stratum"], level, i]) < CELLS:
                chosen.append({"stratum": row["stratum"], "rule": name, "cell": k, "level": level, "n_holdout": row["n"]})
    return chosen


def rejects(chosen: list[dict]) -> Column:
    """True for texts that a chosen cutoff rejects."""
    found = measures()
    return reduce(or_, [(stratum() == x["stratum"]) & (cell(found[x["rule"]]) >= x["cell"]) for x in chosen], F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Statistics of every text with ``base_failed`` and ``kept``."""
    stats = written(statistics(docs), "stats")
    failed = rejects(cutoffs(stats, labels, risk, delta))
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~failed})
