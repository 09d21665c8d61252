"""Quality classifier: a sparse ensemble of tree rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled texts; every
path from a root to a node is a conjunctive rule. A logistic model with lasso
penalty weighs the rules (and the winsorised statistics) and drops most of them.
What is left is compiled into one Spark column expression, so scoring the whole
table needs no model object. The sample, about ``SAMPLE`` rows by a share of the
hashes of ids, is all that tasks send and all that reaches the driver.

Defined results: null and empty texts have all statistics 0 and a score like any
other; a document with conflicting labels takes the smallest; null labels are
ignored; without labels of both kinds the score is the share of label 1 (one half
without any); repeated rows each get a score; null ids are kept; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, TREE_DEPTH, LEAF, RATE, BINS = 24, 3, 10, 0.3, 48
LASSO, STEPS = 1e-3, 400


def features() -> dict[str, Column]:
    """Statistics of a text, as expressions over ``textstats`` columns."""
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "log_words": F.ln(1 + F.col("n_words")),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / lines,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
        "distinct": F.col("n_distinct_words") / words,
    }


def _grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, path: tuple, found: dict, cuts: list) -> None:
    """Split rows by the largest fall in squared error, and record the path of each child."""
    if len(path) == TREE_DEPTH or len(rows) < 2 * LEAF:
        found[path] = rows
        return
    total, best = target[rows].sum(), (1e-9, None, None)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[rows, j], side="left")
        n = np.cumsum(np.bincount(bins, minlength=len(edges) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, weights=target[rows], minlength=len(edges) + 1))[:-1]
        fit = (n >= LEAF) & (len(rows) - n >= LEAF)
        if fit.any():
            gain = np.where(fit, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), 0) - total**2 / len(rows)
            k = int(gain.argmax())
            if fit[k] and gain[k] > best[0]:
                best = (float(gain[k]), j, float(edges[k]))
    _, j, cut = best
    if j is None:
        found[path] = rows
        return
    below = x[rows, j] <= cut
    _grow(x, target, rows[below], (*path, (j, "<=", cut)), found, cuts)
    _grow(x, target, rows[~below], (*path, (j, ">", cut)), found, cuts)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Rules from the paths of boosted trees, each once."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 2)[1:-1])) for j in range(x.shape[1])]
    margin, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        leaves: dict[tuple, np.ndarray] = {}
        _grow(x, y - p, np.arange(len(y)), (), leaves, cuts)
        for path, rows in leaves.items():
            margin[rows] += RATE * (y[rows] - p[rows]).sum() / max((p[rows] * (1 - p[rows])).sum(), 1e-6)
            for k in range(1, len(path) + 1):
                rules[path[:k]] = None
        margin = np.clip(margin, -8, 8)
    return list(rules)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] <= c) if op == "<=" else (x[:, j] > c) for j, op, c in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised. Columns of ``z`` in 0..1."""
    a = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(a.shape[1])
    w[0] = math.log(y.mean() / (1 - y.mean()))
    step = 4 / max(np.linalg.eigvalsh(a.T @ a / len(a))[-1], 1e-9)
    old, ahead = w, w
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        w = ahead - step * (a.T @ (p - y)) / len(y)
        w[1:] = np.sign(w[1:]) * np.maximum(np.abs(w[1:]) - step * penalty, 0)
        ahead = w + t / (t + 3) * (w - old)
        old = w
    return float(w[0]), w[1:]


def fit(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """Intercept and weighted rules, from about ``most`` labelled rows of ``stats``."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    found = features()
    sample = stats.join(known, "doc_id").select("y", F.xxhash64("doc_id").alias("h"), *(c.alias(k) for k, c in found.items()))
    share = min(1.0, most / max(1, sample.count()))
    rows = sample.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    data = np.array(sorted(map(tuple, rows), key=lambda r: r[1:]), float).reshape(-1, len(found) + 2)
    y, x = data[:, 0], data[:, 2:]
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return {"intercept": math.log(share / (1 - share)), "rules": []}
    rules = tree_rules(x, y)
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    scaled = np.clip((x - low) / np.maximum(high - low, 1e-9), 0, 1)
    intercept, w = lasso_logistic(np.column_stack([*(holds(r, x) for r in rules), scaled]).astype(float), y)
    names = list(found)
    return {
        "intercept": intercept,
        "rules": [(float(v), [(names[j], op, c) for j, op, c in r]) for r, v in zip(rules, w) if v],
        "lines": [(float(v), names[j], float(low[j]), float(max(high[j] - low[j], 1e-9))) for j, v in enumerate(w[len(rules):]) if v],
    }


def score(model: dict) -> Column:
    """The model as one expression over feature columns named as in ``features``."""
    total = F.lit(model["intercept"])
    for weight, rule in model["rules"]:
        tests = [(F.col(n) <= c) if op == "<=" else (F.col(n) > c) for n, op, c in rule]
        total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))
    for weight, name, low, width in model.get("lines", []):
        total = total + weight * F.least(F.greatest((F.col(name) - low) / width, F.lit(0.0)), F.lit(1.0))
    return 1 / (1 + F.exp(-total))


def scored(stats: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the rows of ``stats``."""
    rows = stats.withColumns({k: c for k, c in features().items()}).withColumn("score", score(model))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
