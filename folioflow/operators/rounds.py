"""Work that goes on in rounds: tables between rounds, and greedy matching."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in ``spark.checkpoint.dir``, read back: the next round starts from files.

    Only a local session may have no such folder; it gets a temporary one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        _own[app] = folder
    path = f"{folder.rstrip('/')}/folio-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys to as many tasks as the session shuffles to.

    Spark joins small partitions into few tasks by their bytes; where a small row means
    long work in its task, a fixed number keeps the tasks apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Pairs of a key up to which they are matched in one pass over their sorted list.
FOLD = 4096


def greedy_matching(pairs: DataFrame, by: list[str], a: str, b: str, cost: str) -> DataFrame:
    """One-to-one matching within each key ``by``: pairs in rising order of (cost, a, b), each taken if both sides are free.

    Costs and sides that are null match nothing. Keys of up to ``FOLD`` pairs go through
    their list; larger ones go in rounds.
    """
    given = pairs.select(*by, a, b, cost).dropna(subset=[a, b, cost]).distinct()
    many = given.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FOLD).select(*by)
    if many.isEmpty():
        return _folded(given, by, a, b, cost)
    many = written(many, "many")
    same = _every([given[c].eqNullSafe(many[c]) for c in by])
    few = _folded(given.join(many, same, "left_anti"), by, a, b, cost)
    return few.unionByName(_matched_in_rounds(given.join(many, same, "left_semi"), by, a, b, cost))


def _folded(given: DataFrame, by: list[str], a: str, b: str, cost: str) -> DataFrame:
    """Each key's pairs as a sorted list, gone through once."""
    lists = given.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(cost).alias("c"), F.col(a).alias("a"), F.col(b).alias("b")))).alias("_p"))
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["a"] == p["a"]) | (t["b"] == p["b"]))
    taken = F.aggregate("_p", F.slice("_p", 1, 0), lambda taken, p: F.when(free(taken, p), F.array_append(taken, p)).otherwise(taken))
    return lists.select(*by, F.explode(taken).alias("_t")).select(*by, F.col("_t.a").alias(a), F.col("_t.b").alias(b), F.col("_t.c").alias(cost))


def _matched_in_rounds(given: DataFrame, by: list[str], a: str, b: str, cost: str) -> DataFrame:
    """Each round takes the pairs that come first for both of their sides.

    Every such pair would also be taken by going through the list, and what it excludes
    is left out before the next round. So the result is that of the list, for all keys
    at once.
    """
    order = (cost, a, b)
    left = written(given, "pairs")
    taken = left.limit(0)
    while not left.isEmpty():
        rank = lambda side: F.row_number().over(Window.partitionBy(*by, side).orderBy(*order))
        first = written(left.withColumns({"_a": rank(a), "_b": rank(b)}).where("_a = 1 and _b = 1").drop("_a", "_b"), "taken")
        taken = taken.unionByName(first)
        free = left
        for side in (a, b):
            used = first.select(*by, side)
            same = [free[c].eqNullSafe(used[c]) for c in (*by, side)]
            free = free.join(used, _every(same), "left_anti")
        left = written(free, "pairs")
    return taken


def _every(tests: list):
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return found


def unmatched(wanted: DataFrame, taken: DataFrame, by: list[str], side: str) -> DataFrame:
    """Members of ``wanted`` that the matching left without a partner: a matching with any is incomplete."""
    return wanted.select(*by, side).distinct().join(taken.select(*by, side), [*by, side], "left_anti")
