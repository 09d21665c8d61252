"""Secret scans: pattern spans, and credential parts linked by an interval join.

Strong kinds are reported wherever they match. Weak kinds (a short assigned
value, a user or client identifier, an endpoint) are reported only if a part
that complements them starts within ``window`` code points in the same text:
a secret needs an identifier or an endpoint, an identifier or an endpoint needs
a secret. The interval join is a window over (row, start) with a range frame, so
a text with many parts makes no pairs; only spans are shuffled, never texts.

Spans are half-open and count code points. All expressions are built-in ones.

Defined results: null or empty text has no spans; repeated rows each get a
result; null ids are kept; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sized, whole_text, written

#: kind: (pattern, group holding the value, fewest characters of it, role, strong).
#: Fixed patterns; assign keeps its open-ended value since a short match must still consume text.
_KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = f"{_KEYWORD}({_VALUE}+)"
KINDS = {
    "assign": (_ASSIGN, 1, 12, "secret", True),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "identifier", True),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "secret", True),
    "short_assign": (_ASSIGN, 1, 4, "secret", False),
    "user": (r"""(?i:user_?name|user_?id|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 3, "identifier", False),
    "endpoint": (r"(?:https?://[A-Za-z0-9./_:?&=%-]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b)", 0, 7, "endpoint", False),
}
NAMES = list(KINDS)
WINDOW = 200


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind, in order: gap before, length, length of the value."""
    pattern, group, _, _, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern)
    rows = F.transform(
        F.arrays_zip(whole.alias("w"), values.alias("v")),
        lambda m, i: F.struct(
            F.lit(NAMES.index(kind)).alias("kind"), i.alias("i"),
            F.char_length(F.get(pieces, i)).alias("gap"), F.char_length(m["w"]).alias("n"), F.char_length(m["v"]).alias("v"),
        ),
    )
    # The test first: most texts have no match, and need neither pieces nor values.
    return F.when(text.rlike(pattern), rows)


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per span or, for a text without any, per text:
    ``row, doc_id, text_hash, kind, start, end, reported`` (kind null: no span)."""
    scanned = [k for k in NAMES if k != "short_assign"]  # shares the matches of assign
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,v:int>>")
    found = F.flatten(F.array(*(F.coalesce(_found(F.col("text"), k), none) for k in scanned)))
    rows = text.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(found).alias("m"))
    rows = rows.select("row", "doc_id", "text_hash", "m.*").repartition("row")
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(along)).withColumn("start", F.col("end") - F.col("n"))
    assign, short = NAMES.index("assign"), NAMES.index("short_assign")
    kind = F.when((F.col("kind") == assign) & (F.col("v") < KINDS["assign"][2]), F.lit(short)).otherwise(F.col("kind"))
    least = F.element_at(F.lit([KINDS[k][2] for k in NAMES]), F.col("kind") + 1)
    placed = placed.withColumn("kind", kind)
    placed = placed.withColumn("kind", F.when(F.col("v") >= least, F.col("kind")))  # too short: no span
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-window, window)
    role = lambda r: F.max(F.col("kind").isin([i for i, k in enumerate(NAMES) if KINDS[k][3] == r])).over(near)
    has = {r: F.coalesce(role(r), F.lit(False)) for r in ("secret", "identifier", "endpoint")}
    is_secret = F.col("kind").isin([i for i, k in enumerate(NAMES) if KINDS[k][3] == "secret"])
    strong = F.col("kind").isin([i for i, k in enumerate(NAMES) if KINDS[k][4]])
    linked = F.when(is_secret, has["identifier"] | has["endpoint"]).otherwise(has["secret"])
    return placed.select("row", "doc_id", "text_hash", "kind", "start", "end", (strong | linked).alias("reported"))


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per text: counts and a digest of the strong spans, and all reported spans."""
    n_strong = sum(k[4] for k in KINDS.values())
    name = F.element_at(F.lit(NAMES), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("said"))
    rows = spans(docs, window).groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(NAMES[:n_strong])),
        F.array_sort(F.collect_list(F.when(F.col("reported"), one))).alias("found"),
    )
    said = lambda keep: F.array_join(F.transform(F.filter("found", keep), lambda s: s["said"]), ",")
    return rows.select(
        "doc_id", *(f"n_{k}" for k in NAMES[:n_strong]),
        F.sha2(said(lambda s: s["kind"] < n_strong), 256).alias("base_sha256"),
        said(lambda s: F.lit(True)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[redacted]", window: int = WINDOW) -> DataFrame:
    """Replace every reported span in ``text`` by ``mark``; other columns stay as they are.

    Overlapping spans become one. Only texts with a span are joined, by id and a
    hash of the text, so equal rows get equal results.
    """
    key, hashed, cuts = (fresh(c, docs) for c in ("id", "text_hash", "spans"))
    found = spans(docs, window).where("kind is not null and reported")
    along = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = found.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    merged = (
        opens.withColumn("part", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("row", "doc_id", "text_hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        .groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.first("spans").alias(cuts))
    )
    text, n = F.col("text"), F.size(cuts)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substr(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(cuts, i)["start"], F.char_length(text)) - F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])).cast("int"),
        ),
    )
    joined = docs.join(
        sized(written(merged, "secrets"), 200), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(whole_text()) == F.col(hashed)), "left"
    )
    return joined.withColumn("text", F.when(F.col(cuts).isNotNull(), F.array_join(pieces, mark)).otherwise(text)).select(*docs.columns)
