"""Grouped prefix join: all documents whose shingle sets are similar enough.

Documents link when 100 * |A and B| >= 75 * |A or B|, over sets of distinct
5-word shingles (64-bit hashes). The join is exact over these sets:

1. Documents with equal sets form a class. Each class is dealt out by a third of
   its elements, those of smallest hash. Linked sets share a known part of these
   (``least_close``), so only classes that do with any others are *close*; they
   are few unless the corpus is full of copies. Only hashes are shuffled.
2. The elements of close classes are counted, and ordered by count, rare ones
   first. Linked sets must share an element among their first
   n - ceil(3n/4) + 1, their prefixes. Elements that one class alone holds come
   first and meet nobody, so most close classes need no list at all.
3. Classes of equal size and equal prefix (but for elements held by them alone)
   form a group. Groups that share a prefix element make a list; of elements that
   the same groups hold only the first is kept, as no other can make a pair earlier.
4. Members of a group are first verified with its most central one. Then, in
   rounds, each group is paired in its lists with the most central class of
   another component: linearly many pairs, verified on whole sets; linked
   components become one. When a round links nothing more, the groups and
   lists that still hold several components are joined in full between different
   components, for pairs whose shared element lies early enough in both sets to
   leave room for the overlap. Group pairs expand to their members, and these are
   verified. Links inside a component can add nothing, so no link between
   different texts is lost, and large groups of near copies never make all pairs.

Defined results: null or empty texts and texts without words have an empty set
and stand alone; equal texts share a class; rows with one id count as one
document; a null id never is a component's smallest; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, map_batches, sized, whole_text, written
from .shingles import shingle_set

SIZE = 5
#: Most rounds of pairs with central classes; whatever they leave is joined in full.
ROUNDS = 8
#: Copies of a class's row in the last join, so that no class is one task's.
SALTS = 16
#: Pairs that one task verifies where there are few; a pair brings two whole sets.
TASK_PAIRS = 512


def digest(tokens: np.ndarray, size: int) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=size).digest()


def dealt_out(n: int) -> int:
    """How many elements of a set are dealt out first: its prefix and a tenth more."""
    return min(n, n - (3 * n + 3) // 4 + 1 + n // 10)


def least_close(n: Column) -> Column:
    """Fewest of these that a linked set has among its own: a prefix holds one, each further element one more,
    but for one where the tenths of the two sizes differ."""
    return F.greatest(F.floor(n / 10), F.lit(1))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, cls, key, early`` of each row.

    ``cls`` is a digest of the set, ``key`` its first half, ``early`` the elements
    to deal out, given once for each class and task.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, classes, early = [], [], []
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), SIZE)
                cls = digest(tokens, 16)
                sizes.append(len(tokens))
                classes.append(cls)
                early.append(None if not len(tokens) or cls in seen else tokens[: dealt_out(len(tokens))].view(np.int64))
                seen.add(cls)
            keys = [int.from_bytes(c[:8], "little", signed=True) for c in classes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(sizes, pa.int64()),
                 pa.array(classes, pa.binary()), pa.array(keys, pa.int64()), pa.array(early, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "cls", "key", "early"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("text_hash"))
    return map_batches(rows, sign, "doc_id long, text_hash long, n long, cls binary, key long, early array<long>")


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and key: the keys of tokens that several keys hold, each pair once."""
    last, last_shared = None, False  # the row before, and whether its token is shared
    for batch in batches:
        if not batch.num_rows:
            continue
        token, key = (batch.column(c).to_numpy() for c in ("token", "key"))
        if last is not None:
            token, key = np.concatenate([[last[0]], token]), np.concatenate([[last[1]], key])
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[once], key[once]
        same = token[1:] == token[:-1]
        shared = np.zeros(len(token), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= last_shared
        if shared[:-1].any():  # the last row waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][shared[:-1]])], names=["key"])
        last, last_shared = (token[-1], key[-1]), bool(shared[-1])
    if last_shared:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]])], names=["key"])


def close_classes(signed: DataFrame) -> DataFrame:
    """``cls, id`` of the classes that share enough of their dealt elements to be linked to any other."""
    rows = signed.where("early is not null").select(F.explode("early").alias("token"), "key")
    rows = rows.repartition("token").sortWithinPartitions("token", "key")
    shared = map_batches(rows, _keep_shared, "key long").groupBy("key").agg(F.count("*").alias("c"))
    classes = signed.where("n > 0").groupBy("cls").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.min("doc_id").alias("id"))
    return classes.join(shared, "key").where(F.col("c") >= least_close(F.col("n"))).select("cls", "id")


def close_sets(docs: DataFrame, close: DataFrame) -> DataFrame:
    """``cls, n, elements`` of the close classes."""
    texts = docs.select("doc_id", "text").join(
        sized(close.select("id").distinct(), 24), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), SIZE) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x, 16) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                names=["cls", "elements"],
            )

    found = map_batches(texts.select("text"), sets, "cls binary, elements array<long>")
    found = found.join(sized(close.select("cls"), 40), "cls", "left_semi")
    return found.groupBy("cls").agg(F.first("elements").alias("elements")).select("cls", F.size("elements").cast("long").alias("n"), "elements")


def prefixes(sets: DataFrame) -> DataFrame:
    """``rid, n, own, central, lead`` of the sets whose prefix has an element of another set.

    ``own``: elements of the set alone, which come first; ``lead``: the rest of the
    prefix, as (count, element); ``central``: how often the set's elements occur.
    """
    rows = sets.select(F.explode("elements").alias("token"), "rid", "n")
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    found = rows.join(counts, "token").groupBy("rid", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"), (F.sum("df") / F.first("n")).alias("central")
    )
    own = F.col("n") - F.size("shared")
    take = F.col("n") - F.ceil(0.75 * F.col("n")) + 1 - own
    return found.where(take > 0).select("rid", "n", own.alias("own"), "central", F.slice("shared", 1, take.cast("int")).alias("lead"))


def group_lists(members: DataFrame) -> DataFrame:
    """``key, grp, n, pos``: lists of groups that share a prefix element ``key``, with its place.

    An element after another one that the same groups hold is left out.
    """
    groups = members.groupBy("grp").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("lead").alias("lead"))
    rows = groups.select("grp", "n", "own", F.posexplode("lead").alias("i", "e")).select("grp", "n", (F.col("own") + F.col("i")).alias("pos"), "e")
    holders = rows.groupBy("e").agg(
        F.bit_xor(F.xxhash64("grp")).alias("h1"), F.bit_xor(F.xxhash64("grp", F.lit(1))).alias("h2"), F.count("*").alias("h3")
    ).where("h3 > 1")
    firsts = holders.groupBy("h1", "h2", "h3").agg(F.min("e").alias("e"))
    return rows.join(firsts.select("e"), "e").select(F.col("e.token").alias("key"), "grp", "n", "pos")


def _overlap(n1: Column, n2: Column) -> Column:
    """Fewest common elements with which sets of these sizes link."""
    return F.ceil(3 * (n1 + n2) / 7)


def _can_link(n1: Column, pos1: Column, n2: Column, pos2: Column) -> Column:
    """Whether sets of these sizes whose first common element has these places can still link."""
    near = (4 * n1 >= 3 * n2) & (4 * n2 >= 3 * n1)
    return near & (pos1 <= n1 - _overlap(n1, n2)) & (pos2 <= n2 - _overlap(n1, n2))


def open_rows(lists: DataFrame, members: DataFrame, labels: DataFrame, most: int | None) -> DataFrame:
    """``key, grp, n, pos, label, rep, central``: the lists that hold several components, a row for each group and
    component, with the most central class of these. Rows too late in their set for any other of the list are left out. ``most``: rows of the round before, if any,
    which this one cannot exceed."""
    parts = members.join(labels, "rid").groupBy("grp", "label").agg(F.max(F.struct("central", "rid")).alias("top"))
    rows = lists.join(parts, "grp").select("key", "grp", "n", "pos", "label", F.col("top.rid").alias("rep"), F.col("top.central").alias("central"))
    seen = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low != high")
    smallest = F.greatest("least", F.ceil(0.75 * F.col("n")))
    rows = rows.join(seen.select("key", "least"), "key")
    return written(rows.where(F.col("pos") <= F.col("n") - _overlap(F.col("n"), smallest)).drop("least"), "open", most)


def group_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: each class of a group with the group's most central one."""
    top = members.groupBy("grp").agg(F.max_by("rid", F.struct("central", "rid")).alias("b"))
    return members.join(top, "grp").where("rid != b").select(F.col("rid").alias("a"), "b")


def central_pairs(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """``a, b``: at most two partners of each group and component: linearly many.

    In each list a row looks at the most central class of another component; of all
    it sees it takes the most central, and the one with which it shares most lists.
    """
    tops = rows.groupBy("key", "label").agg(F.max(F.struct("central", "rep", "n", "pos")).alias("t"))
    first = tops.groupBy("key").agg(F.max(F.struct("t", "label")).alias("t1"))
    second = tops.join(first, "key").where(F.col("label") != F.col("t1.label")).groupBy("key").agg(F.first("t1").alias("t1"), F.max("t").alias("t2"))
    seen = rows.join(second, "key").withColumn("o", F.when(F.col("label") != F.col("t1.label"), F.col("t1.t")).otherwise(F.col("t2")))
    seen = seen.where(_can_link(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    pairs = seen.groupBy(F.col("rep").alias("a"), F.col("o.rep").alias("b"), F.col("o.central").alias("central")).agg(F.count("*").alias("c"))
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("central", "c", "b")).alias("x"), F.max_by("b", F.struct("c", "central", "b")).alias("y"))
    return best.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))


def remaining_pairs(rows: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b``: all pairs of classes of different components that can link by their place in a list."""
    side = lambda i: rows.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("grp", "n", "pos", "label")))
    met = side(1).join(side(2), "key").where(
        (F.col("label1") < F.col("label2")) & _can_link(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"))
    )
    known = members.join(labels, "rid")
    mixed = known.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    inside = known.join(mixed.select("grp"), "grp").select("grp", "label").distinct()
    within = inside.select("grp", F.col("label").alias("label1")).join(inside.select("grp", F.col("label").alias("label2")), "grp").where("label1 < label2")
    pairs = met.select("grp1", "label1", "grp2", "label2").distinct().unionByName(
        within.select(F.col("grp").alias("grp1"), "label1", F.col("grp").alias("grp2"), "label2")
    )
    expand = lambda i, c: known.select(F.col("grp").alias(f"grp{i}"), F.col("label").alias(f"label{i}"), F.col("rid").alias(c))
    return pairs.join(expand(1, "a"), ["grp1", "label1"]).join(expand(2, "b"), ["grp2", "label2"]).select("a", "b")


def _joined(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both their sets."""
    needed = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    some = sets.join(needed, "rid", "left_semi")
    side = lambda c: some.select(F.col("rid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _linked(common: Column, n1: Column, n2: Column) -> Column:
    return 100 * common >= 75 * (n1 + n2 - common)


def verified(pairs: DataFrame, sets: DataFrame, screen: bool = False) -> DataFrame:
    """Of written pairs ``a, b``, those whose whole sets are similar enough; written.

    With ``screen``, where few will be, 16 bits of each element tell first for
    most pairs that too little can be common: they never understate it.
    """
    most = pairs.count()
    if screen:
        brief = F.array_distinct(F.transform("elements", lambda x: (x.bitwiseAND(65535) - 32768).cast("short")))
        lost = F.least(*(F.col(f"n_{c}") - F.size(f"brief_{c}") for c in "ab"))
        common = F.size(F.array_intersect("brief_a", "brief_b")) + lost
        near = _joined(pairs, sets.withColumn("brief", brief), "n", "brief")
        pairs = written(near.where(_linked(F.least(common, "n_a", "n_b"), F.col("n_a"), F.col("n_b"))).select("a", "b"), "screened", most, TASK_PAIRS)
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    linked = _joined(pairs, sets, "n", "elements").where(_linked(common, F.col("n_a"), F.col("n_b"))).select("a", "b")
    return written(linked, "links", most, TASK_PAIRS)


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, label``: the smallest node of each linked node's component.

    Alternating star contraction: each round hangs every node's larger
    neighbours, then its smaller ones, on its smallest neighbour, and halves the
    longest path about. Rounds are written tables in the shared folder; only a
    row count and a checksum reach the driver. A hot node's neighbours meet in a
    plain join, which Spark can split, never in one group.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    most, mark, old = links.count(), None, None
    for _ in range(most_rounds):
        edges = written(edges, "edges", most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old is not None:
            dropped(old)
        old = edges
        if tuple(now) == mark or not now[0]:
            break
        mark, most = tuple(now), 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after components that a link connects have become one."""
    of = lambda c: labels.select(F.col("rid").alias(c), F.col("label").alias(f"l{c}"))
    edges = written(links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), "joined", links.count())
    found = components(edges)
    joined = labels.join(found, labels.label == found.node, "left")
    return written(joined.select("rid", F.coalesce(found.label, labels.label).alias("label")), "labels", labels.count())


def class_labels(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``cls, label`` of the close classes; classes of one component have one label."""
    close = written(close_classes(signed), "close", signed.count())
    none = close.sparkSession.createDataFrame([], "cls binary, label long")
    if close.isEmpty():
        return none
    sets = written(close_sets(docs, close).withColumn("rid", F.monotonically_increasing_id()), "sets")
    grp = F.sha2(F.concat_ws(",", "n", "own", F.array_join(F.transform("lead", lambda e: e["token"].cast("string")), ",")), 256)
    members = written(prefixes(sets).withColumn("grp", grp), "members")
    if members.isEmpty():
        return none
    lists = written(group_lists(members), "lists")
    members = members.select("rid", "grp", "central")
    labels = members.select("rid", F.col("rid").alias("label"))
    tried = written(group_pairs(members), "pairs", members.count())
    links = verified(tried, sets)
    if not links.isEmpty():
        labels = merged(labels, links)
    most = None
    for _ in range(ROUNDS):
        rows = open_rows(lists, members, labels, most)
        most = rows.count()
        pairs = written(central_pairs(rows, tried), "pairs", 2 * most)
        links = verified(pairs, sets)
        if links.isEmpty():
            break
        # Components only grow, so lists and rows that are left out stay so.
        tried, lists, labels = tried.unionByName(pairs), rows.select("key", "grp", "n", "pos").distinct(), merged(labels, links)
    else:
        rows = open_rows(lists, members, labels, most)
    rest = written(remaining_pairs(rows, members, labels), "rest")
    links = verified(rest, sets, screen=True)
    if not links.isEmpty():
        labels = merged(labels, links)
    return sets.select("rid", "cls").join(labels, "rid").select("cls", "label")


def linked_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n, cls`` of each row; and ``cls, top`` of each class with words: the smallest
    (null last, id, text hash) of its component."""
    signed = written(signatures(docs), "signed")
    labels = written(class_labels(docs, signed), "class_labels", signed.count())
    row = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash"))
    classes = signed.where("n > 0").groupBy("cls").agg(row.alias("top"), F.count("*").alias("rows"))
    named = written(classes.join(labels, "cls", "left"), "classes", signed.count())
    best = named.where("label is not null").groupBy("label").agg(F.min("top").alias("best"), F.sum("rows").alias("all_rows"))
    tops = named.join(best, "label", "left").select("cls", F.coalesce("best", "top").alias("top"), F.coalesce("all_rows", "rows").alias("rows"))
    return signed.select("doc_id", "text_hash", "n", "cls"), tops.where("rows > 1").drop("rows")


def _with_tops(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows with the ``top`` of their class; null where no other row is linked. A hot class is spread over ``SALTS`` keys."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    return salted.join(tops.select("*", salt), ["cls", "salt"], "left").drop("salt")


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    rows, tops = linked_rows(docs)
    return _with_tops(rows, tops).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("top.doc_id", "doc_id").alias("component_id")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """Keep one row of each component, the first by id (null last) and a hash of its text; all columns stay.

    Texts without words are linked with nothing, so all their rows stay.
    """
    key, hashed = fresh("id", docs), fresh("text_hash", docs)
    rows, tops = linked_rows(docs)
    same = (F.col("doc_id").eqNullSafe(F.col("top.doc_id"))) & (F.col("text_hash") == F.col("top.text_hash"))
    found = _with_tops(rows, tops).where("top is not null").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(
        F.bool_or(same).alias("first"), F.count("*").alias("rows")
    )
    found = written(found, "linked")
    matches = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(whole_text()) == F.col(hashed))
    kept = docs.join(sized(found.where("not first or rows > 1").select(key, hashed), 40), matches, "left_anti")
    again = found.where("first and rows > 1").select(key, hashed)  # rows that the table holds several times: one stays
    if again.isEmpty():
        return kept
    once = docs.join(sized(again, 40), matches).dropDuplicates([key, hashed]).select(*docs.columns)
    return kept.unionByName(once)
