"""The trie of shared conversation beginnings, by a Cartesian tree over the sorted conversations.

Turns become 16 bytes of a SHA-256 each, so a conversation is one binary path, and
paths in byte order are conversations in the order of a trie. Equal paths are
merged first. The sorted paths are cut into blocks; a block is one row of arrays.
Between neighbours stands their longest common beginning in turns (LCP). The nodes
with several paths are the nodes of the Cartesian tree over these numbers: an
element's nearest smaller values to the left and right are the ends of its
interval. Elements of one interval and equal value are one node, and depths between
a node and its parent, as those below the last branching, are nodes of the same
interval (``expand``). All figures of a node are sums over its interval, by prefix
sums, or a least id, by a table of minima of powers of two.

Blocks work in parallel: intervals inside a block end there. A node that crosses
the end of a block is one for each depth up to the LCP there. It belongs to the
block where it starts, which for any later block is the nearest one before it whose
least LCP is smaller (all nearest smaller values over block minima); each block
adds one part to the nodes that reach into it, and the parts are summed.

Order of turns: by number, null first; of equal ones by digest. Defined results:
null roles and texts are empty; rows without conv_id are no conversation; repeated
rows are turns of their own; an empty table gives no nodes; other columns are not
read. Memory: a task holds the digests (not the texts) of one conversation and of
``BLOCK_PATHS`` paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, sized, written

#: Bytes of a turn's digest, paths of a block, conv_ids of a part of an end list.
DIGEST, BLOCK_PATHS, PART_IDS = 16, 1 << 16, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, heads: int = 9, family: int = 5) -> DataFrame:
    """``conv_id, path, sizes``: each conversation, its beginning taken from the first of its family.

    The first h turns are those of conversation c - c % ``family``; h is crc32(c) %
    ``heads``. ``sizes`` are the bytes of the turns' texts.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(said, 256), 1, 2 * DIGEST))
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % family
    rows = turns.where("conv_id is not null").select("conv_id", base.alias("base"), turn.alias("t"))
    convs = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads))).over(Window.partitionBy("base"))
    headed = convs.select("conv_id", "own", first.alias("head"), h.alias("h"))
    left = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    whole = F.concat(F.coalesce(F.slice("head", 1, F.col("h")), F.slice("own", 1, 0)), left)
    named = headed.select("conv_id", whole.alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    return named.select("conv_id", F.unhex(path).alias("path"), F.col("turns.size").alias("sizes"))


def paths(convs: DataFrame) -> DataFrame:
    """Distinct paths: ``path, sizes, n, least, ends``; ``ends`` is the hash of the sorted conv_ids.

    Ids are joined within parts of ``PART_IDS`` numbers, and the hash reads the parts
    in order, so no list of all ids is held.
    """
    key, part = F.sha2("path", 256), F.floor(F.col("conv_id") / PART_IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    parts = convs.groupBy(key.alias("key"), part.alias("part")).agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    names = ["path", "sizes", "n", "least", "ends"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, digest = None, None, None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if x["key"] != key:
                    if row:
                        done.append([*row, digest.hexdigest()])
                    key, row, digest = x["key"], [x["path"], x["sizes"], 0, x["least"]], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(x["ids"].encode())
                row[2] += x["n"]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([*row, digest.hexdigest()], kinds)], names=names)

    sorted_parts = parts.repartition("key").sortWithinPartitions("key", "part")
    return map_batches(sorted_parts, hashed, "path binary, sizes array<int>, n long, least long, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // DIGEST


BLOCK = (
    "task int, piece int, first binary, last binary, inner_least int, n long, lcp binary, turns binary, bytes binary, "
    "weight binary, least binary, ends binary"
)


def blocks(distinct: DataFrame, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """Sorted paths in blocks, one row each: its first and last path, and arrays over its paths.

    ``lcp`` starts with 0 for the first path, whose neighbour is in the block before;
    ``inner_least`` is the least of the others. ``bytes`` holds the sizes of all turns.
    """
    ranged = distinct.repartitionByRange("path").sortWithinPartitions("path")
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), *[pa.binary()] * 6]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, held = TaskContext.get().partitionId(), 0, []

        def closed() -> pa.RecordBatch:
            found = [x["path"] for x in held]
            lcp = np.array([0, *map(common_turns, found, found[1:])], "<i4")
            arrays = [
                lcp, np.array([len(x) // DIGEST for x in found], "<i4"), np.array([s for x in held for s in x["sizes"]], "<i8"),
                np.array([x["n"] for x in held], "<i8"), np.array([x["least"] for x in held], "<i8"),
            ]
            inner = int(lcp[1:].min()) if len(lcp) > 1 else None
            row = [task, piece, found[0], found[-1], inner, len(held), *(a.tobytes() for a in arrays), b"".join(bytes.fromhex(x["ends"]) for x in held)]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

        for batch in batches:
            for x in batch.to_pylist():
                held.append(x)
                if len(held) >= block_paths:
                    yield closed()
                    piece, held = piece + 1, []
        if held:
            yield closed()

    return map_batches(ranged, cut, BLOCK)


class Borders:
    """What is known of all blocks: the LCP before each, the least LCP in each, and nearest smaller blocks."""

    def __init__(self, rows: list):
        self.index = {(r["task"], r["piece"]): i for i, r in enumerate(rows)}
        self.before = np.array([r["before"] for r in rows] + [-1], np.int64)  # the last: behind the end
        self.least = np.array([r["before"] if r["inner_least"] is None else min(r["before"], r["inner_least"]) for r in rows], np.int64)
        self.smaller = nearest_smaller(self.least)

    def owner(self, block: int, depth: int) -> int:
        """The block where the node of a depth starts that reaches into a block from the left."""
        b = block - 1
        while self.least[b] >= depth:
            b = self.smaller[b]
        return int(b)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it that is smaller; -1 if there is none."""
    found, stack = np.full(len(values), -1, np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] >= v:
            stack.pop()
        if stack:
            found[i] = stack[-1][1]
        stack.append((v, i))
    return found


def borders(cut: DataFrame) -> Borders:
    """One row of numbers for each block goes to the driver; their first and last paths are compared in a task."""
    edges = cut.select("task", "piece", "first", "last", "inner_least")
    beside = edges.withColumn("previous", F.lag("last").over(Window.orderBy("task", "piece"))).select("task", "piece", "previous", "first", "inner_least")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            before = [-1 if a is None else common_turns(bytes(a), bytes(b)) for a, b in zip(f["previous"], f["first"])]
            yield f[["task", "piece", "inner_least"]].assign(before=before)

    found = beside.mapInPandas(compare, "task int, piece int, inner_least int, before int")
    return Borders(found.orderBy("task", "piece").collect())


class Block:
    """The arrays of one block, with the LCP before its first path and behind its last one."""

    def __init__(self, row: dict, number: int, known: Borders):
        take = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        self.number, self.known, self.n = number, known, row["n"]
        self.lcp = np.append(take("lcp", "<i4"), known.before[number + 1])
        self.lcp[0] = known.before[number]
        self.turns, self.weight, self.conv = take("turns", "<i4"), take("weight", "<i8"), take("least", "<i8")
        self.ends = [row["ends"][i : i + 32].hex() for i in range(0, 32 * self.n, 32)]
        offsets = np.concatenate([[0], np.cumsum(self.turns)])
        run = np.concatenate([[0], np.cumsum(take("bytes", "<i8"))])
        self.offsets, self.run = offsets[:-1], run
        total = run[offsets[1:]] - run[offsets[:-1]]
        shared = self.bytes_to(np.arange(self.n), self.lcp[:-1])
        zero = [0]
        self.sums = np.stack([
            np.concatenate([zero, np.cumsum(self.weight)]),
            np.concatenate([zero, np.cumsum(self.weight * total - total + shared)]),
            np.concatenate([zero, np.cumsum(self.lcp[1:] < self.turns)]),  # paths that end in a leaf
        ])
        self.minima = [self.conv]
        while 2 << len(self.minima) - 1 <= self.n:
            a, step = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(a[:-step], a[step:]))

    def bytes_to(self, path: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the first turns of paths."""
        at = self.offsets[path]
        return self.run[at + np.maximum(depth, 0)] - self.run[at]

    def least_conv(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp(end - start)[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.minima[k][start[of]], self.minima[k][end[of] - (1 << k)])
        return out

    def tree(self):
        """Nodes inside the block, as intervals ``start, end, value, above`` with their figures and parents.

        ``value`` is the greatest depth of the interval, ``above`` that of its parent.
        """
        lcp, n = self.lcp, self.n
        left = nearest_smaller(lcp)
        back = nearest_smaller(lcp[::-1])[::-1]
        right = np.where(back >= 0, n - back, n + 1)
        inner = np.arange(1, n)
        whole = inner[(left[inner] >= 0) & (right[inner] <= n)]
        # Equal values of one interval are one node; they part it into one child more.
        keys, index, count = np.unique(np.stack([left[whole], lcp[whole]]), axis=1, return_index=True, return_counts=True)
        branch = whole[index]
        start, end, value = (np.concatenate(x) for x in ((left[branch], np.arange(n)), (right[branch], np.arange(1, n + 1)), (lcp[branch], self.turns)))
        parts = np.concatenate([count + (self.turns[left[branch]] > lcp[branch]), np.zeros(n, np.int64)])
        above = np.maximum(lcp[start], lcp[end])
        keep = value > above  # a path that its successor goes on has no node of its own below the branching
        start, end, value, parts, above = (x[keep] for x in (start, end, value, parts, above))
        at = np.where(lcp[start] == above, start, end)  # an element of the parent's value
        place = {k: i for i, k in enumerate(zip(keys[0].tolist(), keys[1].tolist()))}
        own_least = self.least_conv(left[branch], right[branch]) if len(branch) else np.empty(0, np.int64)
        parent_conv, parent_block = np.full(len(start), -1, np.int64), np.full(len(start), -1, np.int64)
        inside = np.zeros(len(start), bool)
        least_before = np.minimum.accumulate(lcp[:-1])
        for i, (element, depth, first) in enumerate(zip(at.tolist(), above.tolist(), start.tolist())):
            if depth < 0:
                continue
            if 0 < element < n and left[element] >= 0 and right[element] <= n:
                parent_conv[i], inside[i] = own_least[place[left[element], depth]], True
            else:
                parent_block[i] = self.number if least_before[first] < depth else self.known.owner(self.number, depth)
        return start, end, value, above, parts, parent_conv, parent_block, inside

    def nodes(self) -> pd.DataFrame:
        """One row for each node inside the block; a parent in another block or across its end is named by
        ``parent_block`` and its depth."""
        start, end, value, above, parts, parent_conv, parent_block, inside = self.tree()
        times = value - above
        of = np.repeat(np.arange(len(start)), times)
        depth = value[of] - (np.repeat(np.cumsum(times), times) - 1 - np.arange(len(of)))
        first, last = start[of], end[of]
        n, extra, leaves = self.sums[:, last] - self.sums[:, first]
        saved = extra - self.bytes_to(first, self.lcp[first]) - (n - 1) * self.bytes_to(first, depth - 1)
        conv = self.least_conv(start, end)[of]
        top, bottom = depth == above[of] + 1, depth == value[of]
        single = last - first == 1
        children = np.where(bottom, np.where(single, 0, parts[of]), 1)
        ended = self.turns[first] == depth
        return pd.DataFrame({
            "conv_id": conv, "depth": depth, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
            "parent_conv_id": np.where(top, parent_conv[of], conv),
            "parent_block": np.where(top, parent_block[of], -1),
            "known": ~top | inside[of],
            "ends_sha256": [self.ends[f] if e else EMPTY for f, e in zip(first.tolist(), ended.tolist())],
        })

    def crossing(self) -> pd.DataFrame:
        """Parts of the nodes that cross the block's ends: ``block, depth`` of the node, sums and, where it
        starts here, what its first path tells."""
        lcp, n, rows = self.lcp, self.n, []
        low = int(lcp[:-1].min())
        if lcp[n] > low:
            depth = np.arange(low + 1, lcp[n] + 1)
            behind = np.minimum.accumulate(lcp[:-1][::-1])[::-1]  # rises
            first = np.searchsorted(behind, depth, "left") - 1
            splits = np.bincount(behind[lcp[:-1] == behind] + 1, minlength=int(lcp[n]) + 2)[1:]
            sums = self.sums[:, [n]] - self.sums[:, first]
            parent = np.where(depth - 1 > low, self.number, -1)
            for d in range(len(depth)):
                if depth[d] > 0 and depth[d] - 1 <= low:
                    parent[d] = self.known.owner(self.number, int(depth[d]) - 1)
            rows.append(pd.DataFrame({
                "block": self.number, "depth": depth, "n": sums[0], "extra": sums[1] - self.bytes_to(first, lcp[first]), "leaves": sums[2],
                "conv": np.minimum.accumulate(self.conv[::-1])[::-1][first], "splits": splits[depth] + (self.turns[first] > depth),
                "before": self.bytes_to(first, depth - 1), "parent_block": parent,
                "ends": [self.ends[f] if self.turns[f] == d else EMPTY for f, d in zip(first.tolist(), depth.tolist())],
            }))
        if self.number:
            depth = np.arange(0, lcp[0] + 1)
            ahead = np.minimum.accumulate(lcp[1:n]) if n > 1 else np.empty(0, np.int64)  # falls
            end = 1 + np.searchsorted(-ahead, -depth, "right")
            lows = np.concatenate([lcp[:1], np.minimum(ahead, lcp[0])])
            splits = np.bincount(lows[(lcp[:n] == lows)], minlength=int(lcp[0]) + 1)
            sums = self.sums[:, end]
            rows.append(pd.DataFrame({
                "block": [self.known.owner(self.number, d) for d in depth.tolist()], "depth": depth, "n": sums[0], "extra": sums[1], "leaves": sums[2],
                "conv": np.minimum.accumulate(self.conv)[end - 1], "splits": splits[depth], "before": None, "parent_block": None, "ends": None,
            }))
        return pd.concat([r.astype(object) for r in rows]) if rows else pd.DataFrame()


PART = "block long, depth long, n long, extra long, leaves long, conv long, splits long, before long, parent_block long, ends string"
NODE = (
    "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, "
    "parent_block long, known boolean, ends_sha256 string"
)


def _each_block(cut: DataFrame, known: Borders, step: str, schema: str) -> DataFrame:
    kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = getattr(Block(row, known.index[row["task"], row["piece"]], known), step)()
                if len(found):
                    yield from pa.Table.from_pandas(found, kinds, preserve_index=False).to_batches(max_chunksize=1 << 15)

    return map_batches(cut, run, schema)


def trie(turns: DataFrame, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations; the root has depth 0."""
    distinct = written(paths(rebuilt(turns)), "paths")
    cut = written(blocks(distinct, block_paths), "blocks")
    known = borders(cut)
    parts = _each_block(cut, known, "crossing", PART)
    summed = parts.groupBy("block", "depth").agg(
        *(F.sum(c).alias(c) for c in ("n", "extra", "leaves", "splits")), F.min("conv").alias("conv"), *(F.max(c).alias(c) for c in ("before", "parent_block", "ends"))
    )
    cross = written(summed, "crossing")
    above = sized(cross.select(F.col("block").alias("parent_block"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("_above")), 32)
    across = cross.select(
        F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"), F.col("splits").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("extra") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.lit(None).cast("long").alias("parent_conv_id"), "parent_block",
        F.lit(False).alias("known"), F.col("ends").alias("ends_sha256"),
    )
    nodes = _each_block(cut, known, "nodes", NODE).unionByName(across).join(above, ["parent_block", "depth"], "left")
    parent: Column = F.when(F.col("known"), F.col("parent_conv_id")).otherwise(F.col("_above"))
    return nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
