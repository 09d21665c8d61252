"""Hierarchical packing of tokenised documents into windows of several sizes.

Documents are routed to the smallest tier that holds them whole; longer ones
give full windows of the largest tier first. From the longest tier down, each
window takes a document and fills its gap with the largest whole documents of
shorter tiers that fit, then with a cut of a waiting document, so that windows
are full: their length is the tier's, a power of two, and needs no padding. What
stays over when a task ends is cut into full windows as far as it goes; only
the last one of a task is padded.

Each task packs its own partition in blocks of bounded size and keeps no more
than a block; nothing is shuffled. Sequence ids are the partition's number and a
running number. ``step_group`` collects sequences of one tier into groups of
equal tokens, ``GROUP_TOKENS`` each, so that steps are balanced.

Defined results: null and empty texts are the end id alone; repeated rows are
documents of their own; null ids are kept; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, worker_model

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that a task packs at once.
BLOCK_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 15
#: Words whose ids a worker remembers, twice.
CACHE_WORDS = 250_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class WordTokenizer:
    """Token ids, as little-endian 32-bit bytes, of a tokenizer that drops white space.

    White space always ends a token there and A-Z count as a-z, so lower-cased
    words are looked up one by one. New ones are encoded together: a word of
    letters ends at its token with the word-end suffix, others are set apart by a
    mark, and one that ends in a letter and a single comma or full stop is put
    together from two. Words are remembered in two generations of ``CACHE_WORDS``.
    """

    MARK = "\x01"
    SUFFIX = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.added = [t.content.lower() for t in self.plain.get_added_tokens_decoder().values()]
        self.loose = not all("|" in a for a in self.added)  # else texts without a bar hold none
        vocabulary = self.encoder.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for w, i in vocabulary.items() if w.endswith(self.SUFFIX)]] = True
        self.mark = self._ids(self.MARK)
        assert len(self.mark) == 1, "the mark must be one token"
        self.ends = {p: self._ids(p.decode()).tobytes() for p in (b",", b".")}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[str], ids: np.ndarray, start: list[int], end: list[int]) -> None:
        raw = ids.tobytes()
        self.known.update(zip([w.encode() for w in words], [raw[4 * a : 4 * b] for a, b in zip(start, end)]))

    def _learn(self, words: set[bytes]) -> None:
        ended = {w for w in words if w[-1:] in self.ends and w[-2:-1].isalpha()}
        plain = [w.decode() for w in words - ended | {w[:-1] for w in ended} - self.known.keys()]
        letters = [w for w in plain if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        marked = [w for w in set(plain).difference(letters) if self.MARK not in w]
        if letters:
            ids = self._ids(" ".join(letters))
            cuts = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(cuts) == len(letters):
                self._keep(letters, ids, [0, *cuts], cuts)
            else:  # some word is more than one run of tokens
                marked += letters
        if marked:
            ids = self._ids(f" {self.MARK} ".join(marked))
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            self._keep(marked, ids, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)])
        for w in plain:
            if self.MARK in w:
                self.known[w.encode()] = self._ids(w).tobytes()
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.ends[w[-1:]]

    def texts(self, texts: list) -> list[bytes]:
        out = self._by_words(texts)
        for i, t in enumerate(texts):
            if t and "|" in t or t and self.loose:
                lowered = t.lower()
                if any(a in lowered for a in self.added):
                    out[i] = np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _by_words(self, texts: list) -> list[bytes]:
        split = [(t or "").encode().lower().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update({w: self.older[w] for w in again})
        self._learn(new - again)
        look = self.known.__getitem__
        return [b"".join(map(look, words)) for words in split]


class Packer:
    """Packs documents ``(doc_id, ids)`` and gives pieces, a full window at a time."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next_id, self.first_id = tiers, 0, first_id
        self.waiting: list[tuple[int, int]] = []  # (length left, key), sorted
        self.docs: dict[int, tuple] = {}  # key: doc_id, ids, start of what is left
        self.keys = 0
        self.groups: dict[int, list[int]] = {t: [0, 0] for t in tiers}
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        """Take a document in; gives the full windows that it fills by itself."""
        self.keys += 1
        self.docs[self.keys] = (doc_id, ids, 0)
        left, largest = len(ids) // 4, self.tiers[-1]
        while left >= largest:
            yield self._window([(self.keys, largest)], largest)
            left -= largest
        if left:
            insort(self.waiting, (left, self.keys))
            self.tokens += left
        else:
            del self.docs[self.keys]

    def _window(self, takes: list[tuple[int, int]], tier: int) -> list[tuple]:
        sequence, offset, pieces = self.first_id + self.next_id, 0, []
        self.next_id += 1
        group = self.groups[tier]
        group[1] += tier
        if group[1] > GROUP_TOKENS:
            group[:] = [group[0] + 1, tier]
        for key, n in takes:
            doc_id, ids, start = self.docs[key]
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
            pieces.append((doc_id, start, n, crc, len(ids) // 4, sequence, offset, tier, self.first_id + group[0] * len(self.tiers) + self.tiers.index(tier)))
            offset += n
            self.docs[key] = (doc_id, ids, start + n)
        return pieces

    def _fill(self, tier: int, lead: tuple[int, int] | None) -> list[tuple[int, int]]:
        """Documents for one window: whole ones from the longest that fit, then a cut."""
        takes, gap = [], tier
        if lead:
            takes, gap = [(lead[1], lead[0])], tier - lead[0]
        while gap and self.waiting:
            i = bisect_right(self.waiting, (gap, float("inf"))) - 1
            left, key = self.waiting.pop(i if i >= 0 else 0)
            n = min(left, gap)
            takes.append((key, n))
            if left > n:
                insort(self.waiting, (left - n, key))
            gap -= n
        return takes

    def drain(self, last: bool = False) -> Iterator[list[tuple]]:
        """Pack what is waiting; what would need padding stays, unless this is the last call."""
        shorter = (0, *self.tiers)
        for tier, below in zip(reversed(self.tiers), reversed(shorter[:-1])):
            while self.waiting and self.waiting[-1][0] > below and sum_at_least(self.waiting, tier):
                yield self._emit(self._fill(tier, self.waiting.pop()), tier)
        while last and self.waiting:
            left = sum(n for n, _ in self.waiting)
            tier = next((t for t in reversed(self.tiers) if t <= left), self.tiers[-1])
            yield self._emit(self._fill(tier, None), tier)
        self.tokens = sum(n for n, _ in self.waiting)

    def _emit(self, takes: list[tuple[int, int]], tier: int) -> list[tuple]:
        pieces = self._window(takes, tier)
        for key, _ in takes:
            _, ids, start = self.docs[key]
            if 4 * start == len(ids):
                del self.docs[key]
        return pieces


def sum_at_least(waiting: list[tuple[int, int]], least: int) -> bool:
    total = 0
    for n, _ in reversed(waiting):
        total += n
        if total >= least:
            return True
    return False


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece. ``tokenizer_path`` must exist on the executors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_model(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId() << 33, tiers)
        end = np.array([END_ID], "<u4").tobytes()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32() if x.endswith("int") else pa.int64() for x in SCHEMA.split(", ")]

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(ids), 512):
                done = []
                for doc_id, found in zip(ids[at : at + 512], tokenizer.texts(texts[at : at + 512])):
                    for window in packer.add(doc_id, found + end):
                        done += window
                    if packer.tokens >= BLOCK_TOKENS:
                        for window in packer.drain():
                            done += window
                if done:
                    yield rows(done)
        done = [piece for window in packer.drain(last=True) for piece in window]
        if done:
            yield rows(done)

    return map_batches(docs.select("doc_id", "text"), of, SCHEMA)
