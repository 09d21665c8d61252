"""Counts over whole texts, computed in Arrow batches.

``bytes.split`` without an argument splits at exactly the six ASCII white-space
bytes, so its pieces are the words of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words",
)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _class(characters: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(characters.encode())] = True
    return mask


_SYMBOLS = _class("#*$%&|<>")
_DIGITS = _class("0123456789")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = _class("!?")


def of_text(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FIELDS``; a null text counts as empty."""
    data = (text or "").encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        often = {g for g, n in Counter(grams).items() if n > 1}
        upto = 0  # first word not yet counted
        for i, g in enumerate(grams):
            if g in often:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    return (
        len(words), len(text or "") - int(counts[_WHITE].sum()), int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeats,
        len(lines), int(counts[_UPPER].sum()), int(counts[_DIGITS].sum()), int(counts[_MARKS].sum()), len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text, one row per row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of_text(t.as_py()) for t in batch.column("text")]
            columns = np.array(rows, np.int64).reshape(-1, len(FIELDS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in columns)], names=["doc_id", *FIELDS]
            )

    schema = ", ".join(f"{x} long" for x in ("doc_id", *FIELDS))
    return map_batches(docs.select("doc_id", "text"), of, schema)
