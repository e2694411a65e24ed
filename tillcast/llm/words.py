"""Words of UTF-8 texts and hashes of them, for operators that work on Arrow batches.

A word is a run of bytes other than space and the control characters 9 to 13; that is how
``bytes.split`` cuts, and ``bytes.lower`` changes A to Z only.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

#: Words remembered by one task; beyond it the memory starts afresh.
REMEMBERED = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Memory(dict):
    """``memory[word]`` is ``value(word)``, computed once as long as it is remembered."""

    def __init__(self, value: Callable):
        super().__init__()
        self.value = value

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.value(word)
        return found


def hashes() -> Memory:
    return Memory(xxhash.xxh64_intdigest)


def ids(words: list[bytes], memory: Memory) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of them can be used."""
    h = (h ^ (h >> np.uint64(33))) * _FIRST
    h = (h ^ (h >> np.uint64(33))) * _SECOND
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, offsets: Iterable[int], span: int) -> np.ndarray:
    """Hashes of the words at ``offsets`` in every window of ``span`` words."""
    count = len(words) - span + 1
    if count <= 0:
        return words[:0]
    h = np.full(count, span, np.uint64)
    for j in offsets:
        h = (h ^ (h >> np.uint64(31))) * _ODD + words[j : j + count]
    return mix(h)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; of fewer words, the whole as one."""
    size = min(size, len(words))
    return np.unique(windows(words, range(size), size)) if size else words


def distinct(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct lower-case words of all texts of a batch; the number of each word in turn; each text's bounds."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    found = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    # Space at either end of a text leaves an empty word.
    kept = pc.greater(pc.binary_length(found), 0)
    if not pc.all(kept).as_py():
        before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
        found, bounds = found.filter(kept), before[bounds - bounds[0]]
    coded = found.dictionary_encode()
    return texts(coded.dictionary), coded.indices.to_numpy(), bounds - bounds[0]


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of what is computed inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
