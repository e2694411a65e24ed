"""Benchmark passages in documents, found by spaced seeds.

A seed is a window of SPAN words (or a whole shorter item) of which a fixed mask looks at some
only, so a changed word in an ignored place doesn't hide it. Seeds of the benchmark are matched with those of every
window of the documents; around each match the two texts are laid over each other and
compared word by word, and a stretch counts if enough of its words agree.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm import words as W
from tillcast.session import materialise

SPAN = 12
#: Fixed masks; 1 marks a word that must agree.
MASKS = ("111010011011", "110110110101", "101011101110", "011101101011")


#: A mask is given in parts, the places of each; masks of a window share parts.
Mask = tuple[tuple[int, ...], ...]


def _two_of_four(group: list[int]) -> list[Mask]:
    """Masks of two of four groups of places: any two changes leave one of them whole."""
    parts = [tuple(i for i, g in enumerate(group) if g == k) for k in range(4)]
    return list(itertools.combinations(parts, 2))


def _offsets(span: int) -> list[Mask]:
    """The places that the masks of a window look at; windows of under SPAN are whole items."""
    if span == SPAN:
        masks = [(tuple(i for i, c in enumerate(m) if c == "1"),) for m in MASKS]
        # With both groupings every three changes in 16 words leave a mask whole in some window.
        return masks + _two_of_four([i % 4 for i in range(SPAN)]) + _two_of_four([i // 3 for i in range(SPAN)])
    if span - _needed(span) > 1:
        return _two_of_four([i % 4 for i in range(span)])
    # One change at most: masks that skip one place or two, so that all are skipped once.
    skips = [(i, i + span // 2) for i in range(span // 2)] if span >= 8 else [(i,) for i in range(span)]
    if span >= 8 and span % 2:
        skips.append((span - 1,))
    return [(tuple(i for i in range(span) if i not in skip),) for skip in skips]


#: A stretch needs so many equal words (of a shorter item, PERCENT of all its words) ...
NEEDED = 13
#: ... which are PERCENT of the stretch.
PERCENT = 80
#: Items of fewer words are no evidence and match nothing.
SHORTEST_ITEM = 6
#: Benchmark words that one pass over the documents looks for, which bounds its broadcast.
BLOCK_WORDS = 1 << 19
#: Bits of a seed that the filter looks at, or more if there are many seeds.
FILTER_BITS = 22
#: Words that are hashed together, so that short texts do not cost a call each.
WORDS_AT_ONCE = 1 << 15

def _needed(words: int) -> int:
    """Equal words that an item of so many words needs."""
    return min(NEEDED, -(-PERCENT * words // 100))


OFFSETS = {n: _offsets(n) for n in range(SHORTEST_ITEM, SPAN + 1)}

FOUND = "array<struct<item_id:bigint,first:int,words:int,equal:int>>"
_PUNCTUATION = string.punctuation.encode()
_TIMES, _DOWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _memory() -> W.Memory:
    """Word to hash, without case and without punctuation around it; 0 if nothing is left."""

    def value(word: bytes) -> int:
        bare = word.strip(_PUNCTUATION)
        return xxhash.xxh64_intdigest(bare) or 1 if bare else 0

    return W.Memory(value)


def _plain(text: bytes | None, memory: W.Memory) -> np.ndarray:
    found = W.ids((text or b"").lower().split(), memory)
    return found[found != 0]


def _part(words: np.ndarray, places: tuple[int, ...], count: int) -> np.ndarray:
    """Hashes of the words at ``places`` in each of ``count`` windows."""
    h = words[places[0] : places[0] + count] * _TIMES
    for j in places[1:]:
        h ^= h >> _DOWN
        h += words[j : j + count]
        h *= _TIMES
    return h


def _seeds(words: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """The seeds of all windows of ``span`` words, mask after mask; parts are hashed once."""
    count = len(words) - span + 1
    if count <= 0:
        return
    parts: dict[tuple[int, ...], np.ndarray] = {}
    for salt, mask in enumerate(OFFSETS[span]):
        for places in mask:
            if places not in parts:
                parts[places] = _part(words, places, count)
        h = parts[mask[0]]
        for places in mask[1:]:
            h = (h ^ (h >> _DOWN)) * _TIMES + parts[places]
        yield (h + np.uint64(salt * 32 + span)) * _TIMES


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        seeds, whose, where = [], [], []

        def add(h: np.ndarray, item: int) -> None:
            seeds.append(h)
            whose.append(np.full(len(h), item, np.int32))
            where.append(np.arange(len(h), dtype=np.int32))

        self.shorter = sorted({len(x) for _, x in items if len(x) < SPAN})
        for i, (_, words) in enumerate(items):
            span = min(SPAN, len(words))
            for h in _seeds(words, span):
                add(h, i)
        h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.whose = np.concatenate(whose)[order] if seeds else order
        self.where = np.concatenate(where)[order] if seeds else order
        bits = max(FILTER_BITS, (2 * len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.seeds >> self.shift] = True

    def diagonals(self, texts: list[np.ndarray]) -> list[set[tuple[int, int]]]:
        """For each text (item, place of its first word in the text) of all seeds in common.

        The texts are hashed as one row of words; windows over the end of a text are left out.
        """
        out: list[set[tuple[int, int]]] = [set() for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        for span in [*self.shorter, SPAN]:
            for h in _seeds(words, span):
                at = np.flatnonzero(self.maybe[h >> self.shift])
                if not len(at):
                    continue
                found = h[at]
                low = np.searchsorted(self.seeds, found, "left")
                hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == found)
                at, low, found = at[hit], low[hit], found[hit]
                text = np.searchsorted(ends, at, "right")
                inside = at + span <= ends[text]
                at, low, found, text = at[inside], low[inside], found[inside], text[inside]
                high = np.searchsorted(self.seeds, found, "right")
                begin = at - ends[text] + np.array([len(t) for t in texts])[text]
                for t, p, x, y in zip(text.tolist(), begin, low, high):
                    out[t].update(zip(self.whose[x:y].tolist(), (p - self.where[x:y]).tolist()))
        return out

    def verified(self, words: np.ndarray) -> list[tuple]:
        """(item_id, first word, words, equal words) of the stretches that count."""
        return self.verified_all([words])[0]

    def verified_all(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """The stretches that count of each text."""
        return [self._stretches(words, met) for words, met in zip(texts, self.diagonals(texts))]

    def _stretches(self, words: np.ndarray, met: set[tuple[int, int]]) -> list[tuple]:
        out = []
        for i, start in sorted(met):
            name, item = self.items[i]
            a, b = max(0, start), min(len(words), start + len(item))
            equal = words[a:b] == item[a - start : b - start]
            first, last = _best_stretch(equal)
            n = int(equal[first:last].sum())
            if n >= _needed(len(item)):
                out.append((name, a + first, last - first, n))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def _rows_of_words(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The texts in order, in lists of about WORDS_AT_ONCE words; a longer text is alone."""
    row, size = [], 0
    for words in texts:
        if row and size + len(words) > WORDS_AT_ONCE:
            yield row
            row, size = [], 0
        row.append(words)
        size += len(words)
    if row:
        yield row


def _best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Bounds of the run with the most equal words of those with PERCENT equal, without changed ends."""
    run = np.concatenate([[0], np.cumsum(np.where(equal, 100 - PERCENT, -PERCENT))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # The longest run up to each end begins at the first place with no larger sum.
    begin = np.searchsorted(-np.minimum.accumulate(run), -run, "left")
    last = int(np.argmax(count - count[begin]))
    inside = np.flatnonzero(equal[begin[last] : last]) + begin[last]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark, block after block, each of about ``block_words`` words."""
    memory, items, size = _memory(), [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        found = _plain(text.encode(), memory)
        if len(found) < SHORTEST_ITEM:
            continue
        items.append((item_id, found))
        size += len(found)
        if size >= block_words:
            yield Index(items)
            items, size = [], 0
    yield Index(items)


def find(
    docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, name: str = "overlaps"
) -> DataFrame:
    """``docs`` with a column ``name``: an array of (item_id, first, words, equal), empty if clean.

    ``first`` and ``words`` count the document's words that have a letter or digit. Needs
    text in both tables and item_id in the benchmark; a column of the docs of that name is
    replaced. Null and empty texts have no overlaps, nor do items of under SHORTEST_ITEM words
    match. Repeated rows stay, each with its overlaps; repeated items are all named. Empty
    tables give no rows, or no overlaps. A benchmark larger than a block takes a pass over the
    documents for each block, with the result so far written in between.
    """
    names = [c for c in docs.columns if c != name]
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*numbered, F.array().cast(FOUND).alias("overlaps"))
    text = names.index("text")
    spark, first = docs.sparkSession, True
    for index in blocks(benchmark, block_words):
        if not first:
            rows = materialise(rows)
        first = False
        rows = _pass(rows, spark.sparkContext.broadcast(index), text)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("overlaps").alias(name))


def _pass(rows: DataFrame, index, text: int) -> DataFrame:
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("words", pa.int32()), ("equal", pa.int32())])
    )
    keys = ("item_id", "first", "words", "equal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seeds = _memory(), index.value
        for batch in batches:
            plain = [_plain(raw, memory) for raw in W.texts(batch.column(text))]
            met = [x for row in _rows_of_words(plain) for x in seeds.verified_all(row)]
            found = []
            for new, had in zip(met, batch.column(batch.num_columns - 1)):
                found.append((had.as_py() if len(had) else []) + [dict(zip(keys, x)) for x in new])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, kind)], names=batch.schema.names
            )

    return rows.mapInArrow(run, rows.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without overlaps, with their own columns."""
    name = "overlaps"
    while name in docs.columns:
        name += "_"
    return find(docs, benchmark, name=name).where(F.size(name) == 0).drop(name)
