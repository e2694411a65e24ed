"""Fill-in-the-middle forms, whose cuts are found on a wavelet matrix of character classes.

A task joins the bytes of many texts to one sequence and gives every byte a class of three
bits: white space, continuation of a code point, last byte of a run of its kind of word. The
wavelet matrix of the classes answers how often a class stands before a place. The ranks of
the two classes that end a word add up to the number of units ended so far, those of the two
continuing classes tell code points from bytes, and a bisection on the first of these sums
finds the byte where a number of units ends, for all texts of the sequence at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.batches import bounded

#: Bits of a byte's class.
LAST, CONTINUES, SPACE = 1, 2, 4
CLASS_BITS = 3
#: Bytes that one wavelet matrix is built for; a longer text has one of its own.
SEQUENCE_BYTES = 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


class WaveletMatrix:
    """Ranks of the symbols of a sequence, one bit a level, from the highest bit down.

    A level keeps its bits, 64 to a word, and the ones before each word; those below sort the
    sequence by the bits above, zeros first. Takes about a quarter byte a symbol and level.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        begin, end = np.zeros(1, np.int64), places
        for level, (words, before, zeros) in enumerate(self.levels):
            first, last = self._ones(words, before, begin), self._ones(words, before, end)
            if symbol >> (self.bits - 1 - level) & 1:
                begin, end = zeros + first, zeros + last
            else:
                begin, end = begin - first, end - last
        return end - begin


class Sequence:
    """Texts joined to one sequence, with the counts that cutting asks for."""

    def __init__(self, texts: list[bytes]):
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        space = _SPACES[raw]
        closes = np.ones(len(raw), bool)  # the next byte is white space or of another text
        closes[:-1] = space[1:]
        closes[self.ends[self.ends > self.starts] - 1] = True
        kind = np.where(space, SPACE, (raw & 0xC0 == 0x80) * np.uint8(CONTINUES)).astype(np.uint8)
        self.matrix = WaveletMatrix(kind + (closes & ~space) * np.uint8(LAST), CLASS_BITS)
        full = self.ends > self.starts
        self.trailing = np.zeros(len(texts), bool)
        self.trailing[full] = space[self.ends[full] - 1]

    def words(self, places: np.ndarray) -> np.ndarray:
        """Words that end before each place."""
        return self.matrix.rank(LAST, places) + self.matrix.rank(CONTINUES | LAST, places)

    def characters(self, places: np.ndarray) -> np.ndarray:
        """Code points that begin before each place."""
        inside = self.matrix.rank(CONTINUES, places) + self.matrix.rank(CONTINUES | LAST, places)
        return places - inside

    def units(self) -> np.ndarray:
        """Units of each text: words with the white space before them, and white space at its end."""
        return self.words(self.ends) - self.words(self.starts) + self.trailing

    def cuts(self, wanted: np.ndarray) -> np.ndarray:
        """The place in each text where its first ``wanted`` units end."""
        goal = self.words(self.starts) + wanted
        low, high = self.starts.copy(), self.ends.copy()
        # The least place by which so many words have ended, or else the end of the text.
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            reached = self.words(middle) >= goal
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low


def _draws(key: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _form(text: bytes, draws: tuple[int, ...], rate: int, spm_rate: int) -> str:
    marked = any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or draws[2] % 100 >= rate:
        return "plain"
    return "spm" if draws[3] % 100 < spm_rate else "psm"


def _split(texts: list[bytes], draws: list[tuple[int, ...]], rate: int, spm_rate: int) -> list[tuple]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    found = Sequence(texts)
    units = found.units()
    one, two = (np.array([d[i] for d in draws], np.int64) % (units + 1) for i in (0, 1))
    first, second = (found.cuts(wanted) for wanted in (np.minimum(one, two), np.maximum(one, two)))
    before = [found.characters(places) for places in (found.starts, first, second)]
    chars = before[1] - before[0], before[2] - before[1]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for i, (text, drawn) in enumerate(zip(texts, draws)):
        form = _form(text, drawn, rate, spm_rate)
        if form == "plain":
            out.append((int(units[i]), form, None, None, text))
            continue
        a, b = int(first[i] - found.starts[i]), int(second[i] - found.starts[i])
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if form == "psm":
            joined = b"".join([p, prefix, s, suffix, m, middle])
        else:
            joined = b"".join([s, suffix, p, prefix, m, middle])
        out.append((int(units[i]), form, int(chars[0][i]), int(chars[1][i]), joined))
    return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SEQUENCE_BYTES together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SEQUENCE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def transform(
    docs: DataFrame, carry: list[str] | None = None, seed: int = 42, rate: int = 50, spm_rate: int = 80
) -> DataFrame:
    """The columns ``carry`` with n, form, prefix_chars, middle_chars and output.

    A text is cut into n units: a word (anything but space and the control characters 9 to 13)
    with the white space before it, and white space at the end. Two cuts between units, drawn
    by a hash of ``seed`` and doc_id, part prefix, middle and suffix. ``rate`` percent of the
    texts are rearranged, of these ``spm_rate`` percent with the suffix first; empty texts and
    those with a marker in them stay ``plain``, as do the others. In a plain row the two
    lengths, in code points, are null. ``restore`` gives the text back from output and form.

    A null text counts as empty; a null doc_id draws as an empty id. Repeated rows and rows of
    equal ids are each cut on their own, by the same draw. Carried columns of the result's
    names are replaced. An empty table gives no rows. A row never meets another, so a key of any
    share of the rows is no matter; a text of any length takes memory in proportion to its own.
    """
    bounded(docs.sparkSession)
    carry = [c for c in carry or docs.columns if c not in ADDED]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
        F.col("doc_id").cast("long").alias("key"),
        F.col("text").cast("binary").alias("raw"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 2
            texts = [t or b"" for t in batch.column(width + 1).to_pylist()]
            draws = [_draws(key, seed) for key in batch.column(width).to_pylist()]
            for begin, end in _chunks(texts):
                found = _split(texts[begin:end], draws[begin:end], rate, spm_rate)
                n, form, prefix, middle, output = zip(*found)
                added = [
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ]
                kept = [c.slice(begin, end - begin) for c in batch.columns[:width]]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=[*batch.schema.names[:width], *ADDED])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][: len(carry)]
    kinds.append("n long, form string, prefix_chars long, middle_chars long, output string")
    out = rows.mapInArrow(run, ", ".join(kinds))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *ADDED)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made this output from.

    No part holds a marker, so each marker's first occurrence is the one that was put there.
    """
    part = "(.*?)"
    psm = f"(?s)^{PREFIX}{part}{SUFFIX}{part}{MIDDLE}(.*)$"
    spm = f"(?s)^{SUFFIX}{part}{PREFIX}{part}{MIDDLE}(.*)$"
    return (
        F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(output)
    )
