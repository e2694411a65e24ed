"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, share of
byte-fallback tokens, entropy of the tokens, of all words. Texts that the vocabulary cuts into far more (or
fewer) tokens than others of their language, falls back on bytes for, or repeats few tokens
in, are rejected. The bands come from all documents: quartiles of each measure by language
(script where none is given) and length class, or where these are too few of the language, the
script, or all documents, widened by a multiple of their distance.
Distinct measurements count once, so copies don't move the bands.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm import words as W
from tillcast.session import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent
#: Distances of the quartiles that a value may lie below the first or above the third.
REACH = 3.0
REACH_UP = 6.0
#: The distance counts as this share of the median at least, so that narrow groups stay open.
LEAST_SPREAD = 0.01
#: A group of fewer distinct measurements has no band, and the next wider group's holds.
BAND_FROM = 30
SHORTEST, LONGEST = 5, 10  # length classes, as powers of two of the number of tokens
FALLBACK_ALLOWED = 0.05
#: Up to so many bands they are broadcast; there are a few for each language.
BROADCAST_BANDS = 100_000

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, "
    "script string"
)
NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _script(head: np.ndarray) -> str:
    """Script by the lead bytes of most letters of the text: latin, two_byte or wide."""
    lead = head[(head >= 0xC0) | ((head | 32) >= 97) & ((head | 32) <= 122) & (head < 128)]
    if not len(lead):
        return "none"
    kinds = [int((lead < 0xCA).sum()), int(((lead >= 0xCA) & (lead < 0xE0)).sum())]
    kinds.append(len(lead) - sum(kinds))
    return ("latin", "two_byte", "wide")[int(np.argmax(kinds))]


def _repeated(words: np.ndarray) -> int:
    """Words, given by their hashes, inside windows of WINDOW words that the text has at least twice."""
    h = W.windows(words, range(WINDOW), WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _dup_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


class Meter:
    """Measures texts; made once in each task."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

        def known(word: bytes) -> tuple[int, int, bytes]:
            plain = word.decode("utf-8", "replace")
            return xxhash.xxh64_intdigest(word), len(plain), array("i", model.encode(plain)).tobytes()

        # No piece joins over white space, so words can be cut one by one; hash, length and pieces
        # are remembered.
        self.words = W.Memory(known)

    def __call__(self, text: bytes | None) -> tuple:
        text = text or b""
        words = text.split()
        raw = np.frombuffer(text, np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        chars = int(((raw & 0xC0) != 0x80).sum()) - int(blank.sum())
        found = list(map(self.words.__getitem__, words))
        hashes = np.fromiter(map(itemgetter(0), found), np.uint64, len(found))
        pieces = np.frombuffer(b"".join(map(itemgetter(2), found)), np.intc)
        total = len(pieces)
        if total:
            tally = np.bincount(pieces)
            kinds = np.flatnonzero(tally)
            each = tally[kinds].astype(np.float64)
            share = each / total
            entropy = max(0.0, -float((share * np.log2(share)).sum()))
            measured = sum(map(itemgetter(1), found))
            fertility = (measured / total, float(each[self.byte[kinds]].sum()) / total, entropy)
        else:
            fertility = (None, None, None)
        return (
            len(words),
            chars,
            len(text) - len(text.translate(None, SYMBOLS)),
            _dup_lines(text),
            _repeated(hashes),
            total,
            *fertility,
            _script(raw),
        )


def measure(docs: DataFrame, carry: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``carry`` under numbers (c0, c1, ...), lang, and the measures of ``text``."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(*numbered, lang.alias("lang"))
    kept, at = rows, carry.index("text") if "text" in carry else len(carry) + 1
    if "text" not in carry:
        rows = docs.select(*numbered, lang.alias("lang"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(vocabulary)
        for batch in batches:
            found = list(zip(*map(meter, W.texts(batch.column(at)))))
            found = found or [()] * len(NAMES)
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
            columns = [pa.array(x, k) for x, k in zip(found, kinds)]
            n = len(carry) + 1
            yield pa.RecordBatch.from_arrays(
                batch.columns[:n] + columns, names=batch.schema.names[:n] + NAMES
            )

    return rows.mapInArrow(run, f"{kinds}, {MEASURES}")


def _base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _groups() -> list[Column]:
    """Names of the groups that a row belongs to, the narrowest first."""
    own = F.concat(F.lit("="), "kind")
    return [
        F.concat(F.col("length").cast("string"), own), own, F.concat(F.lit("script="), "script"), F.lit("all")
    ]


def bands(measured: DataFrame) -> DataFrame:
    """Bounds by group, over all documents the base rules pass."""
    rows = measured.where(~_base_failed() & (F.col("n_tokens") > 0))
    groups = F.explode(F.array(*_groups())).alias("band")
    # Distinct measurements: one row for all copies of a text.
    rows = rows.select(groups, "n_tokens", *FERTILITY).distinct()
    quarters = {m: F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in FERTILITY}
    table = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *quarters.values())

    def edges(m: str) -> tuple[Column, Column]:
        q = F.col(m)
        spread = F.greatest(q[2] - q[0], LEAST_SPREAD * F.abs(q[1]))
        return q[0] - REACH * spread, q[2] + REACH_UP * spread

    low, high = edges("chars_per_token")
    return table.where(F.col("n") >= BAND_FROM).select(
        "band",
        low.alias("chars_low"),
        high.alias("chars_high"),
        F.greatest(F.lit(FALLBACK_ALLOWED), edges("fallback_share")[1]).alias("fallback_high"),
        edges("token_entropy")[0].alias("entropy_low"),
    )


FERTILITY = ("chars_per_token", "fallback_share", "token_entropy")
BOUNDS = ("chars_low", "chars_high", "fallback_high", "entropy_low")


def _verdicts(docs: DataFrame, carry: list[str], vocabulary: str) -> DataFrame:
    # Two readers follow: the bands and the verdict.
    found = materialise(measure(docs, carry, vocabulary))
    length = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")
    found = found.withColumns(
        {
            "kind": F.coalesce("lang", F.concat(F.lit("script:"), "script")),
            "length": F.least(F.lit(LONGEST), F.greatest(F.lit(SHORTEST), length)),
            "base_failed": _base_failed(),
        }
    )
    table = materialise(bands(found))
    if table.count() <= BROADCAST_BANDS:
        table = F.broadcast(table)
    # The band of the narrowest group that has one.
    for i, group in enumerate(_groups()):
        own = table.select(F.col("band").alias(f"band{i}"), F.struct(*BOUNDS).alias(f"bounds{i}"))
        found = found.join(own, group == F.col(f"band{i}"), "left")
    bounds = F.coalesce(*[F.col(f"bounds{i}") for i in range(len(_groups()))])
    inside = (
        F.col("chars_per_token").between(bounds["chars_low"], bounds["chars_high"])
        & (F.col("fallback_share") <= bounds["fallback_high"])
        & (F.col("token_entropy") >= bounds["entropy_low"])
    )
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return found.withColumn("kept", kept)


def rate(docs: DataFrame, carry: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``carry`` of ``docs`` with the measures, ``base_failed`` and ``kept``.

    Needs text; uses lang if there is one. Measures replace carried columns of the same name.
    Null and empty texts have no words and fail. A null lang is judged by the text's script.
    Repeated rows stay and get the same verdict; there are no ties to break. An empty table
    gives no rows. Where all documents have under BAND_FROM distinct measurements, the base
    rules alone judge.
    """
    carry = [c for c in carry if c not in (*NAMES, "base_failed", "kept")]
    return _verdicts(docs, carry, vocabulary).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *NAMES, "base_failed", "kept"
    )


def keep_good(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their own columns and no others."""
    return _verdicts(docs, docs.columns, vocabulary).where("kept").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
