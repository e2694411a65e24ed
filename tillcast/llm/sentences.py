"""Repeated passages: spans of consecutive sentences that an earlier document has.

Every run of RUN sentences is a span, longer where these have too few words, and a shorter run
is one where it has many. Spans are hashed without case and spacing and compared over all
documents; the first document that has a span keeps it, and sentences that any of its other
occurrences covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm import words as W
from tillcast.llm.batches import bounded
from tillcast.session import materialise

RUN = 3
#: A span has so many words at least: chance does not repeat it.
FEWEST_WORDS = 15
#: So many words make a span of fewer than RUN sentences.
LONG_WORDS = 20
#: Text without a stop for more words is no sentence, such as lists and code. It is cut after the
#: word of least hash in every CUT words in a row: a piece has CUT words at most, and where it ends
#: depends on the CUT - 1 words on either side only. Any 50 words of it thus hold 25 in pieces
#: that are the same wherever the passage stands: RUN pieces and FEWEST_WORDS words or more, a span.
LONGEST = 40
CUT = 7
#: Spans that make up more than one in so many of all count as hot, so there are fewer of these.
HOT_SHARE = 1000
#: Hot spans are looked for among so many.
SAMPLED_SPANS = 1 << 20

# A sentence ends after its stops and the white space there, or at a line's end.
_ENDS = re.compile(rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)+[\"')\]]*[ \t\r\f\v]+|\n\s*")
_WORD = re.compile(rb"[^ \t-\r]+")


def _least(h: list[int]) -> list[int]:
    """Where the least value of any CUT in a row stands, the last one of equal ones."""
    out, at = [], -1
    for begin in range(len(h) - CUT + 1):
        end = begin + CUT
        if at < begin:
            at = min(range(begin, end), key=lambda i: (h[i], -i))
        elif h[end - 1] <= h[at]:
            at = end - 1
        else:
            continue
        out.append(at)
    return out


def cut(text: bytes) -> list[bytes]:
    """The sentences of a text; joined they are the text."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]
    out = []
    for part in parts:
        # A word takes two bytes at least, with the space after it.
        if len(part) < 2 * LONGEST or len(words := list(_WORD.finditer(part))) <= LONGEST:
            out.append(part)
            continue
        begin = 0
        for i in _least([xxhash.xxh32_intdigest(w[0].lower()) for w in words]):
            out.append(part[begin : words[i].end()])
            begin = words[i].end()
        if begin < len(part):
            out.append(part[begin:])
    return out


def spans(sentences: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first sentence, end, digest) of every span, in the order of the text."""
    plain = [b" ".join(s.lower().split()) for s in sentences]
    # Sentences without words belong to no span and break none.
    at = [i for i, p in enumerate(plain) if p]
    total = [0]
    for i in at:
        total.append(total[-1] + plain[i].count(b" ") + 1)
    n, bounds = len(at), set()
    for a in range(n):
        for b in range(a + 1, min(a + RUN, n + 1)):
            if total[b] - total[a] >= LONG_WORDS:
                bounds.add((a, b))
                break
        b = a + RUN
        while b <= n and total[b] - total[a] < FEWEST_WORDS:
            b += 1
        if b <= n:
            bounds.add((a, b))
        # Where the run that ends here has too few words, it begins earlier.
        low = a + 1 - RUN
        if low > 0 and total[a + 1] - total[low] < FEWEST_WORDS:
            while low >= 0 and total[a + 1] - total[low] < FEWEST_WORDS:
                low -= 1
            if low >= 0:
                bounds.add((low, a + 1))
    if n and not bounds and total[-1] >= FEWEST_WORDS:
        bounds.add((0, n))  # a text of fewer sentences than a run
    return [
        (at[a], at[b - 1] + 1, xxhash.xxh3_128_digest(b" ".join([plain[i] for i in at[a:b]])))
        for a, b in sorted(bounds)
    ]


def first_and_again(found: list[tuple[int, int, bytes]]) -> tuple[list, list]:
    """Spans at their first place in the text, and (begin, end) of what later places cover.

    A later place that runs into the first covers only what comes after it. Places that meet
    are one.
    """
    first: dict[bytes, tuple[int, int]] = {}
    again: list[tuple[int, int]] = []
    for a, b, digest in found:
        if digest not in first:
            first[digest] = (a, b)
        elif b > first[digest][1]:
            a = max(a, first[digest][1])
            if again and again[-1][0] <= a <= again[-1][1]:
                again[-1] = (again[-1][0], max(b, again[-1][1]))
            else:
                again.append((a, b))
    return [(a, b, digest) for digest, (a, b) in first.items()], again


def _located(docs: DataFrame) -> DataFrame:
    """Adds key (order of documents) and digest of the text name a document; text."""
    digest = F.xxhash64("text")
    # Rows without id come after all others, in the order of their texts.
    unknown = F.lit(2**62) + F.abs(F.shiftright(digest, 2))
    return docs.withColumns({"key": F.coalesce(F.col("id"), unknown), "digest": digest})


def _all_spans(docs: DataFrame) -> DataFrame:
    """The first place of every span of a text, and without hash what later places cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digests, begin, end, hashed = [], [], [], [], []
            for i, text in enumerate(W.texts(batch.column(2))):
                first, again = first_and_again(spans(cut(text or b"")))
                found = first + [(a, b, bytes(16)) for a, b in again]
                row += [i] * len(found)
                hashed += [True] * len(first) + [False] * len(again)
                for a, b, digest in found:
                    begin.append(a)
                    end.append(b)
                    digests.append(digest)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            none = ~np.array(hashed, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0], mask=none),
                    pa.array(halves[:, 1], mask=none),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(begin, pa.int32()),
                    pa.array(end, pa.int32()),
                ],
                names=["h1", "h2", "key", "digest", "begin", "end"],
            )

    kinds = "h1 long, h2 long, key long, digest long, begin int, end int"
    return docs.select("key", "digest", "text").mapInArrow(run, kinds)


def _hot_spans(found: DataFrame) -> DataFrame:
    """``h1, h2, hot``: spans that are frequent in a sample, with the first document of each.

    The sample only decides which way a span takes; the first document comes from all rows.
    """
    total = found.count()
    share = min(1.0, SAMPLED_SPANS / max(total, 1))
    frequent = (
        found.sample(share, 11)
        .where("h1 IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max(1.0, share * total / HOT_SHARE))
        .select("h1", "h2")
    )
    return (
        # Aggregated before the shuffle: a span of many documents is one row from each task.
        found.join(F.broadcast(materialise(frequent)), ["h1", "h2"])
        .groupBy("h1", "h2")
        .agg(F.min("key").alias("hot"))
    )


def _covered(found: DataFrame) -> DataFrame:
    """``key, digest, covered``: the places in a text that an earlier document or place has.

    Hot spans get their first document by a broadcast, whose size HOT_SHARE bounds, so none of
    them gathers in one task. All others are shuffled once and compared by a window.
    """
    known = found.join(F.broadcast(materialise(_hot_spans(found))), ["h1", "h2"], "left")
    place = ["key", "digest", "begin", "end"]
    # Later places in the same text have no hash.
    at_once = known.where("h1 IS NULL OR key <> hot").select(place)
    others = (
        known.where("h1 IS NOT NULL AND hot IS NULL")
        .select("h1", "h2", *place, F.min("key").over(Window.partitionBy("h1", "h2")).alias("first"))
        .where("key <> first")
        .select(place)
    )
    # A document has at most as many entries as it has spans.
    return (
        at_once.unionAll(others)
        .groupBy("key", "digest")
        .agg(F.collect_set(F.struct("begin", "end")).alias("covered"))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the cleaned text, and n_sentences, n_removed (long).

    Needs doc_id and text; columns called n_sentences or n_removed are replaced, all others
    stay. The first document is the one of least doc_id; rows without doc_id come last, in the
    order of a hash of their texts. Rows of one doc_id count as one document: what only they share stays.
    doc_id holds whole numbers or their decimal text. In a text that repeats itself the first
    place stays. Null texts stay null, empty ones empty;
    a text all of whose sentences were seen before becomes empty. An empty table gives no rows.
    Very long texts are cut and hashed whole; Arrow batches are bounded by bytes.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    bounded(docs.sparkSession)
    rows = _located(docs.select(*numbered, F.col("doc_id").cast("long").alias("id"), "text"))
    rows = rows.withColumn("digest", F.coalesce("digest", F.lit(0)))
    found = materialise(_all_spans(rows))
    covered = _covered(found)
    marked = rows.join(covered, ["key", "digest"], "left")
    others = [f"c{i}" for i, c in enumerate(names) if c != "text"]
    columns = marked.select(*others, "text", "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count, removed = [], [], []
            ends = batch.column(batch.num_columns - 1).to_pylist()
            for text, elsewhere in zip(W.texts(batch.column(len(others))), ends):
                sentences = cut(text or b"")
                drop = np.zeros(len(sentences) + 1, bool)
                for x in elsewhere or []:
                    drop[x["begin"] : x["end"]] = True
                kept = [s for s, d in zip(sentences, drop) if not d]
                out.append(None if text is None else b"".join(kept))
                count.append(len(sentences))
                removed.append(len(sentences) - len(kept))
            columns = [pa.array(out, pa.binary()).cast(pa.string())]
            columns += [pa.array(count, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], *columns],
                names=[*others, "text", "n_sentences", "n_removed"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns.schema[: len(others)])
    done = columns.mapInArrow(run, f"{kinds}text string, n_sentences long, n_removed long")
    return done.select(
        *[F.col("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        "n_sentences",
        "n_removed",
    )
