"""Scores of whole texts by a gated recurrent language model.

Words are counted over all training texts. The WORDS most frequent and the end are units of the
model; all other words fall into BUCKETS by their first and last letters, each bucket a unit.
The model (gru.py) gives the chance of the units, and inside its bucket a word has its share of
the counts, an unknown one that of half a word. So a text's probability needs the counts of all its
words: the HEAD most frequent come as a broadcast of that size, the rest by a join.

Learners in parallel fit copies of the model to parts of the training texts, and the model is their
average, weighted by what each has read. That is done in rounds, each with texts of its own, and a
round goes on from the average of the one before.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm import gru
from tillcast.llm import words as W
from tillcast.llm.batches import bounded
from tillcast.session import materialise, scratch

WORDS, BUCKETS = 1023, 1024
#: Words whose counts are broadcast.
HEAD = 1 << 18
#: Rounds of fitting and averaging; a text is read in one of them.
ROUNDS = 4
#: Units for one learner: with fewer, fewer learners.
LEARNER_UNITS = 1 << 20
#: Of what a learner reads, one text in so many, and so many units at most, are put aside to
#: choose how far to go from the unigram model, and read in the end.
ASIDE_EVERY, ASIDE_UNITS = 16, 1 << 15
#: Learners whose parameters one task averages.
FAN = 64
SHARES = (1.0, 0.6, 0.3, 0.1, 0.0)
_BLOCK = 1 << 14
_END = -1  # the bucket that stands for the end in the counts


def held_out(doc_id: Column) -> Column:
    """Whether a text is kept from training; one without id is not."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(part == 1, F.lit(False))


def _bucket(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[:3] + b"|" + word[-2:]) % BUCKETS


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """``h, bucket, n``: occurrences of each word, by its 64-bit hash, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, numbers, _ = W.distinct(batch.column(0))
            h = np.append(_hashes(words), 0)
            bucket = [_bucket(w) for w in words] + [_END]
            n = np.append(np.bincount(numbers, minlength=len(words)), batch.num_rows)
            columns = [h, np.array(bucket, np.int32), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "bucket", "n"])

    found = docs.select("text").mapInArrow(run, "h long, bucket int, n long")
    return found.groupBy("h", "bucket").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What the tasks need to know of the words; its size is fixed by the head and BUCKETS."""

    def __init__(self, head: tuple[np.ndarray, ...], buckets: dict[int, tuple[int, int]]):
        """``head``: h, bucket and n by falling n; ``buckets``: (n, words) of each, _END the end."""
        self.hashes, bucket, often = head
        self.head = len(self.hashes)
        # The hashes in order, to be searched, and the rank of each in the head.
        self.ranks = np.argsort(self.hashes)
        self.ordered = self.hashes[self.ranks]
        self.ends = buckets.get(_END, (0, 0))[0]
        self.total = sum(n for n, _ in buckets.values())
        kinds = sum(k for _, k in buckets.values())
        self.norm = float(np.log10(self.total + 0.5 * (kinds + 1)))
        mass = np.zeros(BUCKETS)
        words = np.zeros(BUCKETS)
        for b, (n, k) in buckets.items():
            if b != _END:
                mass[b], words[b] = n, k
        top = [(int(h), int(b)) for h, b in zip(self.hashes[:WORDS], bucket[:WORDS])]
        np.subtract.at(mass, bucket[:WORDS], often[:WORDS])
        np.subtract.at(words, bucket[:WORDS], 1)
        mass += 0.5 * (words + 1)
        # Words stand by the bucket they would be in, so classes hold words of like letters.
        own = [(_END, 0, 0)] + [(b, 0, h) for h, b in top] + [(b, 1, 0) for b in range(BUCKETS)]
        place = {x: i for i, x in enumerate(sorted(own))}
        size = -(-len(own) // gru.CLASSES)
        units = np.zeros(gru.CLASSES * size)
        self.end = place[(_END, 0, 0)]
        units[self.end] = self.ends + 0.5
        bucket_unit = np.array([place[(b, 1, 0)] for b in range(BUCKETS)])
        units[bucket_unit] = mass
        # A code is the word's rank in the head, or the head's size and its bucket.
        self.unit = np.concatenate([bucket_unit[bucket], bucket_unit]).astype(np.int32)
        self.unit[: len(top)] = [place[(b, 0, h)] for h, b in top]
        units[self.unit[: len(top)]] = often[:WORDS] + 0.5
        logs = np.log10(often + 0.5)
        self.logs = np.concatenate([logs, np.zeros(BUCKETS)])
        self.inside = np.concatenate([logs, np.zeros(BUCKETS)]) - np.log10(mass)[np.append(bucket, np.arange(BUCKETS))]
        self.inside[: len(top)] = 0
        self.masses = units.reshape(gru.CLASSES, size)

    def codes(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The codes of words, given with their hashes."""
        if not self.head:
            return self.head + np.array([_bucket(w) for w in words], np.int64)
        place = np.minimum(np.searchsorted(self.ordered, hashes), self.head - 1)
        codes = self.ranks[place]
        others = np.flatnonzero(self.ordered[place] != hashes)
        codes[others] = [self.head + _bucket(words[i]) for i in others.tolist()]
        return codes


def vocabulary(counts: DataFrame, head_words: int = HEAD) -> Vocabulary:
    """The head of the counts and a sum for each bucket, the only counts the driver gets."""
    words = counts.where(F.col("bucket") != _END)
    head = words.orderBy(F.desc("n"), "h").limit(head_words).select("h", "bucket", "n").toArrow()
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    h, bucket, n = (head.column(c).to_numpy().astype(np.int64) for c in ("h", "bucket", "n"))
    order = np.lexsort([h, -n])
    return Vocabulary((h[order], bucket[order], n[order]), {r.bucket: (r.n, r.k) for r in sums})


def _shrunk(weights: gru.Weights, start: np.ndarray, aside: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The parameters on the way from the start that suit the texts put aside best, and how far.

    The start is the unigram model, so what little text teaches wrongly does no harm.
    """
    end, shares = weights.flat(), SHARES if aside else (1.0,)
    mixes = [start + np.float32(share) * (end - start) for share in shares]
    models = [copy.deepcopy(weights) for _ in mixes]
    for model, mixed in zip(models, mixes):
        model.load(mixed)
    fits = gru.score_each(models, aside).sum(1) if aside else [0.0]
    best = int(np.argmax(fits))
    return mixes[best], shares[best]


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Texts as the model reads them, written: the words are looked up here and nowhere else.

    Needs doc_id, text and held_out. ``units`` are two bytes each; ``base`` and ``inside`` add up logarithms over
    the end and the words of the head, of which ``n_known`` counts those seen, and ``tail`` are the other words.
    ``place`` numbers the rows that are trained on, ``row`` all, ``tie`` is a hash of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        end = np.log10(known.ends + 0.5)
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            units, n, base, inside, tails = [], [], [], [], []
            words, numbers, bounds = W.distinct(batch.column(1))
            hashes = _hashes(words)
            every = known.codes(words, hashes)[numbers]
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                codes = every[a:b]
                units.append(np.append(known.unit[codes], np.int32(known.end)).astype(np.uint16).tobytes())
                n.append(b - a + 1)
                base.append(float(known.logs[codes].sum()))
                inside.append(float(known.inside[codes].sum()))
                tails.append(hashes[numbers[a:b][codes >= known.head]])
            n = np.array(n)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
            heads = n - 1 - np.diff(starts) + (known.ends > 0)
            trained = ~batch.column(2).to_numpy(zero_copy_only=False)
            places = place + np.cumsum(trained) - trained
            place += int(trained.sum())
            values = [
                pa.array(n.astype(np.int64)),
                pa.array(heads.astype(np.int64)),
                pa.array(np.array(base) + end - n * known.norm),
                pa.array(np.array(inside)),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(tails))),
                pa.array(units, pa.binary()),
                pa.array(places.astype(np.int64)),
            ]
            names = ["doc_id", "held_out", "row", "tie", "n_tokens", "n_known", "base", "inside", "tail", "units", "place"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *values], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, row long, tie long, n_tokens long, n_known long, base double, "
        "inside double, tail array<bigint>, units binary, place long"
    )
    tie = F.xxhash64("text").alias("tie")
    numbered = docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"), tie)
    # Row numbers hold from here on, since they are written.
    return materialise(numbered.mapInArrow(run, schema))


def _units(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16).astype(np.int32) for b in column.to_pylist()]


def fit(docs: DataFrame, vocab: Vocabulary) -> gru.Weights:
    """The average of models that learners fit to all texts, in ROUNDS."""
    return _fit(encode(docs.select("doc_id", "text", F.lit(False).alias("held_out")), vocab), vocab)


def _fit(coded: DataFrame, vocab: Vocabulary) -> gru.Weights:
    weights = gru.Weights(vocab.masses)
    spark = coded.sparkSession
    learners = max(1, vocab.total // ROUNDS // LEARNER_UNITS)
    # The id decides who reads a text and when, so copies are spread, and files and partitions
    # make no difference. Rows without id are dealt by their place.
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    deal = F.xxhash64(F.lit(23), F.coalesce(own, F.xxhash64("place")))
    dealt = coded.where(~F.col("held_out")).select("units", "tie", deal.alias("deal"))
    for turn in range(ROUNDS):
        read = (
            dealt.where(F.pmod("deal", F.lit(ROUNDS)) == turn)
            .repartition(learners, F.shiftright("deal", 8))
            # A session that shuffles into more partitions makes no more learners.
            .coalesce(learners)
            .sortWithinPartitions("deal", "tie")
        )
        with scratch(spark):
            _fit_round(read.select("units"), spark.sparkContext.broadcast(weights), weights)
    return weights


def _fit_round(read: DataFrame, shared, weights: gru.Weights) -> None:
    """Loads the average of what learners make of the shared weights into ``weights``.

    Every partition of ``read`` is a learner's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        aside: list[np.ndarray] = []

        def texts() -> Iterator[np.ndarray]:
            n = 0
            for batch in batches:
                for units in _units(batch.column(0)):
                    n += 1
                    if n % ASIDE_EVERY == 0 and sum(map(len, aside)) < ASIDE_UNITS:
                        aside.append(units)
                    else:
                        yield units

        # What the worker holds of the shared weights must stay as it is.
        mine = copy.deepcopy(own)
        start = own.flat()
        seen, had = gru.train(mine, texts())
        if seen:
            flat, share = _shrunk(mine, start, aside)
            mine.load(flat)
            seen += gru.train(mine, iter(aside), had)[0]
            flat = flat + np.float32(share) * (mine.flat() - flat)
            blocks = [flat[a : a + _BLOCK] for a in range(0, len(flat), _BLOCK)]
            who = TaskContext.get().partitionId()
            columns = [range(len(blocks)), [who] * len(blocks), [seen] * len(blocks), [b.tobytes() for b in blocks]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "who", "seen", "values"])

    def average(part: pa.Table) -> pa.Table:
        part = part.sort_by("who")
        seen = np.array(part.column("seen").to_pylist(), np.float64)
        rows = [np.frombuffer(v, np.float32) for v in part.column("values").to_pylist()]
        mean = sum(n * row for n, row in zip(seen / seen.sum(), rows)).astype(np.float32)
        first = {c: [part.column(c)[0].as_py()] for c in ("block", "who")}
        return pa.table(
            {
                "block": pa.array(first["block"], pa.int32()),
                "who": pa.array(first["who"], pa.int32()),
                "seen": pa.array([int(seen.sum())], pa.int64()),
                "values": [mean.tobytes()],
            }
        )

    kinds = "block int, who int, seen long, values binary"
    found = materialise(read.mapInArrow(run, kinds))
    # Averages of averages: no task meets more than FAN rows of 64 kB.
    learners = 1 + (found.agg(F.max("who")).first()[0] or 0)
    while learners > 1:
        found = found.groupBy("block", F.floor(F.col("who") / FAN).cast("int").alias("group")).applyInArrow(
            average, kinds
        )
        found = found.withColumn("who", F.floor(F.col("who") / FAN).cast("int"))
        learners = -(-learners // FAN)
    got = found.select("block", "values").collect()
    if got:
        weights.load(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(got)]))


def score_texts(docs: DataFrame, head_words: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Needs doc_id and text; other columns are ignored. Null and empty texts have one token, the
    end. Rows without doc_id are trained on. Repeated rows are counted and scored as often as
    they occur. An empty table gives no rows; where nothing can be trained on, every token has
    probability one in the base, and the model knows only unknown words. Very long texts are read
    and scored whole, in room that grows with their words.
    """
    bounded(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = materialise(count_words(rows.where(~F.col("held_out"))))
    vocab = vocabulary(counts, head_words)
    coded = encode(rows, vocab)
    shared = docs.sparkSession.sparkContext.broadcast(_fit(coded, vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            inside = batch.column("inside").to_numpy()
            model = gru.score(own, _units(batch.column("units"))) / np.log(10) + inside
            kept = [batch.column(name) for name in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model)], names=names)

    names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "model"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, model double"
    read = coded.select(*names[:-1], "inside", "units")
    scored = materialise(read.mapInArrow(run, schema))
    rare = coded.select("row", F.explode("tail").alias("h"))
    logs = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    rest = (
        rare.join(counts.where(F.col("bucket") != _END).select("h", "n"), "h", "left")
        .groupBy("row")
        .agg(F.sum(logs).alias("logs"), F.count("n").alias("known"))
    )
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(int(vocab.total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
