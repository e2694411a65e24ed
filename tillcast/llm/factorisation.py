"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of the text's structure, binned and as numbers, and its
length as the table gives it. Besides a weight every feature has a vector of RANK numbers, and
each pair of features counts with the product of their vectors; by the identity of the square
of the sum and the sum of the squares this takes time in proportion to the features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm import words as W

BUCKETS = 1 << 16
RANK = 8
BINS = 8
#: The classifier is fitted on so many labelled rows at most, a hash of doc_id deciding which.
FIT_ROWS = 20_000
EPOCHS, LOT, RATE, DECAY = 6, 128, 0.1, 1e-5
THRESHOLD = 0.7
#: Of the fitted rows, one in so many is held back to scale the scores.
SCALE_EVERY = 5

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+\\/{}[]", np.uint8)
_STOPS = np.frombuffer(b".!?", np.uint8)
_MARKS = np.frombuffer(b",;:'\"()-", np.uint8)
STATISTICS = 19


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def describe(text: bytes | None, n_chars: float | None, memory: W.Memory) -> tuple[np.ndarray, ...]:
    """Word buckets, their values, and the statistics of a text."""
    text = text or b""
    words = text.lower().split()
    h = W.ids(words, memory)
    bucket, count = np.unique(h & np.uint64(BUCKETS - 1), return_counts=True)
    value = np.sqrt(count)
    value = value / np.sqrt((value**2).sum()) if len(value) else value
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = max(1, len(text)), max(1, len(words))
    letters = max(1, int(raw[_UPPER].sum() + raw[_LOWER].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    most = count.max() if len(count) else 0
    length = np.log1p(len(text))
    statistics = np.array(
        [
            np.log1p(len(words)),
            raw[_UPPER].sum() / letters,
            raw[_DIGITS].sum() / size,
            raw[_SYMBOLS].sum() / size,
            raw[_STOPS].sum() / n,
            raw[33] / n,
            raw[_MARKS].sum() / size,
            raw[124] / n,
            raw[128:].sum() / size,
            (len(text) - raw[9:14].sum() - raw[32]) / n,
            len(bucket) / n,
            most / n,
            float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0,
            np.log1p(len(lines)),
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))),
            sum(k for w, k in Counter(words).items() if w.isalpha()) / n,
            length,
            np.log1p(n_chars or 0) - length,
        ]
    )
    return bucket.astype(np.int64), value, statistics


class Machine:
    """Weights; ``scores`` of described texts."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, edges: np.ndarray):
        self.mean, self.spread, self.edges = mean, spread, edges
        size = BUCKETS + STATISTICS * (BINS + 1)
        self.bias = 0.0
        self.weight = np.zeros(size, np.float32)
        self.vectors = np.random.default_rng(3).normal(0, 0.02, (size, RANK)).astype(np.float32)
        self.slope, self.shift = 1.0, 0.0

    def features(self, described: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts on end, and where each text starts."""
        statistics = np.array([d[2] for d in described])
        numbers = np.clip((statistics - self.mean) / self.spread, -4, 4) / 4
        bins = (statistics[:, :, None] > self.edges[None]).sum(2)
        base = BUCKETS + STATISTICS * BINS
        index, value, starts = [], [], [0]
        own = np.arange(STATISTICS)
        for d, x, b in zip(described, numbers, bins):
            index += [d[0], BUCKETS + own * BINS + b, base + own]
            value += [d[1], np.full(STATISTICS, 0.3), x]
            starts.append(starts[-1] + len(d[0]) + 2 * STATISTICS)
        return np.concatenate(index), np.concatenate(value).astype(np.float32), np.array(starts[:-1])

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the sums of the vectors of each text."""
        linear = np.add.reduceat(self.weight[index] * value, starts)
        terms = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(terms, starts, axis=0)
        squares = np.add.reduceat((terms**2).sum(1), starts)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, described: list[tuple]) -> np.ndarray:
        if not described:
            return np.zeros(0)
        logits = self.raw(*self.features(described))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def fit(described: list[tuple], labels: np.ndarray) -> Machine:
    """A machine fitted by stochastic gradients with a step that shrinks for each weight."""
    if not described:
        return Machine(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, BINS - 1)))
    statistics = np.array([d[2] for d in described])
    spread = statistics.std(0)
    edges = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T
    machine = Machine(statistics.mean(0), np.where(spread > 0, spread, 1), edges)
    back = np.arange(len(described)) % SCALE_EVERY == SCALE_EVERY - 1
    learn = np.flatnonzero(~back)
    rate = np.clip(labels[learn].mean(), 0.01, 0.99) if len(learn) else 0.5
    machine.bias = float(np.log(rate / (1 - rate)))
    seen_w = np.full(len(machine.weight), 1e-2, np.float32)
    seen_v = np.full(machine.vectors.shape, 1e-2, np.float32)
    draw = np.random.default_rng(5)
    for _ in range(EPOCHS):
        draw.shuffle(learn)
        for at in range(0, len(learn), LOT):
            lot = learn[at : at + LOT]
            index, value, starts = machine.features([described[i] for i in lot])
            logits, sums = machine.raw(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[lot]).astype(np.float32)
            sizes = np.diff([*starts, len(index)])
            own = np.repeat(np.arange(len(lot)), sizes)
            push = error[own] * value
            pull = push[:, None] * (sums[own] - machine.vectors[index] * value[:, None])
            # Gradients of one feature are added up before the step.
            order = np.argsort(index, kind="stable")
            touched, first = np.unique(index[order], return_index=True)
            grad_w = np.add.reduceat(push[order], first) + DECAY * machine.weight[touched]
            grad_v = np.add.reduceat(pull[order], first, axis=0) + DECAY * machine.vectors[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            machine.weight[touched] -= RATE * grad_w / np.sqrt(seen_w[touched])
            machine.vectors[touched] -= RATE / 2 * grad_v / np.sqrt(seen_v[touched])
            machine.bias -= RATE * float(error.mean())
    _scale(machine, [described[i] for i in np.flatnonzero(back)], labels[back])
    return machine


def _scale(machine: Machine, described: list[tuple], labels: np.ndarray) -> None:
    """Slope and shift that make scores of rows not learnt from probabilities."""
    if len(described) < 50 or labels.min() == labels.max():
        return
    logits = np.concatenate(
        [machine.raw(*machine.features(described[i : i + 512]))[0] for i in range(0, len(described), 512)]
    ).astype(np.float64)
    # One row of either class more keeps the slope finite.
    x = np.concatenate([logits, [logits.max(), logits.min()]])
    y = np.concatenate([labels, [0.0, 1.0]])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((p - y) * x).sum(), (p - y).sum()])
        bend = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(bend + 1e-6 * np.eye(2), gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if np.isfinite(a) and np.isfinite(b) and a > 0:
        machine.slope, machine.shift = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """A machine for labels.quality, fitted on at most about ``rows`` rows outside the held-out fold.

    Rows with a null or repeated label count once, with the mean of their labels, rounded.
    The texts are described in the cluster; the driver gets the sample's features.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(fold(F.col("doc_id"), 4) != 2)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.round(F.avg("quality")).alias("label"))
    )
    share = min(1.0, rows / max(1, known.count()))
    unit = (F.xxhash64(F.lit(11), "doc_id") / F.lit(2.0**64)) + 0.5
    # The sample has about `rows` rows, which bounds the broadcast.
    drawn = F.broadcast(known.where(unit < share))
    chosen = _inputs(docs).withColumn("doc_id", docs["doc_id"].cast("long")).join(drawn, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = W.hashes()
        for batch in batches:
            rows = zip(W.texts(batch.column(2)), batch.column(3).to_pylist())
            found = [describe(t, c, memory) for t, c in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([d[0].astype(np.uint16).tobytes() for d in found], pa.binary()),
                    pa.array([d[1].astype(np.float32).tobytes() for d in found], pa.binary()),
                    pa.array([d[2].tobytes() for d in found], pa.binary()),
                ],
                names=["doc_id", "label", "buckets", "counts", "statistics"],
            )

    kinds = "doc_id long, label double, buckets binary, counts binary, statistics binary"
    got = chosen.select("doc_id", "label", "text", "n_chars").mapInArrow(run, kinds).toArrow()
    order = sorted(
        zip(*[got.column(c).to_pylist() for c in ("doc_id", "buckets", "counts", "statistics", "label")])
    )
    described = [
        (np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(v, np.float32), np.frombuffer(s))
        for _, b, v, s, _ in order
    ]
    return fit(described, np.array([x[4] for x in order]))


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", chars.cast("double").alias("n_chars"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    Needs doc_id and text and uses n_chars (null or missing: 0); other columns, among them
    lang and source, are not looked at. Null and empty texts are scored by their statistics.
    Repeated rows stay, with equal scores; a null doc_id stays null. An empty table gives no
    rows. A machine without labels scores one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, own = W.hashes(), shared.value
        for batch in batches:
            rows = list(zip(W.texts(batch.column(1)), batch.column(2).to_pylist()))
            parts = [np.zeros(0)]
            for at in range(0, len(rows), 256):
                parts.append(own.scores([describe(t, c, memory) for t, c in rows[at : at + 256]]))
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _inputs(docs).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
