import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from samples import awkward, documents, low, prose, words

from tillcast.llm import gru, language_model


def hashed(word):
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode())).astype(np.int64))


def plain_base(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    split = [[*words(low(t)), None] for _, t in rows]
    tally = Counter(x for w, out in zip(split, held) if not out for x in w)
    total, kinds = sum(tally.values()), len(tally)
    return [
        (
            d, out, len(w), sum(tally[x] > 0 for x in w), total,
            sum(np.log10((tally[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w),
        )
        for (d, _), w, out in zip(rows, split, held)
    ]


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def compare(found, rows):
    def key(r):
        return str([None if x != x else x for x in r[:5]]), round(r[5], 6)

    got = sorted((tuple(r) for r in found[COLUMNS].astype(object).itertuples(index=False)), key=key)
    for g, w in zip(got, sorted(plain_base(rows), key=key), strict=True):
        assert (g[0] == w[0] or g[0] != g[0]) and g[1:5] == w[1:5] and abs(g[5] - w[5]) < 1e-6 * (1 + abs(w[5]))


@pytest.mark.parametrize("head", [language_model.HEAD, 1200])
def test_base_and_held_out_gain(spark, head):
    """With a small head most words take the way through the join."""
    one = prose(1, 4000, 1500).split()
    two = [w[::-1] + "x" for w in prose(2, 4000, 1500).split()]
    rows = []
    for i in range(3000):
        kind, draw = (one, two)[i % 2], np.random.default_rng(i)
        rows.append((i, " ".join(kind[k] for k in draw.integers(0, 4000, 60))))
    found = language_model.score_texts(documents(spark, rows, False), head).toPandas()
    compare(found, rows)
    held = found[found.held_out]
    # Words of two languages never mix in a text, which the state can see.
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.8


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward()]
    found = language_model.score_texts(documents(spark, rows)).toPandas()
    compare(found, rows)
    assert np.isfinite(found.score).all() and (found.score < 0).all()
    assert language_model.score_texts(documents(spark, [])).count() == 0


def test_chances_add_up_to_one():
    mass = np.random.default_rng(0).random((gru.CLASSES, 5)) + 0.1
    weights = gru.Weights(mass)
    texts = [np.random.default_rng(i).integers(0, mass.size, 30).astype(np.int32) for i in range(40)]
    gru.train(weights, iter(texts))
    before = np.array([3, 7, 11], np.int32)
    lead = gru.score(weights, [before])[0]
    every = gru.score(weights, [np.append(before, np.int32(u)) for u in range(mass.size)])
    assert abs(np.exp(every - lead).sum() - 1) < 1e-4


def test_state_goes_on_over_windows():
    """A text scored whole equals its score step by step in any company."""
    mass = np.ones((gru.CLASSES, 4))
    weights = gru.Weights(mass)
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, mass.size, n).astype(np.int32) for n in (1, 5, 33, 200, 1000, 64, 2)]
    gru.train(weights, iter(texts))
    alone = [gru.score(weights, [t])[0] for t in texts]
    assert np.allclose(gru.score(weights, texts), alone, rtol=1e-4)


def plain_score(weights, text):
    """The model unit by unit, in double precision."""
    p = {k: v.astype(float) for k, v in weights.p.items()}
    n, h, before, total = gru.STATE, np.zeros(gru.STATE), weights.units, 0.0
    for unit in text:
        x, g = p["x"][before] + p["b"], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[a : a + n] + g[a : a + n]))) for a in (0, n))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :])
        kind, place = divmod(int(unit), weights.size)
        for scores, i in ((h @ p["c"][:-1] + p["c"][-1], kind), (h @ p["w"][kind][:-1] + p["w"][kind][-1], place)):
            total += scores[i] - np.log(np.exp(scores).sum())
        before = unit
    return total


def trained(seed=3):
    weights = gru.Weights(np.random.default_rng(seed).random((gru.CLASSES, 4)) + 0.1)
    draw = np.random.default_rng(seed)
    texts = [draw.integers(0, weights.units, n).astype(np.int32) for n in (1, 5, 33, 200, 3000, 64, 2)]
    gru.train(weights, iter(texts))
    return weights, texts


def test_scores_equal_the_model_unit_by_unit():
    weights, texts = trained()
    assert np.allclose(gru.score(weights, texts), [plain_score(weights, t) for t in texts], rtol=1e-4)


def test_gradients_equal_differences():
    """The way back of a window, against small changes of the inputs' and the states' parts."""
    weights, _ = trained()
    draw = np.random.default_rng(1)
    inputs = draw.integers(0, weights.units, (gru.STEPS, 6))
    fresh = np.zeros(inputs.shape, bool)
    fresh[0, :2] = fresh[4, 3] = True
    first = draw.normal(0, 0.5, (6, gru.STATE)).astype(np.float32)
    pull = draw.normal(0, 1, (*inputs.shape, gru.STATE)).astype(np.float32)

    def value():
        return float((gru._forward(weights.p, inputs, fresh, first, None) * pull).sum(dtype=float))

    kept = []
    gru._forward(weights.p, inputs, fresh, first, kept)
    grad_x, grad_g = gru._backward(kept, pull, fresh, weights.p["u"])
    flat = grad_g.reshape(-1, 3 * gru.STATE)
    wanted = {"b": grad_x.sum((0, 1)), "u": kept[0].reshape(-1, gru.STATE).T @ flat}
    for name, gradient in wanted.items():
        for _ in range(20):
            at = tuple(draw.integers(0, k) for k in gradient.shape)
            was, change = weights.p[name][at], np.float32(2e-3)
            weights.p[name][at] = was + change
            up = value()
            weights.p[name][at] = was - change
            down = value()
            weights.p[name][at] = was
            assert abs((up - down) / (2 * change) - gradient[at]) < 0.02 * (1 + abs(gradient[at])), (name, at)


def test_room_of_a_long_text():
    """A million units among short texts take room for a million units, not for all lanes."""
    weights, texts = trained()
    long = np.random.default_rng(2).integers(0, weights.units, 1_000_000).astype(np.int32)
    short = [texts[3]] * 500
    tracemalloc.start()
    found = gru.score(weights, [*short, long])
    gru.train(weights, iter([long, *short]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and np.isfinite(found).all()


def test_files_and_partitions_make_no_difference(spark):
    rows = [(i, prose(i, 80)) for i in range(60)]
    docs = documents(spark, rows)
    one = {r.doc_id: r.score for r in language_model.score_texts(docs.coalesce(1)).collect()}
    two = {r.doc_id: r.score for r in language_model.score_texts(docs.repartition(5, "text")).collect()}
    assert one.keys() == two.keys() and all(abs(one[d] - two[d]) < 1e-3 * abs(one[d]) for d in one)


def test_steps_raise_the_chance_of_what_is_read():
    mass = np.ones((gru.CLASSES, 4))
    text = [np.random.default_rng(5).integers(0, 20, 64).astype(np.int32)]
    weights = gru.Weights(mass)
    before = gru.score(weights, text)[0]
    for _ in range(5):
        gru.train(weights, iter(text))
    assert gru.score(weights, text)[0] > before + 5


def test_every_training_text_moves_the_weights(spark):
    for i in range(4):
        docs = documents(spark, [(None, prose(i, 400))])
        vocab = language_model.vocabulary(language_model.count_words(docs))
        start = gru.Weights(vocab.masses).flat()
        assert not np.array_equal(language_model.fit(docs, vocab).flat(), start)


def test_sums_by_row():
    """Rows that occur once, a few times and often, and ids beyond 16 bits."""
    draw = np.random.default_rng(3)
    for most in (3, 200, 70_000):
        rows = np.append(draw.integers(0, most, 500), [most] * 3).astype(np.int32)
        values = draw.normal(size=(len(rows), 5)).astype(np.float32)
        found, sums = gru._sums(rows, values)
        assert found.tolist() == sorted(set(rows.tolist()))
        assert np.allclose(sums, [values[rows == r].sum(0) for r in found], atol=1e-4)


def test_a_small_rest_makes_no_steps_of_its_own(monkeypatch):
    """Units just beyond a packing are read beside it, in as many windows as their share is worth."""
    monkeypatch.setattr(gru, "PACKED", 1 << 14)
    monkeypatch.setattr(gru, "LANE", 1 << 10)
    steps, forward = [], gru._forward
    monkeypatch.setattr(gru, "_forward", lambda *x: (steps.append(x[1].size), forward(*x))[1])
    texts = [np.arange(100, dtype=np.int32) % 20 for _ in range(170)]
    seen, _ = gru.train(gru.Weights(np.ones((gru.CLASSES, 4))), iter(texts))
    assert seen == 17_000 and len(steps) <= 1.1 * 17_000 / (16 * gru.STEPS)


def test_words_are_looked_up_once(spark):
    """Learners and scores read units; every text is encoded once, whoever reads it later."""
    rows = [(i, prose(i, 60)) for i in range(40)] + [(None, prose(99, 30)), (50, None), (51, ""), (52, " \n a\x1cB  c\x0b"), (53, "\t")]
    docs = documents(spark, rows)
    vocab = language_model.vocabulary(language_model.count_words(docs), 100)
    flagged = docs.select("doc_id", "text", language_model.held_out(docs.doc_id).alias("held_out"))
    coded = language_model.encode(flagged, vocab).collect()
    rank = {h: i for i, h in enumerate(vocab.hashes.tolist())}
    unit = {w: vocab.unit[rank[h]] for d, t in rows for w in words(low(t)) if (h := hashed(w)) in rank}
    other = {w: vocab.unit[vocab.head + language_model._bucket(w.encode())] for d, t in rows for w in words(low(t))}
    wanted = {d: [*[int((other | unit)[w]) for w in words(low(t))], vocab.end] for d, t in rows}
    assert {r.doc_id: np.frombuffer(r.units, np.uint16).tolist() for r in coded} == wanted
    assert sorted({r.place for r in coded if not r.held_out}) == sorted(r.place for r in coded if not r.held_out)
