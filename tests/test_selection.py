import math

import numpy as np
import pytest

from helpers import rows_of
from tillcast.operators import explore, selection


def rows(spark, seed=0, n=240):
    """Features of which the second and third tell the classes apart together, with nulls."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(draw.random() < 0.4)
        x = [draw.normal(), draw.normal(y * 1.0), draw.normal(-y * 1.2), 5.0, draw.normal(y * 0.2)]
        x = [None if draw.random() < 0.1 else float(v) for v in x]
        out.append((i, y, i % 4, *x))
    kinds = "customer_id long, label int, fold int, " + ", ".join(f"`x-{i}` double" for i in range(5))
    return out, spark.createDataFrame(out, kinds), [f"x-{i}" for i in range(5)]


def test_f_statistics(spark):
    data, df, names = rows(spark)
    got = dict(rows_of(selection.f_statistics(df, names)))
    for i, name in enumerate(names):
        sides = [np.array([r[3 + i] for r in data if r[1] == c and r[3 + i] is not None]) for c in (0, 1)]
        whole = np.concatenate(sides)
        between = sum(len(s) * (s.mean() - whole.mean()) ** 2 for s in sides)
        inside = sum(((s - s.mean()) ** 2).sum() for s in sides) / (len(whole) - 2)
        assert got[name] is None if inside == 0 else got[name] == pytest.approx(between / inside)
    assert selection.best_single(df, names, 2) == sorted(
        (n for n in names if got[n] is not None), key=lambda n: -got[n])[:2]


def accuracy(data, chosen, folds=4):
    """Balanced accuracy out of fold of a naive Bayes model of the chosen features, fitted anew."""
    right = [0, 0]
    for k in range(folds):
        rest = [r for r in data if r[2] != k]
        prior = math.log(sum(r[1] for r in rest) / sum(1 - r[1] for r in rest))
        model = {}
        for i in chosen:
            for c in (0, 1):
                x = np.array([r[3 + i] for r in rest if r[1] == c and r[3 + i] is not None])
                model[i, c] = x.mean(), max(x.var(), selection.FLOOR)
        for r in (r for r in data if r[2] == k):
            odds = prior
            for i in chosen:
                if r[3 + i] is not None:
                    a, b = (math.log(v) + (r[3 + i] - m) ** 2 / v for m, v in (model[i, 0], model[i, 1]))
                    odds += (a - b) / 2
            right[r[1]] += (odds > 0) == (r[1] == 1)
    sizes = [sum(r[1] == c for r in data) for c in (0, 1)]
    return (right[0] / sizes[0] + right[1] / sizes[1]) / 2


@pytest.mark.parametrize("seed", [0, 1])
def test_forward_selection_equals_refits(spark, seed):
    data, df, names = rows(spark, seed)
    got = selection.forward_selection(df, names, 5).orderBy("step").collect()
    chosen, best = [], -1.0
    for step in got:
        scores = {i: accuracy(data, [*chosen, i]) for i in range(5) if i not in chosen}
        pick = max(scores, key=lambda i: (round(scores[i], 12), -i))
        assert (step["feature"], step["balanced_accuracy"]) == (names[pick], pytest.approx(scores[pick]))
        assert scores[pick] > best
        chosen, best = [*chosen, pick], scores[pick]
    if len(chosen) < 5:
        assert max(accuracy(data, [*chosen, i]) for i in range(5) if i not in chosen) <= best + 1e-12


def test_associations(spark):
    data = [("a", "u", 1.0), ("a", "u", 1.0), ("b", "v", 3.0), ("b", "v", None), (None, "v", 5.0), (None, "v", 5.0)]
    df = spark.createDataFrame(data, "x string, y string, n double")
    got = {(r["first"], r["second"]): r["strength"] for r in explore.associations(df, ["x", "y"], ["n"]).collect()}
    assert got["y", "x"] == pytest.approx(1.0) and got["x", "n"] == pytest.approx(1.0)
    three, two = math.log(3), -(1 / 3) * math.log(1 / 3) - (2 / 3) * math.log(2 / 3)
    assert got["x", "y"] == pytest.approx(two / three)
    assert 0 < got["y", "n"] < 1
    same = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 1.0)], "x string, y string, n double")
    got = {(r["first"], r["second"]): r["strength"] for r in explore.associations(same, ["x", "y"], ["n"]).collect()}
    assert got["x", "y"] is None and got["y", "x"] == 0 and got["x", "n"] is None
