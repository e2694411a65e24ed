import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from samples import awkward, documents, prose

from tillcast.llm import mixing


def plain_rake(cells, rounds):
    cells = cells.copy()
    total = cells.tokens.sum()
    for m in mixing.MARGINS:
        part = cells.groupby(m).tokens.sum() ** mixing.POWERS[m]
        cells[f"to_{m}"] = cells[m].map(part / part.sum() * total)
    cells["raked"] = cells.tokens.astype(float)
    for _ in range(rounds):
        for m in mixing.MARGINS:
            cells["raked"] *= cells[f"to_{m}"] / cells.groupby(m).raked.transform("sum")
    return cells


def table(spark, seed=0):
    draw = np.random.default_rng(seed)
    rows = [
        (f"s{s}", f"l{k}", f"t{t}", int(draw.integers(1, 10_000)))
        for s in range(6) for k in range(3) for t in range(4) if draw.random() < 0.8
    ]
    return pd.DataFrame(rows, columns=[*mixing.MARGINS, "tokens"]), spark.createDataFrame(
        rows, "source string, lang string, topic string, tokens long"
    )


def test_raking_equals_plain_rounds_and_fits_the_margins(spark):
    plain, cells = table(spark)
    got = mixing.rake(cells, rounds=30).toPandas().sort_values([*mixing.MARGINS]).reset_index(drop=True)
    want = plain_rake(plain, 30).sort_values([*mixing.MARGINS]).reset_index(drop=True)
    assert np.allclose(got.raked, want.raked, rtol=1e-9)
    for m in mixing.MARGINS:
        sums = got.groupby(m).raked.sum()
        assert np.allclose(sums, want.groupby(m)[f"to_{m}"].first(), rtol=1e-3)


def test_explicit_targets(spark):
    _, cells = table(spark, 1)
    weights = {f"s{i}": float(i) for i in range(6)}
    got = mixing.rake(cells, {"source": weights}, rounds=30).toPandas()
    sums = got.groupby("source").raked.sum()
    assert sums["s0"] == 0 and np.allclose(sums / sums.sum(), [i / 15 for i in range(6)], atol=2e-3)


def test_calibration_keeps_the_share_and_no_probability_passes_one(spark):
    _, cells = table(spark, 2)
    for keep in (0.1, 0.5, 0.95):
        got = mixing.calibrate(mixing.rake(cells), keep).toPandas()
        assert abs((got.probability * got.tokens).sum() - keep * got.tokens.sum()) < 1e-6 * got.tokens.sum()
        assert got.probability.max() <= 1


def test_sample_follows_the_probabilities(spark):
    rows = [(i, prose(i % 50, 20 + i % 300), ("en", "de")[i % 3 == 0], f"s{i % 7 % 4}") for i in range(4000)]
    found = mixing.mix(documents(spark, rows), keep=0.5).select("doc_id", "mix.*").toPandas()
    assert abs(found.kept.mean() - found.probability.mean()) < 0.03
    kept, all_ = found[found.kept].tokens.sum(), found.tokens.sum()
    assert abs(kept / all_ - 0.5) < 0.03
    again = mixing.mix(documents(spark, rows).repartition(5), keep=0.5).where("mix.kept")
    assert {r.doc_id for r in again.select("doc_id").collect()} == set(found[found.kept].doc_id)


def test_awkward_rows(spark):
    rows = [*awkward(), (60, "no source", None, None), (61, "odd", "", "=")]
    docs = documents(spark, rows)
    found = mixing.mix(docs)
    assert found.columns == [*[c for c in docs.columns if c != "mix"], "mix"] and found.count() == len(rows)
    assert found.where("text IS NULL OR trim(text) = ''").agg(F.max("mix.tokens")).first()[0] == 1
    fates = {}
    for r in found.collect():
        fates.setdefault((r.doc_id, r.text), set()).add(r.mix.kept)
    assert all(len(f) == 1 for f in fates.values())
    kept = mixing.sample(docs, keep=1.0)
    assert sorted(kept.columns) == sorted(docs.columns) and kept.count() == len(rows)
    assert {r.mix for r in kept.collect()} == {"g"}
    assert mixing.sample(documents(spark, [])).count() == 0
