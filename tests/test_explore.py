import pytest

from helpers import log_of, rows_of
from tillcast.operators import explore


def test_id_pattern(spark):
    ids = ["85123A", "123", "", "M", "TEST001", "1234A"]
    df = spark.createDataFrame([(i,) for i in ids], "product_id string")
    got = dict(rows_of(explore.id_pattern_split(df)))
    assert [got[i] for i in ids] == [True, True, False, False, False, False]


def test_null_counts_and_cardinalities(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b")], "x int, s string")
    assert rows_of(explore.null_counts(df)) == [("s", 1), ("x", 0)]
    assert rows_of(explore.cardinalities(df, ["x", "s"])) == [("s", 3), ("x", 2)]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (4.0, None)], "x double, s string")
    got = {r["column"]: r for r in explore.profile(df).collect()}
    assert (got["s"]["count"], got["s"]["nulls"], got["s"]["top"], got["s"]["freq"]) == (3, 1, "b", 2)
    assert (got["x"]["p25"], got["x"]["p50"], got["x"]["p75"], got["x"]["mean"]) == (1.75, 2.5, 3.25, 2.5)
    assert got["s"]["mean"] is None


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 9, 10)], "x double")
    assert rows_of(explore.histogram(df, "x", 5), "bin", "rows") == [
        (0, 2), (1, 1), (2, 0), (3, 0), (4, 2)
    ]
    assert rows_of(explore.histogram(df, "x", 2, 0, 2), "bin", "rows") == [(0, 1), (1, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert rows_of(explore.histogram(same, "x", 4), "bin", "rows") == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_dense_series(spark):
    lines = log_of(spark, [(1, "2011-01-05 10:00", 5), (1, "2011-01-20", 2), (2, "2011-03-06 09:00", 7)])
    got = rows_of(explore.dense_series(lines, measures=["total"]), "customer_id", "period", "total")
    assert got == [
        (1, "2011-01", 7.0), (1, "2011-02", 0.0), (1, "2011-03", 0.0),
        (2, "2011-01", 0.0), (2, "2011-02", 0.0), (2, "2011-03", 7.0),
    ]


def test_dense_series_from_a_given_day(spark):
    lines = log_of(spark, [(1, "2011-01-05", 5), (1, "2011-01-06", 1)])
    got = explore.dense_series(lines, "yyyy-MM-dd", start="2011-01-06", measures=["total"])
    assert rows_of(got, "period", "total") == [("2011-01-06", 1.0)]


def test_dense_series_reaches_the_last_day(spark):
    lines = log_of(spark, [(1, "2011-01-30 23:00", 5), (1, "2011-02-01 01:00", 7), (None, "2011-02-03", 1)])
    got = explore.dense_series(lines, measures=["total"])
    assert rows_of(got, "period", "total") == [("2011-01", 5.0), ("2011-02", 7.0)]
    with pytest.raises(ValueError):
        explore.dense_series(lines, "yyyy-MM-dd HH")


def test_first_customers(spark):
    lines = log_of(spark, [(c, "2011-01-05", c) for c in (5, 3, 9, 3, 7, 8, 6)])
    assert [r[0] for r in explore.first_keys(lines, "customer_id").orderBy("customer_id").collect()] == [3, 5, 6, 7, 8]
    assert explore.lines_of_first_customer(lines).count() == 2
    extremes = explore.extremes(lines, ["total"]).first()
    assert (extremes["total_min"], extremes["total_max"]) == (3, 9)
