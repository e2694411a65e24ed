import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import log_of
from tillcast.functions import months
from tillcast.functions.stats import FULL_STATS, agg_dict, agg_list
from tillcast.operators import moments


def one(df, *columns):
    return tuple(df.select(*[f"`{c}`" for c in columns]).first())


@pytest.mark.parametrize(
    "values, skew, std",
    [
        ([1.0, 2.0, 4.0, 9.0], 1.3309377, 3.5590261),
        ([1.0, 3.0], None, 1.4142136),
        ([5.0], None, None),
        ([0.1, 0.1, 0.1], 0.0, 0.0),
    ],
)
def test_skew_and_std_edges(spark, values, skew, std):
    df = spark.createDataFrame([(1, v) for v in values], "k int, x double")
    got = one(agg_dict(df, ["k"], {"x": ["skew", "std"]}), "x-skew", "x-std")
    for a, b in zip(got, (skew, std)):
        assert a is None if b is None else abs(a - b) < 1e-6


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "k int, x double")
    row = agg_list(df, ["k"], ["sum", "count", "mean", "max", "std", "skew"], ["x"]).first()
    assert tuple(row) == (1, 0.0, 0.0, None, None, None, None)


def test_mode_tie_and_first_last(spark):
    df = spark.createDataFrame(
        [(1, "b", 1), (1, "a", 2), (1, "c", 3)], "k int, x string, t int"
    )
    got = agg_dict(df, ["k"], {"x": ["mode", "first", "last", "nunique"]}, order=["t"]).first()
    assert tuple(got) == (1, "a", "b", "c", 3.0)


def test_list_aggregate_takes_numeric_columns(spark):
    df = spark.createDataFrame([("a", 1, "t", 2.0)], "k string, n int, s string, x double")
    assert agg_list(df, ["k"], ["mean"]).columns == ["k", "n-mean", "x-mean"]


def test_month_arithmetic(spark):
    assert months.shift("2011-01", -1) == "2010-12"
    assert months.shift("2011-12", 1) == "2012-01"
    df = spark.createDataFrame([("2011-01",)], "ym string")
    row = df.select(
        months.shift_bucket("ym", -2), months.name_of(F.lit(months.month_index("2009-12")))
    ).first()
    assert tuple(row) == ("2010-11", "2009-12")


@pytest.mark.parametrize(
    "first, expected",
    [
        ("2011-11-01 00:00", 1),
        ("2011-11-01 08:00", 0),
        ("2011-10-31 12:00", 1),
        ("2009-12-01 04:00", 23),
    ],
)
def test_tenure(spark, first, expected):
    lines = log_of(spark, [(1, first, 1)])
    assert lines.select(months.whole_months("order_date", "2011-12")).first()[0] == expected


def test_epoch_does_not_depend_on_the_session_zone(spark):
    lines = log_of(spark, [(1, "2011-07-01 12:34", 1)])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = lines.select(months.epoch_seconds("order_date")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == pd.Timestamp("2011-07-01 12:34").value // 10**9


def test_month_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, [(1, "2011-07-01", 1)]).write.parquet(path)
    plan = spark.read.parquet(path).where(months.before("order_date", "2011-12"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(order_date), LessThan(order_date," in text


values = st.lists(
    st.tuples(
        st.integers(0, 5), st.one_of(st.none(), st.integers(-1000, 1000))
    ),
    min_size=1,
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(values)
def test_merged_moments_equal_pandas(spark, data):
    """Merging period entries gives the statistics of all their rows."""
    lines = log_of(spark, [(1, f"2011-0{m + 1}-05", v) for m, v in data])
    hist = moments.history(lines, ["total"], months.index_of("order_date"))
    rows = moments.at_months(hist, ["2012-01"])
    got = moments.merged(rows, {"": "true"}, ["total"], FULL_STATS, 4).first()
    x = pd.Series([v for _, v in data], dtype="float64")
    want = {"mean": x.mean(), "max": x.max(), "min": x.min(), "sum": x.sum(),
            "count": x.count(), "std": x.std(), "skew": x.skew()}
    for stat, value in want.items():
        have = got[f"total-{stat}"]
        if pd.isna(value):
            assert have is None, stat
        else:
            assert math.isclose(have, value, rel_tol=1e-9, abs_tol=1e-9), stat
