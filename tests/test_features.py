import pytest

from helpers import log_of, rows_of
from tillcast.functions import months
from tillcast.operators.labels import generate_label, label_balance, label_months
from tillcast.plans import features as sets
from tillcast.sources.starschema import ORDER

MONTHS = ["2001-06", "2001-07"]


def test_label_universe(spark):
    lines = log_of(
        spark,
        [
            (1, "2011-10-05", 500),
            (2, "2011-11-05", 500),
            (3, "2011-10-05", 1),
            (3, "2011-11-30 23:59", 301),
            (4, "2011-09-01", 1),
            (4, "2011-11-02", 300),
            (5, "2011-12-01", 900),
        ],
    )
    labels = generate_label(lines, "2011-11")
    assert rows_of(labels, "customer_id", "total", "label") == [(1, 0.0, 0), (3, 301.0, 1), (4, 300.0, 0)]
    assert rows_of(label_balance(labels)) == [(0, 2), (1, 1)]


def test_labels_of_several_months_equal_single_ones(spark, lines):
    both = label_months(lines, MONTHS, 200000)
    for m in MONTHS:
        single = generate_label(lines, m, 200000)
        assert rows_of(both.where(both.year_month == m)) == rows_of(single)


@pytest.mark.parametrize(
    "name, count",
    [("base", 21), ("cumsum", 63), ("nunique", 2), ("mode", 2), ("diff", 30), ("full", 274)],
)
def test_feature_counts(spark, lines, name, count):
    options = {"order": ORDER, "block": 0} if name in ("cumsum", "diff", "full") else {}
    frame = sets.build(name, lines, MONTHS, **options)
    assert len(sets.feature_names(frame)) == count
    assert frame.columns[:3] == sets.KEYS


def test_trend_and_season_counts():
    assert len(sets.TREND_NAMES) == 168 and len(sets.SEASON_NAMES) == 48


def test_no_leak_from_the_target_month(spark, lines):
    """Lines on or after the month change nothing but its label."""
    past = lines.where(months.before("order_date", "2001-06"))
    for name in ("base", "diff", "full"):
        options = {"order": ORDER, "block": 0, "threshold": 1e12}
        if name == "base":
            del options["order"], options["block"]
        with_later = sets.build(name, lines, ["2001-06"], **options)
        without = sets.build(name, past, ["2001-06"], **options)
        assert rows_of(with_later) == rows_of(without)


def season_log(spark):
    # Bands of 2011-12: 2011-09..11, 2011-04..06, 2010-10..12, 2010-04..06.
    every = ["2011-10-01", "2011-05-01", "2010-11-01", "2010-05-01"]
    rows = [(1, d, 10) for d in every]
    rows += [(2, d, 10) for d in every[:3]]
    rows += [(3, d, 10) for d in (every[0], every[1], every[3])]
    rows += [(4, every[3], 10)]
    return log_of(spark, rows)


def test_season_chain(spark):
    columns = [f"total-count-season{i}" for i in range(4)]
    got = sets.season(season_log(spark), ["2011-12"])
    assert rows_of(got, "customer_id", *columns) == [
        (1, 1.0, 1.0, 1.0, 1.0),
        (3, None, None, None, 1.0),
        (4, None, None, None, 1.0),
    ]
    free = sets.season(season_log(spark), ["2011-12"], chain="independent")
    assert rows_of(free, "customer_id", *columns) == [
        (1, 1.0, 1.0, 1.0, 1.0),
        (2, 1.0, 1.0, 1.0, None),
        (3, 1.0, 1.0, None, 1.0),
        (4, None, None, None, 1.0),
    ]


def test_season_bands_are_closed(spark):
    rows = [(1, f"2011-{m:02d}-15", 10) for m in range(3, 12)]
    rows += [(1, "2010-11-15", 1), (1, "2010-05-15", 1)]
    got = sets.season(log_of(spark, rows), ["2011-12"])
    assert rows_of(got, *[f"total-count-season{i}" for i in range(4)]) == [(3.0, 3.0, 1.0, 1.0)]


def test_trend_windows_end_before_the_month(spark):
    rows = [(1, f"{y}-{m:02d}-15", 1) for y in (2009, 2010, 2011) for m in range(1, 13)]
    got = sets.trend(log_of(spark, rows), ["2011-12"])
    assert rows_of(got, *[f"total-count-{i}" for i in range(8)]) == [
        (1.0, 2.0, 3.0, 5.0, 7.0, 12.0, 20.0, 23.0)
    ]


def test_present_window_without_values_sums_to_zero(spark):
    got = sets.trend(log_of(spark, [(1, "2011-11-05", None)]), ["2011-12"])
    assert rows_of(got, "total-sum-0", "total-count-0", "total-mean-0") == [(0.0, 0.0, None)]


def test_mean_monthly_spend(spark):
    lines = log_of(spark, [(1, "2011-09-01", 30), (1, "2011-11-01", 50)])
    assert rows_of(sets.mean_monthly_spend(lines, "2011-12")) == [(1, 20.0)]


def test_full_set_mean_is_closed_form(spark, lines):
    full = sets.full(lines, MONTHS, order=ORDER, block=0)
    row = full.where("`mean-count` >= 3").first()
    assert row["mean-skew"] == 0.0
    assert row["mean-sum"] == row["mean-mean"] * row["mean-count"]


def test_mode_ties_go_to_the_earlier(spark):
    lines = log_of(spark, [(1, "2010-05-01", 1), (1, "2011-02-01", 1), (1, "2011-05-01", 1),
                           (1, "2010-02-01", 1)])
    got = sets.mode_months(lines, ["2011-12"])
    assert rows_of(got, "month-mode", "year_month-mode") == [(2.0, "2010-02")]


def test_several_months_equal_single_months(spark, lines):
    many = sets.base(lines, ["2001-03", "2001-06"])
    one = sets.base(lines, ["2001-06"])
    names = [n for n in one.columns if "-std" not in n and "-skew" not in n]
    assert rows_of(many.where("year_month = '2001-06'"), *names) == rows_of(one, *names)


def test_train_and_test_split(spark, lines):
    train, test = sets.split(sets.build("nunique", lines, ["2001-06", "2001-07"]), "2001-07")
    assert {r[0] for r in train.select("year_month").distinct().collect()} == {"2001-06"}
    assert {r[0] for r in test.select("year_month").distinct().collect()} == {"2001-07"}
