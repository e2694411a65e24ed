import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import log_of, rows_of
from tillcast.functions import months
from tillcast.operators import running as R
from tillcast.plans import features as sets
from tillcast.session import materialise
from tillcast.sources.starschema import ORDER, transactions

ORD = ["order_date", "order_id", "product_id", "quantity", "price", "total"]
DIFFS = {"dt": "total", "dq": "quantity"}


def test_null_keeps_the_sum_going(spark):
    lines = log_of(spark, [(1, "2011-01-01", 1), (1, "2011-01-02", None), (1, "2011-01-03", 2)])
    got = R.running(lines, "customer_id", ORD, {"s": "total"}, {"d": "total"}, block=0)
    assert [(r.s, r.d) for r in got.orderBy("order_date").collect()] == [
        (1, None), (None, None), (3, None),
    ]


def test_rolling_mean_waits_for_three(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in (1, 2, 3, 4)], "k int, t int, x double")
    got = R.rolling_mean(df, ["k"], "t", "x", "m").orderBy("t").collect()
    assert [r.m for r in got] == [None, None, 2.0, 3.0]


@pytest.mark.parametrize("key", ["customer_id", "product_id", "order_id"])
@pytest.mark.parametrize("block", [3600, 40 * 86400, 10**10])
def test_blocks_give_the_same_values(spark, lines, key, block):
    sums = sets.CUMSUMS[key]
    diffs = {"dq": "quantity", "dt": "total"}
    plain = R.running(lines, key, ORDER, sums, diffs, block=0)
    split = R.running(lines, key, ORDER, sums, diffs, block=block)
    assert split.schema == plain.schema
    assert rows_of(split) == rows_of(plain)


@pytest.mark.parametrize("block", [3600, 86400, 2 * 86400])
def test_one_key_with_many_equal_rows(spark, block):
    """A key whose rows are mostly copies of one row, some without a value."""
    rows = [(1, "2011-01-01", 5, "o", "p", 2, 1.5)] * 57
    rows += [(1, "2011-01-02", 0, "o", "p", 0, 0)] * 31
    rows += [(1, "2011-01-03", None, "o", "q", 1, 1)] * 5 + [(2, "2011-01-01", 3)] * 4
    rows += [(1, "1969-12-31 23:30", 7), (3, "2011-01-02", None), (3, "2011-01-04", None), (3, "2011-01-05", 2)]
    lines = log_of(spark, rows)
    sums = {"s": "total", "q": "quantity"}
    plain = R.running(lines, "customer_id", ORD, sums, DIFFS, block=0)
    split = R.running(lines, "customer_id", ORD, sums, DIFFS, block=block)
    assert rows_of(split) == rows_of(plain)


def test_a_key_is_spread_over_tasks(spark):
    """One key with all rows, and rows without a key, go to many tasks."""
    rows = [(1, f"2011-{i % 12 + 1:02d}-{i % 28 + 1:02d}", i, "o", None if i % 2 else "p", 1, 1) for i in range(3000)]
    lines = log_of(spark, rows)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = R.running(lines, "product_id", ORD, {"s": "total"}, {"d": "total"}, block=3600)
        sizes = split.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sum(sizes) == 3000 and max(sizes) < 1500


def test_rows_are_read_once(spark):
    """Both levels read one shuffle, at each of three keys in a row."""
    lines = transactions(spark, "/root/testdata/sf0.001")
    out = sets.with_running_sums(lines, ORDER, 86400 * 365)
    total = out.agg(F.sum(F.hash(*out.columns).cast("bigint")))
    total.collect()
    plan = total._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("block", [0, 86400, 7 * 86400])
def test_rows_without_a_key_or_a_time(spark, block):
    rows = [(1, f"2011-01-{i % 28 + 1:02d}", i, f"o{i}", None, 1, 1) for i in range(40)]
    rows += [(1, f"2011-01-{i % 28 + 1:02d}", i, f"o{i}", "p", 1, 1) for i in range(30)]
    lines = log_of(spark, rows)
    timeless = lines.limit(0).unionByName(lines.where("order_id in ('o3', 'o4')")).withColumn("order_date", F.lit(None).cast("timestamp_ntz"))
    lines = lines.unionByName(timeless)
    got = R.running(lines, "product_id", ORD, {"s": "total"}, {"d": "total"}, block)
    assert got.where("product_id is null and (s is not null or d is not null)").count() == 0
    assert got.where("product_id = 'p' and s is null").count() == 0
    assert rows_of(got) == rows_of(R.running(lines, "product_id", ORD, {"s": "total"}, {"d": "total"}, 0))


def test_length_of_blocks(spark):
    """No block has more rows than asked for, unless an hour has; and none is too short."""
    rows = [(1, f"2011-01-{1 + i // 240:02d} {i // 10 % 24:02d}:00", i) for i in range(2400)]
    lines = log_of(spark, rows)  # ten rows an hour
    assert R.block_length(lines, 1.0, 5000) == 0
    assert R.block_length(lines, 1.0, 170) == 16 * 3600
    assert R.block_length(lines, 1.0, 10) == 3600
    assert R.block_length(lines, 1.0, 3) == 3600
    assert R.block_length(lines, 0.5, 340) == 16 * 3600
    assert R.block_length(lines.limit(0)) == 0


def test_blocks_are_looked_up_when_not_given(spark, monkeypatch):
    df = log_of(spark, [(1, f"2011-01-{i % 28 + 1:02d}", i, f"o{i}") for i in range(200)])
    plain = R.running(df, "customer_id", ORD, {"s": "total"}, block=0)
    monkeypatch.setattr(R.block_length, "__defaults__", (1.0, 20, "order_date"))
    assert R.block_length(df) > 0
    assert rows_of(R.running(df, "customer_id", ORD, {"s": "total"})) == rows_of(plain)


def test_feature_sets_agree_in_blocks(spark, lines):
    plain = sets.diff(lines, ["2001-06", "2001-07"], order=ORDER, block=0)
    split = sets.diff(lines, ["2001-06", "2001-07"], order=ORDER, block=30 * 86400)
    names = ["customer_id", "year_month", "label", "total_diff-sum", "order_ts_diff-max",
             "quantity_diff-min", "price_diff-count"]
    assert rows_of(split, *names) == rows_of(plain, *names)


history = st.lists(
    st.tuples(st.integers(1, 3), st.integers(1, 28), st.integers(-5, 5), st.integers(1, 3)),
    min_size=1, max_size=30,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(history)
def test_prefix_property(spark, data):
    """Running values of the lines before a date do not depend on later lines."""
    rows = [
        (c, f"2011-{1 + d // 15:02d}-{d:02d}", v, f"o{d}-{i}", f"p{p}")
        for i, (c, d, v, p) in enumerate(data)
    ]
    lines = log_of(spark, rows)
    cut = months.before("order_date", "2011-02")

    def computed(df):
        return R.running(df, "product_id", ORD, {"s": "total"}, {"d": "total"}, block=0)

    assert rows_of(computed(lines).where(cut)) == rows_of(computed(lines.where(cut)))


def test_only_frequent_keys_are_cut(spark):
    """Keys of more than half a block's rows, null among them, are found and cut; values stay."""
    rows = [(1, f"2011-{i % 12 + 1:02d}-{i % 28 + 1:02d}", i, "o", "often", 1, 1) for i in range(300)]
    rows += [(1, f"2011-{i % 12 + 1:02d}-{i % 28 + 1:02d}", i, "o", None, 1, 1) for i in range(200)]
    rows += [(i % 7, f"2011-{i % 12 + 1:02d}-01", i, "o", f"p{i % 60}", 1, 1) for i in range(240)]
    lines = log_of(spark, rows)
    found = R.blocks(lines, ["product_id", "order_id"], 1.0, 100)
    assert found.seconds > 0
    assert set(found.frequent["product_id"]) == {"often", None} and found.frequent["order_id"] == ["o"]
    assert R.blocks(lines, ["product_id"], 1.0, 1000) == R.Blocks(0)
    plain = R.running(lines, "product_id", ORD, {"s": "total"}, DIFFS, block=0)
    for cut in (found, R.Blocks(3600, {"product_id": ["often"]}), R.Blocks(3600, {"product_id": [None]})):
        assert rows_of(R.running(lines, "product_id", ORD, {"s": "total"}, DIFFS, cut)) == rows_of(plain)


def test_keys_that_are_not_frequent_need_one_shuffle(spark, monkeypatch):
    """A log of many blocks without a frequent key: its history by key is not shuffled again."""
    lines = log_of(spark, [(i % 90, f"2011-01-{i % 28 + 1:02d}", i, f"o{i}", "p", 1, 1) for i in range(900)])
    monkeypatch.setattr(R.blocks, "__defaults__", (1.0, 200, "order_date"))
    assert R.block_length(lines, 1.0, 200) > 0
    out = R.running(lines, "customer_id", ORD, {"s": "total"}, {"d": "total"})
    plan = out.groupBy("customer_id", "order_date").agg(F.sum("s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows_of(out) == rows_of(R.running(lines, "customer_id", ORD, {"s": "total"}, {"d": "total"}, 0))


def test_one_shuffle_although_few_columns_are_asked_for(spark):
    lines = transactions(spark, "/root/testdata/sf0.001").select(*ORDER, "total")
    out = R.running(lines, "product_id", ORDER, {"s": "total"}, block=86400 * 365).select("order_id", "s")
    rows = out.agg(F.sum(F.hash("order_id", "s").cast("bigint")))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1 and "ReusedExchange" in plan


def test_running_values_are_sums_and_differences(spark, lines):
    one = sets.with_running_values(lines, ORDER, 400 * 86400)
    two = sets.with_differences(sets.with_running_sums(lines, ORDER, 0), ORDER, 0)
    names = ["order_id", "line_no", "product_id", "supplier_id", *sets.CUMSUM_COLUMNS, *sets.DIFFS]
    assert rows_of(one, *names) == rows_of(two, *names)


def test_no_differences_without_a_key(spark):
    """Rows without a key, of which some fall into the first of the groups they are spread over."""
    rows = [(None, f"2011-{i % 12 + 1:02d}-{i % 28 + 1:02d}", i, f"o{i}", "p", 1, 1) for i in range(6000)]
    got = R.running(log_of(spark, rows), "customer_id", ORD, {"s": "total"}, {"d": "total"}, block=30 * 86400)
    assert got.where("s is not null or d is not null").count() == 0


SUMS = {"s": "total", "q": "quantity"}


@pytest.mark.parametrize("seconds", [3600, 5 * 86400, 365 * 86400])
def test_blocks_of_all_keys_stay_side_by_side(spark, seconds):
    """All keys are cut: those that are not frequent need one shuffle and no join; values stay."""
    rows = [(1, f"20{10 + i % 3}-{i % 12 + 1:02d}-{i % 28 + 1:02d} {i % 5:02d}:30", i, "o", f"p{i % 9}", i % 4, 1) for i in range(200)]
    rows += [(i % 3, "2011-01-01", None if i % 2 else 3, "o", None if i % 5 else "p1", i, 2) for i in range(60)]
    lines = log_of(spark, rows + rows[:40])
    timeless = lines.where("quantity = 2").limit(5).withColumn("order_date", F.lit(None).cast("timestamp_ntz"))
    lines = materialise(lines.unionByName(timeless))
    plain = R.running(lines, "product_id", ORD, SUMS, DIFFS, block=0)
    split = R.running(lines, "product_id", ORD, SUMS, DIFFS, R.Blocks(seconds, every=True))
    assert split.schema == plain.schema
    assert rows_of(split) == rows_of(plain) == rows_of(R.running(lines, "product_id", ORD, SUMS, DIFFS, seconds))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    spread = R.running(lines, "product_id", ORD, SUMS, DIFFS, R.Blocks(seconds, {"product_id": ["p1", None]}, True))
    assert rows_of(spread) == rows_of(plain)


def test_what_was_shuffled_for_written_lines_goes(spark):
    """Lines written on the way leave no shuffle files, and what follows begins from the files."""
    spark._jvm.System.gc()
    lines = materialise(log_of(spark, [(i % 7, f"2011-01-{i % 28 + 1:02d}", i, f"o{i % 60}", f"p{i % 9}") for i in range(300)]))
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName() for f in local.getAllFiles().toIterable().toSeq().mkString("\n").split("\n")} if False else {
            name.rsplit("/", 1)[-1] for name in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name
        }

    before = shuffled()
    out = sets.with_running_values(lines, ORD, 0, written=True)
    assert shuffled() <= before
    assert rows_of(out) == rows_of(sets.with_running_values(lines, ORD, 0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_columns_bring_customers_together_once(spark):
    """The monthly spend comes from the customers' windows, unless a customer is frequent."""
    rows = [(i % 7 or None, f"2011-{i % 9 + 1:02d}-{i % 28 + 1:02d}", i if i % 3 else None, f"o{i % 60}", f"p{i % 9}") for i in range(300)]
    lines = materialise(log_of(spark, rows + [(50, "2011-02-01", None), (51, "2011-11-01", 4)]))
    once = sets.with_all_columns(lines, "2011-12", ORD, R.Blocks(0))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    joined = sets.with_all_columns(lines, "2011-12", ORD, R.Blocks(86400, {"customer_id": [1]}))
    names = sorted(once.columns)
    assert names == sorted(joined.columns) and rows_of(once, *names) == rows_of(joined, *names)
    found = rows_of(once.where("customer_id is not null").select("customer_id", "mean").distinct())
    assert found == rows_of(sets.mean_monthly_spend(lines, "2011-12"))
    assert once.where("customer_id is null and mean is not null").count() == 0
