"""Customer feature sets.

Each set gives, for one or more months, a row per customer known before the
month: ``customer_id, year_month, label`` and features from the lines before it.
All months come out of one pass over the lines. The running values need no
recomputing per month either: in date order they depend on earlier lines only,
so those of a month's history are the same in a longer log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import months
from tillcast.functions.stats import FULL_STATS
from tillcast.operators import moments
from tillcast.operators.labels import TOTAL_THRESHOLD, exceeds
from tillcast.operators.running import Blocks, blocks, running
from tillcast.schema import LOG_ORDER, MEASURES, with_customer
from tillcast.session import handed_on

KEYS = ["customer_id", "year_month", "label"]

# Months back at which each trend window starts.
TREND_MONTHS = [1, 2, 3, 5, 7, 12, 20, 23]
# Last month back of each three-month season band.
SEASON_MONTHS = [1, 6, 12, 18]
SEASON_LENGTH = 3
SEASON_STATS = ["mean", "count", "sum", "skew"]
FULL_SET_STATS = ["mean", "sum", "count", "skew"]

RUNNING_KEYS = {"customer_id": "cust_id", "product_id": "prod_id", "order_id": "order_id"}
CUMSUMS = {
    key: {f"cumsum_{m}_by_{short}": m for m in ("total", "quantity", "price")}
    for key, short in RUNNING_KEYS.items()
}
CUMSUM_COLUMNS = [name for columns in CUMSUMS.values() for name in columns]
DIFFS = {
    "order_ts_diff": "order_ts",
    "quantity_diff": "quantity",
    "price_diff": "price",
    "total_diff": "total",
}


def _order(lines: DataFrame, order: Sequence[str] | None) -> list[str]:
    return list(order or [c for c in LOG_ORDER if c in lines.columns])


def _blocks(lines: DataFrame, *keys: str) -> Blocks:
    return blocks(lines, keys or list(RUNNING_KEYS))


def _until(lines: DataFrame, year_months: Sequence[str]) -> DataFrame:
    """Lines up to the end of the last month, whose spend gives its label."""
    return lines.where(months.before("order_date", months.shift(max(year_months), 1)))


def _labelled(rows: DataFrame, threshold: float, features: Sequence[str | Column]) -> DataFrame:
    return rows.select(
        "customer_id",
        months.name_of(F.col("ref")).alias("year_month"),
        exceeds("spend", threshold).alias("label"),
        *features,
    )


def _quoted(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _whole_history(
    lines: DataFrame,
    year_months: Sequence[str],
    measures: Sequence[str],
    stats: Sequence[str],
) -> DataFrame:
    hist = moments.history(lines, measures, moments.periods(year_months))
    rows = moments.at_months(hist, year_months)
    scale = moments.sum_scale(lines, measures)
    return moments.merged(rows, {"": "true"}, measures, stats, scale)


def base(
    lines: DataFrame, year_months: Sequence[str], threshold: float = TOTAL_THRESHOLD
) -> DataFrame:
    """Seven statistics of quantity, price and total (21 features)."""
    rows = _whole_history(_until(lines, year_months), year_months, MEASURES, FULL_STATS)
    names = [f"{m}-{s}" for m in MEASURES for s in FULL_STATS]
    return _labelled(rows, threshold, _quoted(names))


def with_running_sums(
    lines: DataFrame,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """Add the running sums of total, quantity and price by customer, product and order.

    By order first, then product, then customer: the order windows use the
    partitioning a join by order leaves behind, and the customer windows leave
    behind the one that grouping by customer needs.
    """
    if block is None:
        block = _blocks(lines)
    for key in ("order_id", "product_id", "customer_id"):
        lines = running(lines, key, _order(lines, order), sums=CUMSUMS[key], block=block)
    return lines


def with_differences(
    lines: DataFrame,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """Add the difference to the customer's previous line, for time and measures."""
    if block is None:
        block = _blocks(lines, "customer_id")
    lines = lines.withColumn("order_ts", months.epoch_seconds("order_date"))
    return running(
        lines,
        "customer_id",
        _order(lines, order),
        diffs=DIFFS,
        block=block,
    )


def with_running_values(
    lines: DataFrame,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
    written: bool = False,
) -> DataFrame:
    """Add what ``with_running_sums`` and ``with_differences`` add; the customers' sums and
    differences come from one shuffle.

    ``written`` writes the lines down, now, before those of a customer come together, so that the
    shuffles up to there are off the disk when the widest is made.
    """
    if block is None:
        block = _blocks(lines)
    for key in ("order_id", "product_id"):
        lines = running(lines, key, _order(lines, order), sums=CUMSUMS[key], block=block)
    if written:
        lines = handed_on(lines)
    lines = lines.withColumn("order_ts", months.epoch_seconds("order_date"))
    return running(
        lines,
        "customer_id",
        _order(lines, order),
        sums=CUMSUMS["customer_id"],
        diffs=DIFFS,
        block=block,
    )


def with_month_columns(lines: DataFrame) -> DataFrame:
    """Add the month of the year and the calendar month."""
    return lines.withColumn("month", F.month("order_date")).withColumn(
        "year_month", months.bucket("order_date")
    )


def with_all_columns(
    lines: DataFrame,
    year_month: str,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """Lines with running sums, differences and the customer's mean monthly spend.

    The ``full`` set does not need the last: it is constant per customer there. The lines are
    written down on the way, as ``with_running_values`` does with ``written``.
    """
    if block is None:
        block = _blocks(lines)
    found = with_running_values(lines, order, block, written=True)
    if block and (isinstance(block, int) or block.frequent.get("customer_id")):
        return found.join(mean_monthly_spend(lines, year_month), "customer_id", "left")
    # No customer has many lines: they are together already, for the running sums.
    own = Window.partitionBy("customer_id")
    total = F.coalesce(F.sum("total").over(own).cast("double"), F.lit(0.0))
    found = found.withColumns({"_total": total, "_first": F.min("order_date").over(own)})
    mean = F.when(F.col("customer_id").isNotNull(), _monthly("_total", "_first", year_month))
    return found.withColumn("mean", mean).drop("_total", "_first")


def cumsum(
    lines: DataFrame,
    year_months: Sequence[str],
    threshold: float = TOTAL_THRESHOLD,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """Seven statistics of nine running sums (63 features)."""
    lines = with_running_sums(_until(lines, year_months), order, block)
    rows = _whole_history(lines, year_months, CUMSUM_COLUMNS, FULL_STATS)
    names = [f"{c}-{s}" for c in CUMSUM_COLUMNS for s in FULL_STATS]
    return _labelled(rows, threshold, _quoted(names))


def nunique(
    lines: DataFrame, year_months: Sequence[str], threshold: float = TOTAL_THRESHOLD
) -> DataFrame:
    """Number of distinct orders and products (2 features).

    Each pair of customer and id counts from its first date on, so the pairs are
    built once for all months, and a frequent customer's pairs are spread. They
    carry the spend of the months too, once per order, which gives the labels.
    """
    columns = ["order_id", "product_id"]
    ids = [
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in columns
    ]
    spends = [
        F.sum(F.when(months.within("order_date", m, m), F.col("total"))).alias(f"spend_{i}")
        for i, m in enumerate(year_months)
    ]
    pairs = (
        with_customer(_until(lines, year_months))
        .select("customer_id", "order_date", "total", F.inline(F.array(*ids)))
        .groupBy("customer_id", "kind", "id")
        .agg(F.min("order_date").alias("first_date"), *spends)
    )

    def is_kind(c: str) -> Column:
        return F.col("kind") == c

    customers = pairs.groupBy("customer_id").agg(
        F.min("first_date").alias("first_date"),
        *[
            F.sum(F.when(is_kind("order_id"), F.col(f"spend_{i}"))).alias(f"spend_{i}")
            for i in range(len(year_months))
        ],
        *[
            F.count_if(is_kind(c) & F.col("id").isNotNull() & months.before("first_date", m))
            .cast("double")
            .alias(f"{c}_{i}")
            for i, m in enumerate(year_months)
            for c in columns
        ],
    )
    rows = [
        F.struct(
            F.lit(m).alias("year_month"),
            months.before("first_date", m).alias("known"),
            F.coalesce(F.col(f"spend_{i}").cast("double"), F.lit(0.0)).alias("spend"),
            *[F.col(f"{c}_{i}").alias(f"{c}-nunique") for c in columns],
        )
        for i, m in enumerate(year_months)
    ]
    return (
        customers.select("customer_id", F.inline(F.array(*rows)))
        .where("known")
        .select(
            "customer_id",
            "year_month",
            exceeds("spend", threshold).alias("label"),
            *_quoted([f"{c}-nunique" for c in columns]),
        )
    )


# Bits of the registers' number in a sketch of distinct values: a standard error of 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(lines: DataFrame, columns: Sequence[str] = ("order_id", "product_id")) -> DataFrame:
    """``customer_id, p`` (the month) and a sketch of each column's values; sketches merge.

    A frequent customer's lines are sketched where they are, and only sketches are shuffled.
    """
    month = months.index_of("order_date").alias("p")
    return (
        with_customer(lines)
        .groupBy("customer_id", month)
        .agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in columns])
    )


def approx_nunique(
    lines: DataFrame, year_months: Sequence[str], back: Sequence[int | None] = (None,)
) -> DataFrame:
    """Approximate distinct orders and products before each month, from one set of sketches.

    ``back`` lists windows by their length in months, None for the whole history; a window
    of n months adds ``-n`` to the names. Any window is a union of the monthly sketches.
    """
    columns = ["order_id", "product_id"]
    sketches = distinct_sketches(_until(lines, year_months), columns)
    refs = F.array(*[F.lit(months.month_index(m)) for m in sorted(year_months)])
    past = sketches.select("*", F.explode(refs).alias("ref")).where("p < ref")
    found = []
    for n in back:
        for c in columns:
            inside = F.lit(True) if n is None else F.col("p") >= F.col("ref") - n
            merged = F.hll_sketch_estimate(F.hll_union_agg(F.when(inside, F.col(c))))
            name = f"{c}-approx_nunique" + ("" if n is None else f"-{n}")
            found.append(F.coalesce(merged, F.lit(0)).cast("double").alias(name))
    return past.groupBy("customer_id", "ref").agg(*found).withColumn("year_month", months.name_of(F.col("ref"))).drop("ref")


def mode_months(
    lines: DataFrame, year_months: Sequence[str], threshold: float = TOTAL_THRESHOLD
) -> DataFrame:
    """Most frequent month of the year and most frequent calendar month (2 features).

    Ties go to the earlier one.
    """
    hist = moments.history(_until(lines, year_months), [], months.index_of("order_date"))
    rows = moments.at_months(hist, year_months)
    most = "array_max(transform(past, e -> struct(e.rows as n, -e.p as p)))"
    lines_in = "aggregate(past, 0L, (acc, e) -> acc + if(e.p % 12 + 1 = m, e.rows, 0L))"
    most_of_year = f"array_max(transform(sequence(1, 12), m -> struct({lines_in} as n, -m as p)))"
    return _labelled(
        rows,
        threshold,
        [
            F.expr(f"cast(-{most_of_year}.p as double) as `month-mode`"),
            months.name_of(F.expr(f"-{most}.p")).alias("year_month-mode"),
        ],
    )


def diff(
    lines: DataFrame,
    year_months: Sequence[str],
    threshold: float = TOTAL_THRESHOLD,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """First and last purchase time and seven statistics of four differences (30 features)."""
    lines = with_differences(_until(lines, year_months), order, block)
    rows = _whole_history(lines, year_months, list(DIFFS), FULL_STATS)
    names = [f"{c}-{s}" for c in DIFFS for s in FULL_STATS]
    return _labelled(_with_span(rows), threshold, [*_first_last(), *_quoted(names)])


def _with_span(rows: DataFrame) -> DataFrame:
    """Add the customer's first and last purchase time."""
    return rows.selectExpr(
        "*",
        "array_min(transform(past, e -> e.first_date)) as _first",
        "array_max(transform(past, e -> e.last_date)) as _last",
    )


def _first_last() -> list[Column]:
    """In date order the first and the last time are the extremes."""
    return [
        months.epoch_seconds("_first").cast("double").alias("order_ts-first"),
        months.epoch_seconds("_last").cast("double").alias("order_ts-last"),
    ]


def mean_monthly_spend(lines: DataFrame, until: str) -> DataFrame:
    """Total spend over the months since the first purchase, per customer."""
    per_customer = with_customer(lines).groupBy("customer_id").agg(
        F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("total"),
        F.min("order_date").alias("first_date"),
    )
    return per_customer.select("customer_id", _monthly("total", "first_date", until).alias("mean"))


def _monthly(total: str, first_date: str, until: str) -> Column:
    return F.try_divide(F.col(total), months.whole_months(first_date, until) + 1)


def _back(first: int, last: int) -> str:
    """Entries of the months ``first..last`` before the reference month."""
    return f"e.p between ref - {first} and ref - {last}"


TREND_WINDOWS = {f"-{i}": _back(b, 1) for i, b in enumerate(TREND_MONTHS)}
SEASON_WINDOWS = {
    f"-season{i}": _back(b + SEASON_LENGTH - 1, b) for i, b in enumerate(SEASON_MONTHS)
}


def _recent_history(lines: DataFrame, year_months: Sequence[str], back: int) -> DataFrame:
    """Monthly entries of the last ``back`` months before each month."""
    start = months.shift(min(year_months), -back)
    recent = _until(lines, year_months).where(
        F.col("order_date") >= months.month_start(start)
    )
    hist = moments.history(recent, MEASURES, months.index_of("order_date"))
    return moments.at_months(hist, year_months)


def _names(windows: Sequence[str], stats: Sequence[str]) -> list[str]:
    return [f"{m}-{s}{w}" for w in windows for m in MEASURES for s in stats]


TREND_NAMES = _names(list(TREND_WINDOWS), FULL_STATS)
SEASON_NAMES = _names(list(SEASON_WINDOWS), SEASON_STATS)


def _ref_month() -> Column:
    return months.name_of(F.col("ref")).alias("year_month")


def trend(lines: DataFrame, year_months: Sequence[str]) -> DataFrame:
    """Seven statistics over eight trailing windows (168 features).

    Rows are the customers active in the longest window. The windows are nested,
    so a customer active in one is active in all longer ones.
    """
    rows = _recent_history(lines, year_months, max(TREND_MONTHS))
    rows = rows.where(f"exists(past, e -> {_back(max(TREND_MONTHS), 1)})")
    scale = moments.sum_scale(lines, MEASURES)
    out = moments.merged(rows, TREND_WINDOWS, MEASURES, FULL_STATS, scale)
    return out.select("customer_id", _ref_month(), *_quoted(TREND_NAMES))


def _chained(chain: str) -> bool:
    if chain not in ("right", "independent"):
        raise ValueError("chain is 'right' or 'independent'")
    return chain == "right"


def season(lines: DataFrame, year_months: Sequence[str], chain: str = "right") -> DataFrame:
    """Four statistics over four season bands (48 features).

    As chained right joins keep them, a band counts only for customers active in
    it and in every later band, and rows are the customers active in the last
    one. With ``chain='independent'`` each band stands alone, and rows are the
    customers active in any.
    """
    rows = _recent_history(lines, year_months, max(SEASON_MONTHS) + SEASON_LENGTH - 1)
    bands = list(SEASON_WINDOWS.values())
    needed = bands[-1:] if _chained(chain) else bands
    rows = rows.where(f"exists(past, e -> {' or '.join(needed)})")
    scale = moments.sum_scale(lines, MEASURES)
    out = moments.merged(
        rows, SEASON_WINDOWS, MEASURES, SEASON_STATS, scale, _chained(chain)
    )
    return out.select("customer_id", _ref_month(), *_quoted(SEASON_NAMES))


def full(
    lines: DataFrame,
    year_months: Sequence[str],
    threshold: float = TOTAL_THRESHOLD,
    order: Sequence[str] | None = None,
    block: int | Blocks | None = None,
    chain: str = "right",
    tenure_until: str | None = None,
) -> DataFrame:
    """Differences, running sums, monthly spend, trend and season (274 features).

    The monthly spend of every month's rows is over the tenure up to
    ``tenure_until``, by default the last month, as a train and test pair needs.
    """
    until = tenure_until or max(year_months)
    # The customers' windows come last: the history by customer and month needs no shuffle then.
    lines = with_running_values(_until(lines, year_months), order, block)

    # One monthly history carries all measures; the whole past, the trend windows and the season
    # bands are merged from it, so the lines are read once.
    row_columns = [*DIFFS, *CUMSUM_COLUMNS]
    hist = moments.history(lines, [*MEASURES, *row_columns], months.index_of("order_date"))
    rows = moments.at_months(hist, year_months)
    scale = moments.sum_scale(lines, MEASURES)
    rows = moments.merged(rows, TREND_WINDOWS, MEASURES, FULL_STATS, scale)
    rows = moments.merged(rows, SEASON_WINDOWS, MEASURES, SEASON_STATS, scale, _chained(chain))
    scale = moments.sum_scale(lines, row_columns)
    rows = moments.merged(rows, {"": "true"}, row_columns, FULL_SET_STATS, scale, first=len(MEASURES))
    # A value that is constant per customer has closed-form statistics.
    spent = moments.rounded(
        "aggregate(past, 0D, (acc, e) -> acc + e.spend)", moments.sum_scale(lines, ["total"])
    )
    rows = _with_span(rows).selectExpr(
        "*",
        f"{spent} as _spent",
        "cast(aggregate(past, 0L, (acc, e) -> acc + e.rows) as double) as _rows",
    ).withColumn("_mean", _monthly("_spent", "_first", until))
    own = [
        F.col("_mean").alias("mean-mean"),
        F.expr("_mean * _rows as `mean-sum`"),
        F.col("_rows").alias("mean-count"),
        F.expr("if(_rows >= 3, 0D, null) as `mean-skew`"),
    ]
    names = [f"{c}-{s}" for c in row_columns for s in FULL_SET_STATS]
    return _labelled(
        rows, threshold, [*_first_last(), *_quoted(names), *own, *_quoted(TREND_NAMES + SEASON_NAMES)]
    )


FEATURE_SETS: dict[str, Callable[..., DataFrame]] = {
    "base": base,
    "cumsum": cumsum,
    "nunique": nunique,
    "mode": mode_months,
    "diff": diff,
    "full": full,
}


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEYS]


def build(name: str, lines: DataFrame, year_months: Sequence[str], **options) -> DataFrame:
    """Feature set by name; the options are those of the set's function."""
    return FEATURE_SETS[name](lines, sorted(year_months), **options)


def split(features: DataFrame, year_month: str) -> tuple[DataFrame, DataFrame]:
    is_target = F.col("year_month") == year_month
    return features.where(~is_target), features.where(is_target)
