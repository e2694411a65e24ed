"""Exploration of a transaction log: profile, counts, histograms, dense series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import months
from tillcast.functions.stats import numeric_columns
from tillcast.operators.quantiles import exact_quantiles
from tillcast.schema import MEASURES, with_customer
from tillcast.session import materialise, small_table


def null_counts(df: DataFrame) -> DataFrame:
    """``column, nulls`` from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "nulls")


def _tallies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count of every value of every column, values as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, values``: distinct values, null counted as one.

    The values are spread by column and value, so no column is gathered in a task.
    """
    return _tallies(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("values"))


def extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(f"`{c}`").alias(f"{c}_min") for c in columns],
        *[F.max(f"`{c}`").alias(f"{c}_max") for c in columns],
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, nulls, distinct values, most frequent value, and for
    numbers mean, standard deviation, extremes and quartiles. Ties of the most
    frequent value go to the smallest text."""
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_columns(df) if c in columns]
    # Written once, with these columns only: tallies, moments and quantiles read it in turn.
    df = materialise(df.select(*[F.col(f"`{c}`") for c in columns]))
    tallies = _tallies(df, columns)
    known = F.col("value").isNotNull()
    values = tallies.groupBy("column").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("count"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"),
        F.count_if(known).alias("unique"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "value"))).alias("top"),
    )
    table = values.select(
        "column",
        "count",
        "nulls",
        "unique",
        F.col("top.value").alias("top"),
        (-F.col("top.n")).alias("freq"),
    )
    if not numeric:
        return table

    x = {c: F.col(f"`{c}`").cast("double") for c in numeric}
    numbers = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.avg(x[c]).alias("mean"),
                F.stddev_samp(x[c]).alias("std"),
                F.min(x[c]).alias("min"),
                F.max(x[c]).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(numeric)
        ]
    ).select(F.inline(F.array(*[f"s{i}" for i in range(len(numeric))])))
    found = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    quartiles = small_table(
        df.sparkSession,
        [(c, *found[c]) for c in numeric],
        "column string, p25 double, p50 double, p75 double",
    )
    # One row per column of the table on either side.
    return table.join(numbers.join(quartiles, "column"), "column", "left")


def associations(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str] = ()
) -> DataFrame:
    """``first, second, kind, strength`` of all pairs with a category, from 0 (none) to 1.

    Two categories have the uncertainty coefficient: the share of the first's entropy that the
    second takes away, so each order has a row. A category and a number have the correlation
    ratio: the root of the share of the number's variance that lies between the categories.
    Nulls are a category of their own; a number's nulls are left out. A pair without any
    entropy or variance to explain has no strength.

    All pairs come from one tally by pair and values and one by category and value, both summed
    before the shuffle, so a frequent value is spread.
    """
    text = {c: F.col(f"`{c}`").cast("string") for c in categories}
    pairs = [(a, b) for i, a in enumerate(categories) for b in categories[i + 1 :]]
    parts = []
    if pairs:
        rows = F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text[a].alias("x"), text[b].alias("y")) for a, b in pairs]
        )
        cells = df.select(F.inline(rows)).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
        cells = materialise(cells)
        entropy = _entropy_sums(cells, ["a", "b"])
        for side, value in (("a", "x"), ("b", "y")):
            margin = cells.groupBy("a", "b", value).agg(F.sum("n").alias("n"))
            entropy = entropy.join(
                _entropy_sums(margin, ["a", "b"]).select("a", "b", F.col("h").alias(f"h_{side}")), ["a", "b"]
            )
        both = F.col("h_a") + F.col("h_b") - F.col("h")
        for one, two in (("a", "b"), ("b", "a")):
            parts.append(
                entropy.select(
                    F.col(one).alias("first"),
                    F.col(two).alias("second"),
                    F.lit("uncertainty").alias("kind"),
                    F.when(F.col(f"h_{one}") > 1e-12, F.greatest(both / F.col(f"h_{one}"), F.lit(0.0))).alias("strength"),
                )
            )
    if categories and numbers:
        rows = F.array(*[F.struct(F.lit(c).alias("a"), text[c].alias("x")) for c in categories])
        x = {c: F.col(f"v{i}") for i, c in enumerate(numbers)}
        means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in numbers]).first()
        # Distances from the mean, so that the squares do not cancel.
        values = [
            (F.col(f"`{c}`").cast("double") - F.lit(0.0 if m is None else m)).alias(f"v{i}")
            for i, (c, m) in enumerate(zip(numbers, means))
        ]
        groups = df.select(*values, F.inline(rows)).groupBy("a", "x").agg(
            *[
                F.struct(
                    F.lit(c).alias("second"), F.count(x[c]).alias("n"), F.sum(x[c]).alias("s"), F.sum(x[c] * x[c]).alias("q")
                ).alias(f"g{i}")
                for i, c in enumerate(numbers)
            ]
        )
        long = groups.select("a", F.inline(F.array(*[f"g{i}" for i in range(len(numbers))]))).where("n > 0")
        sums = long.groupBy("a", "second").agg(
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        )
        shift = F.col("s") * F.col("s") / F.col("n")
        total = F.col("q") - shift
        share = F.greatest((F.col("between") - shift) / total, F.lit(0.0))
        parts.append(
            sums.select(
                F.col("a").alias("first"),
                "second",
                F.lit("correlation ratio").alias("kind"),
                F.when(total > F.col("q") * 1e-13, F.sqrt(F.least(share, F.lit(1.0)))).alias("strength"),
            )
        )
    if not parts:
        raise ValueError("associations need two categories, or one and a number")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _entropy_sums(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entropy in nats of the counts ``n`` of each group."""
    n = F.col("n").cast("double")
    return (
        cells.groupBy(*by)
        .agg(F.sum(n).alias("t"), F.sum(n * F.log(n)).alias("w"))
        .select(*by, (F.log("t") - F.col("w") / F.col("t")).alias("h"))
    )


def histogram(
    df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """``bin, lower, upper, rows`` of equal-width bins, empty ones too; the last one is closed.

    The range is that of the data unless given; values outside a given range are
    not counted. Without values and without a given range there are no bins.
    """
    x = F.col(f"`{column}`").cast("double")
    low = F.lit(float(lo)) if lo is not None else df.agg(F.min(x)).scalar()
    high = F.lit(float(hi)) if hi is not None else df.agg(F.max(x)).scalar()
    ranged = df.select(x.alias("x"), low.alias("lo"), high.alias("hi")).where("x between lo and hi")
    placed = ranged.selectExpr("x", "lo", f"(hi - lo) / {bins} as width").selectExpr(
        f"least(coalesce(floor(try_divide(x - lo, width)), 0), {bins - 1}) as bin"
    )
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), low.alias("lo"), ((high - low) / bins).alias("width")
    )
    # A row for each bin on either side.
    return (
        edges.where("lo is not null")
        .join(counted, "bin", "left")
        .selectExpr(
            "bin", "lo + bin * width as lower", "lo + (bin + 1) * width as upper",
            "coalesce(rows, 0L) as rows",
        )
    )


def calendar(lines: DataFrame, pattern: str, start: str | None) -> Column:
    """Array of the distinct periods of the calendar, as a scalar subquery.

    Every day from ``start``, by default the day of the first line, to that of the last one.
    """
    if set("hHkKmsSaABnN") & set(re.sub("'[^']*'", "", pattern)):
        raise ValueError("periods are days or longer")
    span = lines.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    begin, end = F.lit(start).cast("date") if start else F.to_date("first"), F.to_date("last")
    # A start after the last line leaves no periods.
    dates = F.when(begin <= end, F.sequence(begin, F.greatest(begin, end)))
    names = F.transform(dates, lambda d: F.date_format(d, pattern))
    return span.select(F.array_distinct(names)).scalar()


def dense_series(
    lines: DataFrame,
    pattern: str = "yyyy-MM",
    start: str | None = None,
    measures: Sequence[str] = MEASURES,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Sums per customer and period, with a row of zeros for a period without lines.

    Each customer's sums, at most one per period, are laid over the calendar where
    they are; the empty rows are never shuffled. ``customers`` limits the output.
    """
    lines = with_customer(lines)
    periods = calendar(lines, pattern, start)
    if customers is not None:
        lines = lines.join(customers.select("customer_id"), "customer_id", "left_semi")
    sums = (
        lines.groupBy("customer_id", months.bucket("order_date", pattern).alias("period"))
        .agg(*[F.sum(m).cast("double").alias(m) for m in measures])
        .where("period is not null")
    )
    per_customer = sums.groupBy("customer_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("period", F.struct(*measures)))
        ).alias("sums")
    )
    return (
        per_customer.withColumn("period", F.explode(periods))
        .withColumn("found", F.try_element_at("sums", F.col("period")))
        .select(
            "customer_id",
            "period",
            *[F.coalesce(F.col(f"found.{m}"), F.lit(0.0)).alias(m) for m in measures],
        )
    )


def ordered_head(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order; each task sends its own first rows only."""
    return df.orderBy(*order).limit(n)


def first_keys(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` smallest distinct keys."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)


def lines_of_first_customer(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("customer_id") == lines.agg(F.min("customer_id")).scalar())


def starts_with_digits(column: str) -> Column:
    """The first five characters, or all of a shorter text, are digits."""
    return F.col(column).cast("string").rlike("^([0-9]{5}|[0-9]{1,4}$)")


def id_pattern_split(lines: DataFrame, column: str = "product_id") -> DataFrame:
    """Distinct ids, told apart by whether they start with digits."""
    return lines.select(column).distinct().withColumn("in_pattern", starts_with_digits(column))


def ids_per_pattern(lines: DataFrame, column: str = "product_id") -> DataFrame:
    return (
        id_pattern_split(lines, column).groupBy("in_pattern").agg(F.count(F.lit(1)).alias("ids"))
    )


