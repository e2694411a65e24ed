"""Group statistics by name, with the null rules of a data-frame ``groupby``."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL_STATS = ["mean", "max", "min", "sum", "count", "std", "skew"]
# Statistics that ``agg_dict`` takes from tallies of the values.
TALLIED = ("nunique", "mode")


def unbiased_skew(biased: Column, n: Column, lowest: Column, highest: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 where they are all equal."""
    n = n.cast("double")
    return (
        F.when(n < 3, F.lit(None))
        .when(highest == lowest, F.lit(0.0))
        .otherwise(biased * F.sqrt(n * (n - 1)) / (n - 2))
    )


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def _ordered(name: str, order: Sequence[str] | None) -> tuple[Column, Column]:
    if not order:
        raise ValueError("first and last need an order")
    by = F.struct(*order)
    return F.col(name), F.when(F.col(name).isNotNull(), by)


def statistic(name: str, stat: str, order: Sequence[str] | None = None) -> Column:
    """One aggregate over column ``name``; nulls are skipped.

    The sum of no values is 0, every other statistic of no values is null.
    """
    x = F.col(name)
    if stat == "sum":
        return F.coalesce(F.sum(x).cast("double"), F.lit(0.0))
    if stat == "mean":
        return F.try_divide(F.sum(x).cast("double"), F.count(x))
    if stat == "max":
        return F.max(_double(name))
    if stat == "min":
        return F.min(_double(name))
    if stat == "count":
        return F.count(x).cast("double")
    if stat == "std":
        return F.stddev_samp(_double(name))
    if stat == "skew":
        return unbiased_skew(
            F.skewness(_double(name)), F.count(x), F.min(_double(name)), F.max(_double(name))
        )
    if stat == "first":
        return F.min_by(*_ordered(name, order))
    if stat == "last":
        return F.max_by(*_ordered(name, order))
    raise ValueError(f"unknown statistic {stat!r}")


def agg_dict(
    df: DataFrame,
    keys: Sequence[str],
    spec: Mapping[str, Iterable[str]],
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Statistics per column, named ``<column>-<stat>``.

    The number of values and the most frequent one come from tallies by key and value, which
    are summed before the shuffle: no task holds all values of a group. Ties of the most
    frequent value go to the smallest.
    """
    spec = {c: list(stats) for c, stats in spec.items()}
    names = [f"{c}-{stat}" for c, stats in spec.items() for stat in stats]
    # The keys are the same in all rows of a group: they order nothing and need not be sent.
    order = [c for c in order or [] if c not in keys]
    plain = [
        statistic(c, stat, order).alias(f"{c}-{stat}")
        for c, stats in spec.items()
        for stat in stats
        if stat not in TALLIED
    ]
    # Without any other statistic this still gives all groups.
    out = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    for c, stats in spec.items():
        wanted = [stat for stat in stats if stat in TALLIED]
        if not wanted:
            continue
        tallies = df.groupBy(*keys, F.col(c).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        known = F.col("_value").isNotNull()
        found = {
            "nunique": F.count("_value").cast("double"),
            "mode": F.min(F.when(known, F.struct(-F.col("_n"), "_value")))["_value"],
        }
        counted = tallies.groupBy(*[F.col(k).alias(f"_{c}_{k}") for k in keys]).agg(
            *[found[stat].alias(f"{c}-{stat}") for stat in wanted]
        )
        same = [F.col(k).eqNullSafe(F.col(f"_{c}_{k}")) for k in keys]
        out = out.join(counted, functools.reduce(operator.and_, same), "left")
    return out.select(*keys, *[F.col(f"`{n}`") for n in names])


def agg_list(
    df: DataFrame,
    keys: Sequence[str],
    stats: Sequence[str] = FULL_STATS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The same statistics for several columns; all numeric ones by default."""
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    return agg_dict(df, keys, {c: stats for c in columns})


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
