"""Line statistics per customer and period that can be merged over periods.

The lines are read and shuffled once. Each customer keeps a short array with
one entry per period: how many lines, and per measure the count, sum, extremes,
mean and centred second and third moments. Any time window is then a merge of
array entries, so eight trend windows, four season bands and both the train and
the test month cost one aggregation of the lines and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from tillcast.functions import months


def periods(year_months: Sequence[str]) -> Column:
    """Period of a line when only the given months are asked for.

    The period is the index of the last boundary at or before the line, where the
    boundaries are the start and the end of each month; 0 is before all of them.
    """
    starts = sorted({months.month_index(m) + k for m in year_months for k in (0, 1)})
    out = F.lit(0)
    for s in starts:
        name = months.month_name(s)
        out = F.when(F.col("order_date") >= months.month_start(name), F.lit(s)).otherwise(out)
    return out


def sum_scale(lines: DataFrame, measures: Sequence[str]) -> int | None:
    """Decimal places of the measures' sums; none where a measure is a double.

    A sum of doubles that is rounded to these places is the double next to the
    exact sum, whatever the order of addition.
    """
    kinds = [lines.schema[m].dataType for m in measures]
    if any(isinstance(k, (DoubleType, FloatType)) for k in kinds):
        return None
    return max([k.scale for k in kinds if isinstance(k, DecimalType)], default=0)


def rounded(expression: str, scale: int | None) -> str:
    return expression if scale is None else f"round({expression}, {scale})"


def history(
    lines: DataFrame,
    measures: Sequence[str],
    period: Column,
    key: str = "customer_id",
) -> DataFrame:
    """One row per customer with the array ``hist`` of period entries.

    An entry has the period ``p``, the line count ``rows``, the total ``spend``,
    the ``first_date`` and ``last_date``, and in ``of`` the moments of each measure in turn.
    """
    aggs, moments = [], []
    for i, m in enumerate(measures):
        aggs += [
            f"count(`{m}`) as n{i}",
            f"sum(`{m}`) as s{i}",
            f"min(_x{i}) as lo{i}",
            f"max(_x{i}) as hi{i}",
            f"var_pop(_x{i}) as v{i}",
            f"skewness(_x{i}) as g{i}",
        ]
        moments.append(
            f"""named_struct(
                'n', n{i}, 's', coalesce(cast(s{i} as double), 0D), 'lo', lo{i}, 'hi', hi{i},
                'mu', try_divide(cast(s{i} as double), n{i}),
                'm2', coalesce(v{i} * n{i}, 0D),
                'm3', coalesce(g{i} * v{i} * sqrt(v{i}) * n{i}, 0D))"""
        )
    values = [F.col(m).cast("double").alias(f"_x{i}") for i, m in enumerate(measures)]
    extra = [m for m in measures if m != "total"]
    by_period = (
        lines.where(F.col(key).isNotNull())
        .select(key, period.alias("p"), "order_date", "total", *extra, *values)
        .groupBy(key, "p")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("spend"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
            *map(F.expr, aggs),
        )
    )
    entry = ["p", "rows", "spend", "first_date", "last_date"]
    if measures:
        entry.append(F.expr(f"array({', '.join(moments)}) as of"))
    # Bounded by the number of periods, however many lines a customer has.
    return by_period.groupBy(key).agg(F.collect_list(F.struct(*entry)).alias("hist"))


def at_months(hist: DataFrame, year_months: Sequence[str], key: str = "customer_id") -> DataFrame:
    """One row per customer and month with lines before it: ``ref, past, spend``.

    ``past`` holds the entries before the month, ``spend`` the total within it.
    """
    refs = F.array(*[F.lit(months.month_index(m)) for m in sorted(year_months)])
    return (
        hist.select(key, "hist", F.explode(refs).alias("ref"))
        .selectExpr(
            key,
            "ref",
            "filter(hist, e -> e.p < ref) as past",
            "coalesce(get(filter(hist, e -> e.p = ref), 0).spend, 0D) as spend",
        )
        .where("size(past) > 0")
    )


# Statistics of a window from its entries' moments ``x`` of one measure. The
# centred moments are moved from the period means to the window mean ``mu``; the
# third also needs the second: sum((x - mu)^3) = m3 + 3 d m2 + n d^3, d = mean - mu.
_PLAIN = """named_struct(
    'n', aggregate(x, 0L, (acc, e) -> acc + e.n),
    's', {sum},
    'lo', array_min(transform(x, e -> e.lo)),
    'hi', array_max(transform(x, e -> e.hi)))"""
_SUM = "aggregate(x, 0D, (acc, e) -> acc + e.s)"
_CENTRED = """named_struct('a', a,
    'm2', aggregate(x, 0D, (acc, e) -> acc + if(e.n > 0,
        e.m2 + e.n * (e.mu - mu) * (e.mu - mu), 0D)),
    'm3', aggregate(x, 0D, (acc, e) -> acc + if(e.n > 0,
        e.m3 + (e.mu - mu) * (3 * e.m2 + e.n * (e.mu - mu) * (e.mu - mu)), 0D)))"""
_RESULT = {
    "mean": "try_divide(c.a.s, c.a.n)",
    "max": "c.a.hi",
    "min": "c.a.lo",
    "sum": "c.a.s",
    "count": "cast(c.a.n as double)",
    "std": """case when c.a.n < 2 then null when c.a.lo = c.a.hi then 0D
        else sqrt(c.m2 / (c.a.n - 1)) end""",
    "skew": """case when c.a.n < 3 then null when c.a.lo = c.a.hi then 0D
        else c.a.n * sqrt(c.a.n - 1D) / (c.a.n - 2D) * c.m3 / (c.m2 * sqrt(c.m2)) end""",
}


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def merged(
    rows: DataFrame,
    windows: dict[str, str],
    measures: Sequence[str],
    stats: Sequence[str],
    scale: int | None,
    chained: bool = False,
    first: int = 0,
) -> DataFrame:
    """Add ``<measure>-<stat><suffix>`` for every window.

    ``windows`` maps a suffix to a condition on an entry ``e``. A window without
    entries yields nulls; with ``chained``, so does one that any later window
    without entries follows. ``scale`` is that of ``sum_scale``. The measures stand in the entries
    from place ``first`` on. The formulas are written once, as a function of
    window and measure, which keeps the plan small however many columns result.
    """
    result = ", ".join(f"'{s}', {_RESULT[s]}" for s in stats)
    cell = _let("c", _CENTRED, f"named_struct({result})")
    cell = _let("mu", "try_divide(a.s, a.n)", cell)
    cell = _let("a", _PLAIN.format(sum=rounded(_SUM, scale)), cell)
    cell = _let("x", f"transform(w, e -> get(e.of, j + {first}))", cell)
    by_measure = f"transform(sequence(0, {len(measures) - 1}), j -> {cell})"
    found = "forall(slice(_w, i + 1, size(_w)), v -> size(v) > 0)" if chained else "size(w) > 0"
    filtered = ", ".join(f"filter(past, e -> {condition})" for condition in windows.values())
    return (
        rows.selectExpr("*", f"array({filtered}) as _w")
        .selectExpr("*", f"transform(_w, (w, i) -> if({found}, {by_measure}, null)) as _cells")
        .selectExpr(
            *[f"`{c}`" for c in rows.columns],
            *[
                f"_cells[{i}][{j}].{stat} as `{m}-{stat}{suffix}`"
                for i, suffix in enumerate(windows)
                for j, m in enumerate(measures)
                for stat in stats
            ],
        )
    )
