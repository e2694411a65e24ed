"""Running sums and differences per key, in purchase order.

The time of the log is cut into blocks of equal length. Rows of a key and a block are sorted and
summed by a window; the totals of each key and block are summed up once more, so that a row's
value is the total of its key's earlier blocks and the running value inside its own. A key may
hold any share of the rows: what a task sorts is bounded by the rows of a block, whichever keys
these have. Both levels read the same shuffled rows.

``blocks`` tells from a sample which keys have so many rows that they need this. Only these are
cut, so their totals are few; a column without such keys needs one window, which leaves the rows
partitioned by the key. Where all keys are to be cut, the blocks of the others stay side by side:
a window over their key adds up the earlier blocks, and no totals are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import months
from tillcast.session import materialise

# Rows of a block, of all keys together, that a single task may sort.
BLOCK_ROWS = 4_000_000
# Rows of a sample that tell how many rows an hour or a longer time has.
SAMPLED_ROWS = 2_000
HOUR = 3600
# Groups over which rows without a key are spread.
SPREAD = 1024


def sample_share(block_rows: int = BLOCK_ROWS) -> float:
    """Share of the rows that tells times of ``block_rows`` rows."""
    return min(1.0, SAMPLED_ROWS / block_rows)


def block_length(
    dates: DataFrame, sampled: float | None = None, block_rows: int = BLOCK_ROWS, column: str = "order_date"
) -> int:
    """Seconds of the longest blocks, hours times a power of two, none of which has more than
    about ``block_rows`` rows; 0 where one block is enough for all. An hour is the shortest.

    Any length gives the same values. ``sampled`` tells that ``dates`` is such a share of the
    rows already, drawn where that is cheap (``sample_share``). An hour of the log is a row here.
    """
    share = sampled or sample_share(block_rows)
    sample = dates.select(column)
    if share < 1.0 and not sampled:
        sample = sample.sample(share, seed=0)
    hour = F.floor(months.epoch_seconds(column) / HOUR).alias("hour")
    counts = {r["hour"]: r["count"] for r in sample.where(F.col(column).isNotNull()).groupBy(hour).count().collect()}
    most = block_rows * share
    if sum(counts.values()) <= most:
        return 0
    hours = 1
    while max(counts.values()) <= most:
        hours, wider = 2 * hours, {}
        for at, rows in counts.items():
            wider[at // 2] = wider.get(at // 2, 0) + rows
        counts = wider
    return max(1, hours // 2) * HOUR


@dataclass(frozen=True)
class Blocks:
    """Seconds of a block, and by key column the keys whose blocks are spread over tasks, null
    among them. The other keys are cut into blocks too with ``every``, and are in one piece else."""

    seconds: int
    frequent: Mapping[str, Sequence] = field(default_factory=dict)
    every: bool = False


def blocks(
    lines: DataFrame,
    keys: Sequence[str],
    sampled: float | None = None,
    block_rows: int = BLOCK_ROWS,
    column: str = "order_date",
) -> Blocks:
    """How ``running`` cuts ``lines``, by a sample like that of ``block_length``.

    Frequent are keys with more than half the rows of a block in the sample, so those with more
    than a block are among them. There are no more than twice as many as blocks' worths of rows.
    """
    share = sampled or sample_share(block_rows)
    sample = lines.select(*dict.fromkeys([column, *keys]))
    if share < 1.0 and not sampled:
        sample = sample.sample(share, seed=0)
    # A few thousandths of the rows at most, read once for each key.
    sample = materialise(sample)
    seconds = block_length(sample, share, block_rows, column)
    if not seconds and sample.count() <= block_rows * share:
        return Blocks(0)
    most = block_rows * share / 2
    return Blocks(
        seconds or HOUR,
        {key: [r[0] for r in sample.groupBy(key).count().where(F.col("count") > most).collect()] for key in keys},
    )


def _among(key: str, values: Sequence) -> Column:
    known = [F.lit(v) for v in values if v is not None]
    found = F.coalesce(F.col(key).isin(*known), F.lit(False)) if known else F.lit(False)
    return found | F.col(key).isNull() if None in values else found


def _inside(
    df: DataFrame,
    within: Sequence[str],
    key: str,
    order: Sequence[str],
    sums: Mapping[str, str],
    diffs: Mapping[str, str],
    also: Sequence[Column] = (),
) -> DataFrame:
    """Running sums and differences by windows over ``within``; null without a key."""
    w = Window.partitionBy(*within).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col(key).isNotNull()
    return df.select(
        "*",
        *[
            F.when(known & F.col(c).isNotNull(), F.sum(c).over(upto)).alias(name)
            for name, c in sums.items()
        ],
        *[F.when(known, F.col(c) - F.lag(c).over(w)).alias(name) for name, c in diffs.items()],
        *also,
    )


def _block_of(time: str, block: int) -> Column:
    """The block of a row; rows without a time come first."""
    return F.coalesce(F.floor(months.epoch_seconds(time) / block), F.lit(-(2**62))).cast("long")


def _side_by_side(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: Mapping[str, str],
    diffs: Mapping[str, str],
    block: int,
) -> DataFrame:
    """As ``_two_levels``, for keys none of which has many rows: all blocks of a key are in one
    task, one after another. A row's value is the running value inside its block and the total
    of the earlier blocks, by one sort; the block before holds the row before a block's first."""
    rows = df.withColumn("_block", _block_of(order[0], block))
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(key).orderBy("_block", *order)
    known = F.col(key).isNotNull()
    kinds = {n: f.dataType for n, f in zip(sums, df.select(*[F.sum(c) for c in sums.values()]).schema)}
    return rows.select(
        *df.columns,
        *[
            F.when(
                known & F.col(c).isNotNull(),
                F.sum(c).over(upto) + F.coalesce(F.sum(c).over(before), F.lit(0)),
            ).cast(kinds[n]).alias(n)
            for n, c in sums.items()
        ],
        *[F.when(known, F.col(c) - F.lag(c).over(line)).alias(n) for n, c in diffs.items()],
    )


def _two_levels(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: Mapping[str, str],
    diffs: Mapping[str, str],
    block: int,
    frequent: Sequence | None = None,
) -> DataFrame:
    within = ["_key", "_block", "_spread"]
    line = [*order, *[c for c in df.columns if c != key and c not in order]]
    # Rows without a key have no values and need no order.
    at = _block_of(order[0], block)
    cut = F.lit(True) if frequent is None else _among(key, frequent)
    apart = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*line), F.lit(SPREAD))).otherwise(F.lit(0))
    groups = [F.struct(key), F.when(cut, at).otherwise(F.lit(0)).cast("long"), F.coalesce(apart, F.lit(0)).cast("long")]
    # One shuffle for both levels. It is read twice, not made twice, as long as both ask for the
    # same of it: the groups are never null, and both use every column. The groups are not sent.
    rows = df.repartition(*groups).withColumns(dict(zip(within, groups)))
    every = F.max(F.xxhash64(*df.columns))
    last = F.struct(*[F.col(c).alias(f"_{n}") for n, c in diffs.items()])
    totals = rows.groupBy(*within).agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        every.alias("_every"),
        # As a value of the group, or the condition would go below the shuffle.
        F.max(cut & F.col(key).isNotNull()).alias("_cut"),
        *([F.max_by(last, F.struct(*line)).alias("_last")] if diffs else []),
    ).where(F.col("_every").isNotNull() & F.col("_cut")).drop("_every", "_cut")
    # A row for each block in which a key that is cut occurs.
    earlier = Window.partitionBy("_key").orderBy("_block")
    sofar = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *within,
        F.row_number().over(earlier).alias("_place"),
        *[F.sum(f"_sum_{n}").over(sofar).alias(f"_before_{n}") for n in sums],
        *([F.lag("_last").over(earlier).alias("_last")] if diffs else []),
    ).where("_place > 1").drop("_place")
    w = Window.partitionBy(*within).orderBy(*order)
    also = [every.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_every")]
    if diffs:
        also.append((F.row_number().over(w) == 1).alias("_first"))
    found = _inside(rows, within, key, order, sums, diffs, also)
    joined = found.where(F.col("_every").isNotNull()).join(totals, within, "left")
    kinds = {f.name: f.dataType for f in found.schema}
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(f"_before_{n}", F.lit(0))).cast(kinds[n]).alias(n) for n in sums],
        *[
            F.when(F.col("_first"), F.col(c) - F.col(f"_last._{n}")).otherwise(F.col(n)).cast(kinds[n]).alias(n)
            for n, c in diffs.items()
        ],
    )


def running(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    diffs: Mapping[str, str] | None = None,
    block: int | Blocks | None = None,
) -> DataFrame:
    """Add running sums and first differences per ``key``.

    ``sums`` and ``diffs`` map a new column to its source. ``order`` begins with a time and must
    tell rows apart, but for rows that are equal in every column. ``block`` is what ``blocks``
    found, looked up when left out; or the length in seconds of blocks that all keys are cut
    into, 0 for one block.
    """
    sums, diffs = dict(sums or {}), dict(diffs or {})
    if block is None:
        block = blocks(df, [key], column=order[0])
    if isinstance(block, Blocks):
        frequent = block.frequent.get(key, ())
        if block.every:
            every = _two_levels if frequent else _side_by_side
            return every(df, key, order, sums, diffs, block.seconds)
        if frequent:
            return _two_levels(df, key, order, sums, diffs, block.seconds, frequent)
        return _inside(df, [key], key, order, sums, diffs)
    if block:
        return _two_levels(df, key, order, sums, diffs, block)
    return _inside(df, [key], key, order, sums, diffs)


def rolling_mean(
    df: DataFrame, by: Sequence[str], order: str, column: str, name: str, width: int = 3
) -> DataFrame:
    """Mean of the last ``width`` rows, null until that many are there.

    For densified series, whose length per key is bounded by the calendar.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, Window.currentRow)
    full: Column = F.count(column).over(w) == width
    return df.withColumn(name, F.when(full, F.avg(column).over(w)))
