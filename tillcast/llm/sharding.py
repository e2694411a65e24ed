"""Shards of nearly equal bytes by sampled splitters, with Spark expressions only.

The order of the rows is that of a key: a hash of the text, then the row's id and the hash
of all columns, so equal texts lie together and a large group can still be divided. Rows are
sampled with a probability in proportion to their bytes; quantiles of the sampled keys are
the splitters of ranges. Each range's bytes are then summed exactly, and overfull ranges
get splitters of their own. Rows are partitioned by range, and running sums inside a range
plus the totals of the ranges before it give every row its place in the whole order. The
shard follows from the place, so shard sizes differ by about one row's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import materialise, small_table

SAMPLES_PER_RANGE = 24
MOST_RANGES = 4096
SLICE_BITS = 52
OVERFULL = 2.0
ROUNDS = 4
KEY = ("k1", "k2", "k3")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _key(docs: DataFrame) -> list[Column]:
    rest = [F.col(f"`{c}`") for c in docs.columns]
    return [
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k2"),
        F.xxhash64(*rest).alias("k3"),
    ]


def _ranged(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``rows`` with the number of splitters at or below the key, as column range.

    Ranges are listed under each slice of k1 that they touch, so the lookup is a join by slice
    with a table of at most MOST_RANGES and as many slices in rows, hence the broadcast.
    """
    least = (-(2**63),) * 3
    edges = [least, *splitters, None]
    table = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        last = (high or (2**63 - 1,))[0] >> SLICE_BITS
        table += [(b, i, *low, *(high or (None,) * 3)) for b in range(low[0] >> SLICE_BITS, last + 1)]
    names = [f"low_{k}" for k in KEY] + [f"high_{k}" for k in KEY]
    kinds = "slice long, range int, " + ", ".join(f"{n} long" for n in names)
    ranges = F.broadcast(small_table(rows.sparkSession, table, kinds))
    key, low, high = (F.struct(*[F.col(p + k).alias(k) for k in KEY]) for p in ("", "low_", "high_"))
    inside = (key >= low) & (F.col("high_k1").isNull() | (key < high))
    by_slice = F.shiftright("k1", SLICE_BITS) == F.col("slice")
    return rows.join(ranges, by_slice & inside).drop("slice", *names)


def _sample(rows: DataFrame, per_byte: float, salt: int) -> list[tuple]:
    """Keys drawn with probability min(1, bytes * per_byte); a hash decides, not a generator."""
    unit = (F.xxhash64(F.lit(salt), *KEY) / F.lit(2.0**64)) + 0.5
    drawn = rows.where(unit < F.col("size") * F.lit(per_byte))
    # A row of more bytes than the step counts as often as it has steps.
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(per_byte))
    # About SAMPLES_PER_RANGE keys a range, so their number has a bound.
    return sorted((r[0], r[1], r[2], r[3]) for r in drawn.select(*KEY, weight).collect())


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Boundaries that cut the sampled weight into equal parts."""
    total, run, out = sum(s[3] for s in sample), 0.0, []
    for s in sample:
        while len(out) < parts - 1 and run >= total * (len(out) + 1) / parts:
            out.append(s[:3])
        run += s[3]
    return sorted(set(out))


def splitters(rows: DataFrame, total: int, ranges: int) -> tuple[list[tuple], list]:
    """Range boundaries of ``rows`` (KEY and size), and (range, rows, bytes) of each range."""
    found = _quantiles(_sample(rows, SAMPLES_PER_RANGE * ranges / max(total, 1), 0), ranges)
    for attempt in range(1, ROUNDS + 1):
        tally = (
            _ranged(rows, found)
            .groupBy("range")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("top"))
            .orderBy("range")
            .collect()
        )
        full = [
            r for r in tally if r.n > 1 and r.bytes > OVERFULL * total / ranges + r.top
        ]
        if not full or attempt == ROUNDS:
            return found, tally
        # Sample the overfull ranges again, by themselves and more closely.
        inside = _ranged(rows, found).where(F.col("range").isin([r["range"] for r in full]))
        sample = _sample(inside, 2 * SAMPLES_PER_RANGE * ranges / total, attempt)
        more = []
        for r in full:
            lower = found[r["range"] - 1] if r["range"] else None
            upper = found[r["range"]] if r["range"] < len(found) else None
            own = [
                s for s in sample
                if (lower is None or s[:3] >= lower) and (upper is None or s[:3] < upper)
            ]
            more += _quantiles(own, 1 + round(r.bytes * ranges / total))
        if not set(more) - set(found):
            return found, tally
        found = sorted({*found, *more})
    raise AssertionError("unreachable")


def shard(
    docs: DataFrame, shards: int = 8, ranges_per_shard: int = 16, range_bytes: int = 1 << 28
) -> DataFrame:
    """``docs`` with size, shard (0 to shards - 1) and slot (0, 1, ... in each shard).

    Needs doc_id and text; columns of those three names are replaced, all others stay. Null
    texts have one byte; rows without doc_id come first among equal texts; repeated rows
    take neighbouring places, which of them takes which does not show. An empty table gives
    no rows. Ranges hold about ``range_bytes``, and there are ``ranges_per_shard`` for a shard
    at least and MOST_RANGES at most: some dozen keys and one total for each reach the driver.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    # Other columns go under numbers meanwhile, so that no name can clash.
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    keyed = docs.select(*numbered, text_bytes(F.col("text")).alias("size"), *_key(docs))
    narrow = materialise(keyed.select(*KEY, "size"))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(shards * ranges_per_shard, total // range_bytes))
    found, tally = splitters(narrow, total, ranges)
    offsets, n, size = [], 0, 0
    for r in tally:
        offsets.append((r["range"], n, size))
        n, size = n + r.n, size + r.bytes
    before = small_table(spark, offsets, "range int, rows_before long, bytes_before long")

    def place(rows: DataFrame) -> DataFrame:
        in_range = Window.partitionBy("range").orderBy(*KEY)
        so_far = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = _ranged(rows, found).select(
            "*",
            F.row_number().over(in_range).alias("row"),
            F.sum("size").over(so_far).alias("bytes"),
        )
        # One row a range: the broadcast has MOST_RANGES rows at most.
        ranked = ranked.join(F.broadcast(before), "range")
        # The row's middle byte decides.
        middle = ((F.col("bytes_before") + F.col("bytes")) * 2 - F.col("size")) * shards
        return ranked.withColumn("place", F.col("rows_before") + F.col("row") - 1).withColumn(
            "shard", F.least(F.lit(shards - 1), F.floor(middle / (2 * max(total, 1)))).cast("int")
        )

    firsts = place(narrow).groupBy("shard").agg(F.min("place").alias("first"))
    return (
        place(keyed)
        .join(F.broadcast(firsts), "shard")
        .select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
            "size",
            "shard",
            (F.col("place") - F.col("first")).alias("slot"),
        )
    )
