"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic. The cells' token weights are raked:
scaled to the target of each source, then of each language, then of each topic, again and
again, until all three marginals fit. A cell's documents are then kept with a probability in
proportion to raked over present tokens, calibrated so that the expected tokens are the share
asked for; no probability passes one, and what that cuts off goes to the other cells.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import materialise

MARGINS = ("source", "lang", "topic")
#: Without explicit targets, shares follow the tokens to this power: small groups gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 20
KEEP = 0.8
#: Up to so many cells their probabilities are broadcast.
BROADCAST_CELLS = 100_000


def tokens(text: Column) -> Column:
    """Words and one end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long") + 1


def topic_of(text: Column) -> Column:
    """The form of a text, where the table has no topic of its own."""
    length = F.coalesce(F.length(text), F.lit(0))
    bars = length - F.coalesce(F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0))
    return (
        F.when(bars >= 5, "table")
        .when(length < 600, "brief")
        .when(length >= 5000, "long")
        .otherwise("prose")
    )


def _category(column: Column) -> Column:
    """A value no other has, nulls included, as a string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def chance(docs: DataFrame, seed: int) -> Column:
    """A number in [0, 1) for each doc_id (of rows without one, for each text)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    digits = F.substring(F.md5(F.concat(name, F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None) -> DataFrame:
    """Total tokens wanted of each value of a margin, as a column of the cells."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("sum"))
    if wanted is None:
        part = F.pow(F.col("sum"), POWERS[margin])
    else:
        part = F.lit(0.0)
        for value, weight in wanted.items():
            part = F.when(F.col(margin) == value, F.lit(float(weight))).otherwise(part)
    sums = sums.withColumn("part", part)
    total = sums.agg(F.sum("part").alias("parts"), F.sum("sum").alias("all"))
    # One row.
    shares = sums.join(F.broadcast(total)).select(
        margin,
        F.coalesce(F.try_divide("part", "parts") * F.col("all"), F.lit(0.0)).alias(f"to_{margin}"),
    )
    return cells.join(shares, margin)


def rake(
    cells: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``raked`` tokens.

    Each step sums the weights by one margin in a window and scales them. Cells are as many as
    the values of the margins that occur together; no cell or margin is collected.
    Where targets contradict each other (a value without tokens cannot gain any), the last
    margin fits and the others come as near as the rounds allow.
    """
    for margin in MARGINS:
        cells = _targets(cells, margin, (targets or {}).get(margin))
    cells = materialise(cells.withColumn("raked", F.col("tokens").cast("double")))
    for done in range(1, rounds + 1):
        for margin in MARGINS:
            # Cells are sums already: a value has as many as the other margins have pairs.
            total = F.sum("raked").over(Window.partitionBy(margin))
            # A target of nothing leaves nothing, also where nothing was left before.
            scaled = F.try_divide(F.col("raked") * F.col(f"to_{margin}"), total)
            cells = cells.withColumn("raked", F.coalesce(scaled, F.lit(0.0)))
        if done % 4 == 0 or done == rounds:
            cells = materialise(cells)
    return cells.select(*MARGINS, "tokens", "raked")


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """``cells`` with ``probability``: expected tokens are ``keep`` of all, in raked proportions.

    Cells that would need more than all their documents are taken whole; the scale of the
    rest grows to make up. Only the scale and three sums reach the driver.
    """
    total = cells.agg(F.sum("tokens"), F.sum("raked")).first()
    if not total[0] or not total[1]:
        return cells.withColumn("probability", F.lit(0.0))
    budget, scale = keep * total[0], keep * total[0] / total[1]
    while True:
        whole = cells.where(F.lit(scale) * F.col("raked") >= F.col("tokens"))
        full = whole.agg(F.sum("tokens"), F.sum("raked")).first()
        rest = total[1] - (full[1] or 0.0)
        grown = (budget - (full[0] or 0)) / rest if rest > 1e-9 * total[1] else scale
        if grown <= scale * (1 + 1e-12):
            break
        scale = grown
    probability = F.least(F.lit(1.0), F.lit(scale) * F.col("raked") / F.col("tokens"))
    return cells.withColumn("probability", probability)


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str | None, float]] | None = None,
    keep: float = KEEP,
    seed: int = 7,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with ``mix``: a struct of topic, tokens, weight, probability and kept.

    Needs doc_id, text, source and lang; uses a column topic if there is one. A column called
    mix is replaced, all others stay. Null sources, languages and topics are values of their
    own. Null and empty texts have one token, their end. Rows of one doc_id have one chance,
    so repeated rows stay or go together; rows without doc_id are drawn by their texts. An
    empty table gives no rows. ``targets`` maps source, lang or topic to weights by value
    (values not named get none); without them POWERS decides.
    """
    names = [c for c in docs.columns if c != "mix"]
    topic = F.col("topic") if "topic" in names else topic_of(F.col("text"))
    numbered = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        topic.cast("string").alias("own_topic"),
        tokens(F.col("text")).alias("doc_tokens"),
        chance(docs, seed).alias("chance"),
        _category(F.col("source")).alias("source"),
        _category(F.col("lang")).alias("lang"),
        _category(topic).alias("topic"),
    )
    cells = numbered.groupBy(*MARGINS).agg(F.sum("doc_tokens").alias("tokens"))
    named = {
        m: {"" if v is None else f"={v}": weight for v, weight in wanted.items()}
        for m, wanted in (targets or {}).items()
    }
    cells = materialise(calibrate(rake(materialise(cells), named, rounds), keep))
    drawn = cells.select(
        *MARGINS, (F.col("raked") / F.col("tokens")).alias("weight"), "probability"
    )
    if cells.count() <= BROADCAST_CELLS:
        drawn = F.broadcast(drawn)
    found = F.struct(
        F.col("own_topic").alias("topic"),
        F.col("doc_tokens").alias("tokens"),
        "weight",
        "probability",
        (F.col("chance") < F.col("probability")).alias("kept"),
    )
    return numbered.join(drawn, [*MARGINS]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], found.alias("mix")
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with their own columns."""
    # A column called mix would be replaced: it is put aside meanwhile.
    aside = docs.withColumnRenamed("mix", "mix_of_docs")
    mixed = mix(aside, **options).where("mix.kept").drop("mix")
    return mixed.withColumnRenamed("mix_of_docs", "mix") if "mix" in docs.columns else mixed
