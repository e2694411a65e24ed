"""A Merkle manifest of a dataset, whose upper proofs come from a butterfly exchange.

Leaves are the hashes of rows, in the order of the ids within a source; every FANOUT nodes in a
row become one, level by level, up to the source's subroot, and subroots likewise become the
root. The leaves of a source are cut into aligned blocks of FANOUT ** DEPTH, and a task builds
the trees of its blocks. From there on a block stands for a node: in each round the members of
an aligned group of FANOUT nodes swap their subtree roots, every block of a node with one of
each other node of the group, and each hashes the common parent for itself. After as many
rounds as the tree has upper levels every block holds the root and the siblings of all its
ancestors; nothing is handed down.

Only block rows take part in the rounds, one for FANOUT ** DEPTH documents, and a source of any
share of the rows is as many blocks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.batches import bounded
from tillcast.session import materialise

FANOUT, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ADDED = ("leaf", "subroot", "root", "path")
_MOST_LEVELS = 39
_STEP = "struct<left:array<string>,right:array<string>>"
_STEP_ARROW = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def leaf_hash(*values: Column) -> Column:
    """Hash of the values: each as UTF-8 byte count, ``:`` and text, or ``-`` for none."""
    texts = [v.cast("string") for v in values]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def step(node: Column, at: Column) -> Column:
        return F.sha2(F.concat_ws("", at["left"], node, at["right"]), 256)

    return F.aggregate(path, leaf, step)


def proof_hash(path: Column) -> Column:
    """Hash of the path's siblings, level by level, from left to right."""
    levels = F.transform(path, lambda at: F.concat_ws("", at["left"], at["right"]))
    return F.sha2(F.concat_ws("", levels), 256)


def _levels(count: Column, fanout: int) -> Column:
    """Levels above ``count`` nodes: the least power of the fanout that reaches it."""
    powers = F.array(*[F.lit(fanout**k).cast("long") for k in range(_MOST_LEVELS) if fanout**k < 2**62])
    return F.size(F.filter(powers, lambda p: p < count))


def _ordered(rows: DataFrame, fanout: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with s, block and place, and a row of each source: s, blocks, low, up.

    Rows are spread by ranges of source and id; places continue from range to range.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges come from a sample, so the range numbers are written before use.
    spread = materialise(
        rows.repartitionByRange(pieces, "source_", "key_", "leaf").withColumn(
            "piece", F.spark_partition_id()
        )
    )
    # A row for each source and range that has rows of it.
    shares = spread.groupBy("source_", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = shares.select(
        "source_", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    # Sources are numbered by the range in which they start.
    sources = shares.groupBy("source_").agg(F.min("piece").alias("piece"), F.sum("n").alias("n"))
    starting = sources.groupBy("piece").agg(F.count(F.lit(1)).alias("starting"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    first = starting.select("piece", F.coalesce(F.sum("starting").over(earlier), F.lit(0)).alias("first"))
    in_piece = Window.partitionBy("piece").orderBy("source_")
    size = fanout**depth
    low = F.least(_levels(F.col("n"), fanout), F.lit(depth))
    sources = materialise(
        sources.join(first, "piece").select(
            "source_",
            (F.col("first") + F.row_number().over(in_piece) - 1).alias("s"),
            F.ceil(F.col("n") / size).cast("long").alias("blocks"),
            low.alias("low"),
            (_levels(F.col("n"), fanout) - low).alias("up"),
        )
    )

    starts = begins.join(sources, "source_").select("source_", "piece", "begin", "s", "low")
    inside = Window.partitionBy("source_", "piece").orderBy("key_", "leaf")
    ranked = spread.withColumn("rank", F.row_number().over(inside) - 1)
    place = F.col("begin") + F.col("rank")
    placed = ranked.join(starts, ["source_", "piece"]).select(
        *rows.columns,
        "s",
        "low",
        F.floor(place / size).cast("long").alias("block"),
        (place % size).cast("int").alias("place"),
    )
    return placed, sources.drop("source_")


def _tree(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from ``nodes`` up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        runs = ("".join(below[i : i + fanout]) for i in range(0, len(below), fanout))
        out.append([sha256(run.encode()).hexdigest() for run in runs])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole blocks, with the row at which each begins and the end.

    Rows come sorted by the first two columns, s and block.
    """
    waiting: list[pa.RecordBatch] = []

    def whole() -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        if waiting and sum(map(len, waiting)):
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            yield batch, [0, *changes.tolist(), len(batch)]

    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        # The last block may go on in the next batch.
        cut = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
        if waiting and cut == 0 and [waiting[-1].column(i)[-1].as_py() for i in (0, 1)] != keys[:, 0].tolist():
            yield from whole()
            waiting = []
        if cut:
            waiting.append(batch.slice(0, cut))
            yield from whole()
            waiting = []
        waiting.append(batch.slice(cut))
    yield from whole()


def _block_roots(placed: DataFrame, fanout: int) -> DataFrame:
    """``s, block, top``: the node that each block comes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _blocks(batches):
            leaves, levels = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tops = [_tree(leaves[a:b], levels[a], fanout)[-1][0] for a, b in zip(edges, edges[1:])]
            keys = [batch.column(i).take(pa.array(edges[:-1], pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(tops, pa.string())], names=["s", "block", "top"])

    rows = placed.select("s", "block", "leaf", "low", "place").repartition("s", "block")
    return rows.sortWithinPartitions("s", "block", "place").mapInArrow(run, "s long, block long, top string")


def _local_paths(placed: DataFrame, fanout: int) -> DataFrame:
    """``placed`` with the siblings of each leaf inside its block, as column path."""

    def paths(leaves: list[str], levels: int) -> list[list[dict]]:
        tree = _tree(leaves, levels, fanout)
        out = []
        for place in range(len(leaves)):
            path = []
            for nodes in tree[:-1]:
                base = place - place % fanout
                path.append({"left": nodes[base:place], "right": nodes[place + 1 : base + fanout]})
                place //= fanout
            out.append(path)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _blocks(batches):
            leaves, levels = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [p for a, b in zip(edges, edges[1:]) for p in paths(leaves[a:b], levels[a])]
            column = pa.array(found, pa.list_(_STEP_ARROW))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "path"])

    first = ["s", "block", "leaf", "low"]
    rows = placed.select(*first, *[c for c in placed.columns if c not in first]).repartition("s", "block")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.sortWithinPartitions("s", "block", "place").mapInArrow(run, f"{kinds}, path array<{_STEP}>")


def _received(state: DataFrame, sent: DataFrame, own: Column, active: Column) -> DataFrame:
    """The state after a round: parents hashed from what each block holds and was sent."""
    empty = {c: F.lit(None).cast(state.schema[c].dataType).alias(c) for c in state.columns}
    keys = ["s", "block"]
    rest = [c for c in state.columns if c not in keys]
    messages = sent.select(*keys, *[empty[c] for c in rest], "digit", "got")
    nothing = [F.lit(None).cast("long").alias("digit"), F.lit(None).cast("string").alias("got")]
    # A block is sent at most fanout - 1 roots, so its group is small.
    met = (
        state.select(*keys, *rest, *nothing)
        .unionByName(messages)
        .groupBy(*keys)
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in rest],
            F.sort_array(
                F.collect_list(F.when(F.col("got").isNotNull(), F.struct("digit", "got")))
            ).alias("others"),
        )
        .withColumn("own", own)
    )
    side = lambda keep: F.transform(F.filter("others", keep), lambda o: o["got"])
    step = F.struct(
        side(lambda o: o["digit"] < F.col("own")).alias("left"),
        side(lambda o: o["digit"] > F.col("own")).alias("right"),
    )
    parent = F.sha2(F.concat_ws("", F.col("step.left"), F.col("top"), F.col("step.right")), 256)
    moved = {
        "top": F.when(active, parent).otherwise(F.col("top")),
        "steps": F.when(active, F.concat("steps", F.array("step"))).otherwise(F.col("steps")),
    }
    return materialise(
        met.withColumn("step", step).select(*keys, *[moved.get(c, F.col(c)).alias(c) for c in rest])
    )


def _partners(node: Column, count: Column, width: int, fanout: int) -> Column:
    """To which nodes a node sends its root: array of (to, digit of the sender).

    Nodes are numbered from 0 to ``count``; of each other subtree of ``width`` in the aligned
    group it serves those whose offset is its own, and those beyond the size of its own subtree
    in turn, where that one is cut short by the end.
    """
    unit, offset = F.floor(node / width), node % width
    digit = unit % fanout
    size = F.least(F.lit(width), count - unit * width)
    last = F.ceil(count / width) - 1
    siblings = F.filter(
        F.sequence(unit - digit, F.least(unit - digit + fanout - 1, last)), lambda j: j != unit
    )

    def of(j: Column) -> Column:
        there = F.least(F.lit(width), count - j * width) - 1
        served = F.when(offset <= there, F.sequence(offset, there, size))
        return F.transform(
            F.coalesce(served, F.array().cast("array<bigint>")),
            lambda o: F.struct((j * width + o).alias("to"), digit.alias("digit")),
        )

    return F.flatten(F.transform(siblings, of))


def _exchanged(state: DataFrame, sources: DataFrame, fanout: int) -> DataFrame:
    """``s, block, steps, subroot, top``: upper paths of all blocks, after all rounds."""
    row = sources.agg(F.max("up"), F.count(F.lit(1))).first()
    rounds, count = row[0] or 0, row[1]
    digit = lambda node, width: F.floor(F.col(node) / width) % fanout
    for r in range(rounds):
        width = fanout**r
        to = _partners(F.col("block"), F.col("blocks"), width, fanout)
        sent = state.where(F.col("up") > r).select("s", F.explode(to).alias("m"), "top")
        sent = sent.select("s", F.col("m.to").alias("block"), "m.digit", F.col("top").alias("got"))
        state = _received(state, sent, digit("block", width), F.col("up") > r)
    state = state.withColumn("subroot", F.col("top"))
    there = sources.select("s", F.col("blocks").alias("blocks_there"))
    width = 1
    while width < count:
        to = _partners(F.col("s"), F.lit(count), width, fanout)
        sent = state.select(F.explode(to).alias("m"), "block", "blocks", F.col("top").alias("got"))
        sent = sent.select(F.col("m.to").alias("s"), "m.digit", "got", "block", "blocks").join(there, "s")
        # The blocks there take the blocks here in turn.
        served = F.when(
            F.col("block") < F.col("blocks_there"),
            F.sequence("block", F.col("blocks_there") - 1, F.col("blocks")),
        )
        sent = sent.select("s", F.explode(served).alias("block"), "digit", "got")
        state = _received(state, sent, digit("s", width), F.lit(True))
        width *= fanout
    return state.select("s", "block", "steps", "subroot", "top")


def manifest(
    docs: DataFrame, carry: list[str] | None = None, fanout: int = FANOUT, depth: int = DEPTH
) -> DataFrame:
    """The columns ``carry`` with leaf, subroot, root and path, an array of the siblings on the
    left and the right of each level from the leaf to the root.

    A leaf is the hash of doc_id, source, lang, n_chars and text. In a source leaves follow the
    doc_id, rows without one first, and rows of one doc_id the leaf; sources follow their bytes,
    that of rows without one first. ``fold`` of leaf and path is the root. While a level has
    several nodes its last run may be of one node, which is hashed too; a source of one row has
    its leaf as subroot, a table of one source its subroot as root. Repeated rows are leaves of
    their own. Null and empty texts have different leaves. Texts are hashed where they are read
    and go no further, whatever their length. doc_id must be a number. Carried columns of the
    result's names are replaced. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    carry = [c for c in carry or docs.columns if c not in ADDED]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
        # Rows without a source come first.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_"),
        F.col("doc_id").cast("long").alias("key_"),
        leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"),
    )
    placed, sources = _ordered(rows, fanout, depth)
    placed = materialise(placed.drop("source_", "key_"))
    blocks = _block_roots(placed, fanout).join(sources.drop("low"), "s")
    no_steps = F.array().cast(f"array<{_STEP}>").alias("steps")
    state = materialise(blocks.select("s", "block", "blocks", "up", "top", no_steps))
    upper = _exchanged(state, sources, fanout)
    return _local_paths(placed, fanout).join(upper, ["s", "block"]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        "leaf",
        "subroot",
        F.col("top").alias("root"),
        F.concat("path", "steps").alias("path"),
    )
