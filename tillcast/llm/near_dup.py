"""Near duplicates by an LSH forest.

Texts with equal shingle sets form a class; from there on classes are compared. A class has a
signature of TREES * DEPTH minhashes, and each DEPTH of them in a row are its label in one tree.
In each tree the classes are sorted by label, so that those with a long common prefix are
neighbours. What shares a prefix of LEAST values or more is a region; linked sets share one in
some tree but for a chance of (1 - s**LEAST)**TREES: 4e-7 at a similarity of 0.85, 3e-5 at 0.8.

Classes that stand in a region with others are gathered in packages: each follows the leader that
it meets in most of its regions, and is kept as its differences from that one. So a large group of
near copies is a few entries in a region. All packages of a region are candidates of each other,
and a pair of packages is compared exactly, set by set. The depth of a region adapts to its crowd:
it is the shortest prefix that at most CROWD packages share, or else the whole label. Near copies
do not crowd a region, since they share packages; what does are texts that have a passage in common
and little else, and of these a linked pair meets in its other trees. Packages of one leader are all
candidates of each other besides, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm import packages as P
from tillcast.llm import words as W
from tillcast.llm.batches import bounded
from tillcast.llm.graph import components
from tillcast.session import materialise

TREES, DEPTH = 20, 8
LEAST = 4
#: Packages of one region that are all candidates of each other.
CROWD = 64
VALUE_BYTES = 2
_CHUNK = 1 << 16

_draw = np.random.default_rng(20240501)
_XOR = _draw.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _draw.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """The trees' labels, one after the other, for each set."""
    out: list[bytes | None] = [None] * len(sets)
    full = [i for i, s in enumerate(sets) if len(s)]
    begin = 0
    while begin < len(full):
        end, size = begin, 0
        while end < len(full) and (end == begin or size + len(sets[full[end]]) <= _CHUNK):
            size += len(sets[full[end]])
            end += 1
        part = [sets[i] for i in full[begin:end]]
        starts = np.cumsum([0] + [len(s) for s in part[:-1]])
        h = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(part), len(_XOR)), np.uint32)
        for k in range(len(_XOR)):
            least[:, k] = np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], starts)
        # The smallest values share their upper bits: mix before cutting.
        values = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        rows = values.astype(">u2")
        for i, row in zip(full[begin:end], rows):
            out[i] = row.tobytes()
        begin = end
    return out


def _describe(rows: DataFrame, size: int) -> DataFrame:
    """``rows``, whose last column is the text, with n_shingles, class and signature."""
    width = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = W.hashes()
        for batch in batches:
            sets = P.sets_of_texts(W.texts(batch.column(width)), size, memory)
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([P.name_of(s) for s in sets], pa.binary()),
                pa.array(_signatures(sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], *columns],
                names=[*batch.schema.names[:width], "n_shingles", "class", "signature"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_shingles long, class binary, signature binary")


def _prefix(values: int) -> Column:
    return F.substring("label", 1, values * VALUE_BYTES)


def _shared_regions(classes: DataFrame) -> DataFrame:
    """``tree, label, id, n, pivot``: the labels of classes that share a region with another.

    The pivot of a region is its least id. Regions are summed up before the shuffle, so one of
    any size is a row from each task.
    """
    wide = DEPTH * VALUE_BYTES
    label = F.substring("signature", F.col("tree") * wide + 1, F.lit(wide)).alias("label")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    labels = classes.select("id", "n", "signature", numbers).select("tree", label, "id", "n")
    labels = labels.withColumn("region", F.xxhash64("tree", _prefix(LEAST)))
    ends = labels.groupBy("region").agg(F.min("id").alias("pivot"), F.max("id").alias("last"))
    ends = ends.where("pivot <> last").drop("last")
    return materialise(labels.join(ends, "region").drop("region"))


def _pivots(regions: DataFrame) -> DataFrame:
    """``id, leader``: for each class the pivot that it meets in most of its regions."""
    return materialise(
        regions.where("id <> pivot")
        .groupBy("id", "pivot")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy("id")
        .agg(F.max(F.struct("k", (-F.col("pivot")).alias("pivot"))).alias("best"))
        .select("id", (-F.col("best.pivot")).alias("leader"))
    )


def _following(sets: DataFrame, regions: DataFrame) -> DataFrame:
    """Classes that are much like a leader, as ``packages.followers`` gives them.

    A class much like its pivot goes on to the pivot's own, and so on, as long as it is like
    that one too: so the classes of a crowd come to few leaders, and chance neighbours to none.
    """
    near = materialise(P.followers(sets, _pivots(regions)))
    ends = near.select("id", "leader")
    # A pivot has a smaller id than those that meet it, so chains of pivots end.
    for _ in range(3):
        above = ends.select(F.col("id").alias("leader"), F.col("leader").alias("top"))
        ends = materialise(ends.join(above, "leader", "left").select("id", F.coalesce("top", "leader").alias("leader")))
    further = ends.join(near.select("id", "leader"), ["id", "leader"], "left_anti")
    far = materialise(P.followers(sets, further))
    return far.unionByName(near.join(far.select("id"), "id", "left_anti").select(*far.columns))


def _candidates(regions: DataFrame, members: DataFrame) -> DataFrame:
    """``token, id, n, at``: each class under its regions, at the depth that suits each, and under
    its leader where that one has several packages."""
    rest = regions.drop("pivot")
    packages = members.select("id", "leader", "block")
    several = packages.where("block > 0").select("leader").distinct()
    of_leader = members.join(several, "leader", "left_semi")
    out = of_leader.select(F.xxhash64(F.lit(-1), "leader").alias("token"), "id", "n", F.lit(0).alias("at"))
    for depth in range(LEAST, DEPTH + 1):
        rows = rest.withColumn("token", F.xxhash64("tree", F.lit(depth), _prefix(depth)))
        if depth == DEPTH:
            part, rest = rows, None
        else:
            crowded = (
                rows.select("token", "id")
                .join(packages, "id")
                .groupBy("token")
                # Packages are counted once a task before the shuffle.
                .agg(F.countDistinct("leader", "block").alias("k"))
                .where(F.col("k") > CROWD)
                .select("token")
            )
            crowded = materialise(crowded)
            part = rows.join(crowded, "token", "left_anti")
            rest = None if crowded.isEmpty() else materialise(rows.join(crowded, "token", "left_semi").drop("token"))
        part = part.select("token", "id", "n", F.lit(0).alias("at"))
        out = out.unionByName(part)
        if rest is None:
            return out


def _roots(docs: DataFrame, found: DataFrame, size: int, percent: int) -> tuple[DataFrame, P.Ids]:
    """``id, component_id`` of all classes, and their numbers.

    ``component_id`` is the least doc_id of the component.
    """
    named = materialise(
        found.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("low"),
            F.first("n_shingles").cast("int").alias("n"),
            F.first("signature").alias("signature"),
        )
    )
    number = P.numbered(named, 8)
    classes = named.withColumn("id", number.column("class"))
    regions = _shared_regions(classes)
    sets = P.sets_of(docs, classes.select("id", "low"), regions.select("id").distinct(), number, size)
    members = P.members_of(_following(sets, regions), regions.select("id", "n"))
    pairs = P.package_pairs(P.package_entries(_candidates(regions, members), members), percent, counted=False)
    several = members.groupBy("leader", "block").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sides = [pairs.select(F.col(f"leader_{s}").alias("leader"), F.col(f"block_{s}").alias("block")) for s in "ab"]
    wanted = materialise(several.select("leader", "block").union(sides[0]).union(sides[1]).distinct())
    links = P.compare(P.packages_of(sets, members, wanted), pairs, percent)
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    rooted = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "low", F.coalesce("root", "id").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("id", "component_id", "root"), number


def _grouped(
    docs: DataFrame, carry: list[str], size: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """The columns ``carry`` under numbers, doc_id, row, n_shingles, class, id of its rows, and
    id, component_id, root of its classes."""
    bounded(docs.sparkSession)
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(
        *numbered,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )
    # Row numbers hold from here on, since they are written.
    found = materialise(_describe(rows, size))
    of_class, number = _roots(keyed.select("doc_id", "text"), found, size, percent)
    return found.drop("signature").withColumn("id", number.column("class")), of_class


def _component() -> Column:
    return F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")


def near_duplicates(
    docs: DataFrame, carry: list[str] | None = None, size: int = 5, percent: int = 80
) -> DataFrame:
    """The columns ``carry`` with n_shingles, component_id and kept.

    Two documents are linked if their sets of ``size``-word shingles (lower-cased A-Z) share
    ``percent`` of their union; ``component_id`` is the least doc_id that links reach, itself
    included, and ``kept`` says that it is the row's own. A text of fewer words is one shingle;
    null and empty texts have none, are linked with nothing and kept. Rows without doc_id take
    part, but lend no id: a component of such rows only has none, and they are not kept unless
    empty. Repeated rows stay, with equal results. Carried columns of the result's names are
    replaced. An empty table gives no rows.
    """
    carry = [c for c in carry or docs.columns if c not in ("n_shingles", "component_id", "kept")]
    found, of_class = _grouped(docs, carry, size, percent)
    found = found.join(of_class, "id", "left").withColumn("component_id", _component())
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        "n_shingles",
        "component_id",
        (F.col("class").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias(
            "kept"
        ),
    )


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id, of repeated ones the first row.

    Rows without shingles stay. Columns are those of ``docs``.
    """
    found, of_class = _grouped(docs, docs.columns, size, percent)
    # A component without any id is named by its root here, so that one row of it stays too.
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    narrow = found.select("row", "doc_id", "class", "id").join(of_class, "id", "left")
    narrow = narrow.withColumn("component_id", _component())
    group = F.coalesce(F.col("component_id").cast("string"), F.hex("root"))
    best = (
        narrow.where("class IS NOT NULL")
        .groupBy(group.alias("group"))
        .agg(F.min(rank).alias("best"))
        .select(F.col("best.row").alias("row"))
    )
    stay = best.union(narrow.where("class IS NULL").select("row"))
    # The one shuffle of whole rows.
    whole = found.select("row", *[f"c{i}" for i in range(len(docs.columns))])
    return whole.join(stay, "row", "left_semi").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
