"""Exact join of texts by the Jaccard similarity of their word shingles, skipping by set relations.

Texts of one shingle set are a class; classes are joined. The shingles of a set are ordered by
how frequent they are, rarest first, and its first shingles, so many that two linked sets share
one among them, are entered in index lists, one for each shingle.

* Sets that are much alike are computed together. A set that shares many lists with the same
  other set follows that leader, and is kept as its differences from the leader. Leader and
  followers form packages. An index list has one entry for a package, however many of its sets
  stand in the list, so that alike sets are not looked up one by one.
* Lists are cut into blocks of like set sizes, sorted by how much of a set is left behind the
  entry's position. For an entry the size of a block's sets tells how much has to be left for a
  link; from the place where less is left the rest of the block is skipped.
* Two packages that share enough lists are compared in one task: the overlaps of the leader with
  all sets of the other package are computed, and those of a follower are derived from its
  leader's by the differences alone. That is exact, and so is every filter before it.

The order of the shingles comes from counts in a table of hashed slots of fixed size, over all
texts. Any order gives the same links; a good one keeps the lists short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm import packages as P
from tillcast.llm import words as W
from tillcast.llm.batches import bounded
from tillcast.llm.graph import components
from tillcast.session import materialise

#: Slots of the counts, and slots in a piece that one row carries. 4 bytes a slot are broadcast.
SLOT_BITS, PIECE = 20, 1 << 10
#: Entries of a list that a window may sort; counts tell lists that may be longer beforehand.
WINDOW_ROWS = 1 << 20
#: A follower shares a fifth of its entries with its leader.
SHARED_ENTRIES = 20
ADDED = ("n_shingles", "component_id", "class_id", "n_links")


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _measure(rows: DataFrame, size: int) -> DataFrame:
    """``rows``, whose last column is the text, without it and with n_shingles and class; next to
    them rows of piece and counts only: each task's counts of shingles by slot."""
    width = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = W.hashes(), P.Seen()
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        names, kinds = None, None
        for batch in batches:
            sets = P.sets_of_texts(W.texts(batch.column(width)), size, memory)
            of = [P.name_of(s) for s in sets]
            fresh = [s for s, name in zip(sets, of) if seen.new(name)]
            if fresh:
                slots = (np.concatenate(fresh) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                counts += np.bincount(slots, minlength=1 << SLOT_BITS)
            names, kinds = batch.schema.names[:width], [c.type for c in batch.columns[:width]]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(of, pa.binary()),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=[*names, "n_shingles", "class", "piece", "counts"],
            )
        if counts.any():
            pieces = counts.reshape(-1, PIECE)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.nulls(len(pieces), k) for k in [*kinds, pa.int64(), pa.binary()]],
                    pa.array(range(len(pieces)), pa.int32()),
                    pa.array([p.astype(np.uint32).tobytes() for p in pieces], pa.binary()),
                ],
                names=[*names, "n_shingles", "class", "piece", "counts"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_shingles long, class binary, piece int, counts binary")


def _slot_counts(measured: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur, over all classes of all tasks."""
    counts = np.zeros(((1 << SLOT_BITS) // PIECE, PIECE), np.int64)
    rows = measured.where("piece IS NOT NULL").select("piece", "counts")
    for piece, part in P.merged(rows, np.add, np.uint32, np.int64).items():
        counts[piece] = part
    return np.minimum(counts.ravel(), 2**32 - 1).astype(np.uint32)


def _entries(
    texts: DataFrame, counts, number: P.Ids, size: int, percent: int, window_rows: int
) -> DataFrame:
    """``token, id, n, at, hot``: the first shingles of each set with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen, counted = W.hashes(), P.Seen(), counts.value
        for batch in batches:
            tokens, ids, sizes, places, frequent = [], [], [], [], []
            for found in P.sets_of_texts(W.texts(batch.column(0)), size, memory):
                name = P.name_of(found)
                if not seen.new(name):
                    continue
                n = len(found)
                first = _prefix(n, percent)
                often = counted[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                # The set is sorted, so shingles of equal counts stay in one order everywhere.
                order = np.argsort(often, kind="stable")[:first]
                tokens.append(found[order])
                frequent.append(often[order])
                places.append(np.arange(first, dtype=np.int32))
                ids.append(np.full(first, number(name), np.int64))
                sizes.append(np.full(first, n, np.int32))
            if tokens:
                columns = [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.concatenate(ids)),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(places)),
                    pa.array(np.concatenate(frequent) > window_rows),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "id", "n", "at", "hot"])

    return texts.mapInArrow(run, "token long, id long, n int, at int, hot boolean")


def _shared_lists(entries: DataFrame, any_hot: bool) -> DataFrame:
    """Entries of the lists with several sets, with the list's pivot: its least id.

    A list that may be long is summed up before the shuffle and joined, which splits it over
    tasks; the others, of bounded length, are sorted by a window.
    """
    of_token = Window.partitionBy("token")
    short = (
        (entries.where("NOT hot") if any_hot else entries)
        .select("token", "id", "n", "at")
        .withColumns({"pivot": F.min("id").over(of_token), "last": F.max("id").over(of_token)})
    )
    short = short.where("pivot <> last").drop("last")
    if not any_hot:
        return materialise(short)
    hot = materialise(entries.where("hot").select("token", "id", "n", "at"))
    ends = hot.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("last"))
    long = hot.join(ends.where("pivot <> last").select("token", "pivot"), "token")
    return materialise(short.unionByName(long))


def _leaders(lists: DataFrame, percent: int) -> DataFrame:
    """``id, leader`` of the sets that share enough lists with one pivot, and the pivot's own."""
    entries = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    best = (
        lists.where("id <> pivot")
        .groupBy("id", "n", "pivot")
        .agg(F.count(F.lit(1)).alias("k"))
        .where(F.col("k") * 100 >= entries * SHARED_ENTRIES)
        .groupBy("id")
        .agg(F.max(F.struct("k", (-F.col("pivot")).alias("pivot"))).alias("best"))
        .select("id", (-F.col("best.pivot")).alias("leader"))
    )
    # A pivot has a smaller id than its followers, so chains of pivots end.
    for _ in range(2):
        best = materialise(best)
        above = best.select(F.col("id").alias("leader"), F.col("leader").alias("top"))
        best = best.join(above, "leader", "left").select("id", F.coalesce("top", "leader").alias("leader"))
    return materialise(best)


def _links(
    docs: DataFrame, classes: DataFrame, counts: np.ndarray, number: P.Ids, size: int, percent: int,
    window_rows: int,
) -> DataFrame:
    """Links of all classes, as ``P.compare`` gives them."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    entries = _entries(docs.select("text"), sent, number, size, percent, window_rows)
    lists = _shared_lists(entries, bool((counts > window_rows).any()))
    leaders = _leaders(lists, percent)
    # Only these are read now, and later those alone in a package that meets another.
    alike = materialise(leaders.select("id").union(leaders.select("leader")).distinct())
    sets = P.sets_of(docs, classes, alike, number, size)
    members = P.members_of(P.followers(sets, leaders), lists)
    pairs = P.package_pairs(P.package_entries(lists, members), percent)
    several = members.groupBy("leader", "block").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sides = [pairs.select(F.col(f"leader_{s}").alias("leader"), F.col(f"block_{s}").alias("block")) for s in "ab"]
    wanted = materialise(several.select("leader", "block").union(sides[0]).union(sides[1]).distinct())
    others = wanted.select(F.col("leader").alias("id")).distinct().join(alike, "id", "left_anti")
    rest = P.sets_of(docs, classes, others, number, size)
    return P.compare(P.packages_of(sets.union(rest), members, wanted), pairs, percent)


def jaccard_join(
    docs: DataFrame,
    carry: list[str] | None = None,
    size: int = 5,
    percent: int = 80,
    window_rows: int = WINDOW_ROWS,
    id_bytes: int = 8,
) -> DataFrame:
    """The columns ``carry`` with n_shingles, component_id, class_id and n_links.

    A text's set are its distinct shingles of ``size`` words (A to Z lower-cased); of fewer words
    the whole is one. Texts are linked if they share ``percent`` of the union of their sets.
    ``component_id`` is the least doc_id that links reach, ``class_id`` the least one of an equal
    set, and ``n_links`` counts the other sets that the text's own is linked with. Null and empty
    texts have no shingles and no links and are their own components. Rows without doc_id take
    part, but lend no id. Repeated rows stay, with equal results. doc_id must be a number.
    Carried columns of the result's names are replaced. An empty table gives no rows. A text of
    any length is one set, of 8 bytes a word in the task that reads it.
    """
    bounded(docs.sparkSession)
    carry = [c for c in carry or docs.columns if c not in ADDED]
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = keyed.select(
        *[(F.col("doc_id") if c == "doc_id" else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(carry)],
        "doc_id",
        "text",
    )
    measured = materialise(_measure(rows, size))
    found = measured.where("piece IS NULL").drop("piece", "counts")
    named = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"))
    named = materialise(named)
    number = P.numbered(named, id_bytes)
    classes = named.select(number.column("class").alias("id"), "low")
    texts = keyed.select("doc_id", "text")
    links = materialise(_links(texts, classes, _slot_counts(measured), number, size, percent, window_rows))
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    rooted = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.col("low").alias("class_id"), F.coalesce("root", "id").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    of_class = rooted.join(lowest, "root").join(counts, "id", "left").drop("root")
    none = F.col("id").isNull()
    return found.withColumn("id", number.column("class")).join(of_class, "id", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        "n_shingles",
        F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
