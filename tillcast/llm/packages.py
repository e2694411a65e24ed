"""Packages of alike sets, and the exact comparison of packages that may hold linked sets.

A set that is much like another, its leader, is kept as the shingles that it adds and lacks.
A leader's sets are dealt to packages of bounded size. Searches for similar texts put packages,
not sets, into their lists, and hand over pairs of packages; a pair is compared in one task,
where the overlaps of a leader are computed and those of its followers are derived from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm import words as W
from tillcast.session import materialise

#: Entries of a list that are compared with each other in one cell; longer lists have more cells.
CELL = 1024
#: A follower shares 30 % of its leader's and its own shingles together.
ALIKE = 30
#: Sets and differing shingles of a package, on average.
PACKAGE_SETS, PACKAGE_CHANGES = 128, 1 << 15
#: Columns of the incidence matrices that are multiplied at a time.
COLUMNS = 1 << 12
NEEDED_BITS, NEEDED_PIECES = 1 << 25, 256


def sets_of_texts(texts: list[bytes | None], size: int, memory: W.Memory) -> list[np.ndarray]:
    return [W.shingles(W.ids((t or b"").lower().split(), memory), size) for t in texts]


def name_of(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


class Ids:
    """The number of each class: the first bytes of its name, but for names that clash so."""

    def __init__(self, width: int, other: dict[bytes, int]):
        self.width, self.other = width, other

    def __call__(self, name: bytes) -> int:
        found = self.other.get(name)
        return int.from_bytes(name[: self.width], "big", signed=self.width == 8) if found is None else found

    def column(self, name: str) -> Column:
        plain = F.conv(F.hex(F.substring(name, 1, self.width)), 16, -10).cast("long")
        pairs = [F.when(F.col(name) == F.lit(bytearray(k)), F.lit(v)) for k, v in self.other.items()]
        return F.coalesce(*pairs, plain)


def numbered(names: DataFrame, width: int) -> Ids:
    """Numbers that tell all classes apart. Names that clash are few, below one in a billion
    while there are fewer than 2 ** 34 classes, and get numbers of their own."""
    ids, salt = Ids(width, {}), 0
    while True:
        numbers = names.select("class", ids.column("class").alias("id"))
        clashing = numbers.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
        found = [bytes(r[0]) for r in numbers.join(clashing, "id").select("class").collect()]
        if not found:
            return ids
        salt += 1
        fresh = {n: int.from_bytes(xxhash.xxh3_64_digest(n, salt), "big") - 2**63 for n in found}
        ids = Ids(width, ids.other | fresh)


class Seen(set):
    """Names met in this task, as far as memory goes; a repeated one costs work only."""

    def new(self, name: bytes | None) -> bool:
        if name is None or name in self:
            return False
        if len(self) >= W.REMEMBERED:
            self.clear()
        self.add(name)
        return True


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of such sizes share at least if they are linked."""
    return -(-percent * (a + b) // (100 + percent))


def merged(rows: DataFrame, combine: np.ufunc, kind: type, to: type) -> dict[int, np.ndarray]:
    """The arrays of (piece, binary) rows, combined by piece, a row at a time in tasks; as many
    reach the driver as there are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, kind).astype(to)
                found[piece] = combine(found[piece], part) if piece in found else part
        columns = [pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "raw"])

    rows = rows.toDF("piece", "raw").repartition("piece").mapInArrow(run, "piece int, raw binary")
    return {r[0]: np.frombuffer(r[1], to) for r in rows.collect()}


def _needed(classes: DataFrame, ids: DataFrame) -> bytes:
    """Bits of the hashed doc_id of one text for each class in ``ids``; wrong ones do no harm."""
    keys = classes.join(ids, "id", "left_semi").select(_key(F.col("low")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(NEEDED_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        pieces = np.packbits(bits).reshape(NEEDED_PIECES, -1)
        kept = np.flatnonzero(pieces.any(axis=1))
        columns = [pa.array(kept, pa.int32()), pa.array([pieces[i].tobytes() for i in kept], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "raw"])

    found = merged(keys.mapInArrow(run, "piece int, raw binary"), np.bitwise_or, np.uint8, np.uint8)
    out = np.zeros((NEEDED_PIECES, NEEDED_BITS // 8 // NEEDED_PIECES), np.uint8)
    for piece, bits in found.items():
        out[piece] = bits
    return out.tobytes()


def _key(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1))), F.lit(NEEDED_BITS))


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, number: Ids, size: int) -> DataFrame:
    """``id, members``: the sets of ``ids``, read from the texts again; some come repeatedly, and
    a few that are not asked for."""
    bits = docs.sparkSession.sparkContext.broadcast(_needed(classes, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = W.hashes(), Seen()
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in batches:
            rows = np.flatnonzero(wanted[batch.column(0).to_numpy()])
            texts = W.texts(batch.column(1).take(pa.array(rows)))
            named = [(s, name_of(s)) for s in sets_of_texts(texts, size, memory)]
            kept = [(s, name) for s, name in named if seen.new(name)]
            columns = [
                pa.array([number(name) for _, name in kept], pa.int64()),
                pa.array([s.tobytes() for s, _ in kept], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "members"])

    rows = docs.select(_key(F.col("doc_id")).alias("key"), "text")
    return materialise(rows.mapInArrow(run, "id long, members binary"))


def followers(sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """``leader, id, n, added, removed`` of the sets much like their leader's."""
    follower = sets.join(leaders, "id")
    leader = sets.join(leaders.select(F.col("leader").alias("id")).distinct(), "id", "left_semi")
    leader = leader.select(F.col("id").alias("leader"), F.col("members").alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for top, key, members, whole in zip(*columns):
                own, other = np.frombuffer(members, np.uint64), np.frombuffer(whole, np.uint64)
                added = np.setdiff1d(own, other, assume_unique=True)
                removed = np.setdiff1d(other, own, assume_unique=True)
                same = len(own) - len(added)
                if 100 * same >= ALIKE * (len(other) + len(added)):
                    out.append((top, key, len(own), added.tobytes(), removed.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*out)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["leader", "id", "n", "added", "removed"],
            )

    joined = follower.join(leader, "leader").select("leader", "id", "members", "whole")
    kinds = "leader long, id long, n int, added binary, removed binary"
    return materialise(joined.mapInArrow(run, kinds)).dropDuplicates(["id"])


def members_of(following: DataFrame, lists: DataFrame) -> DataFrame:
    """``leader, block, id, n, added, removed``: each set in the lists, in its package.

    A leader's sets are dealt by hash to as many blocks as keep packages small on average.
    """
    nothing = F.unhex(F.lit(""))
    alone = (
        lists.groupBy("id")
        .agg(F.first("n").alias("n"))
        .join(following.select("id"), "id", "left_anti")
        .select(F.col("id").alias("leader"), "id", "n", nothing.alias("added"), nothing.alias("removed"))
    )
    members = materialise(following.unionByName(alone))
    changes = (F.length("added") + F.length("removed")) / 8
    loads = members.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"), F.sum(changes).alias("changes"))
    blocks = F.greatest(F.ceil(F.col("sets") / PACKAGE_SETS), F.ceil(F.col("changes") / PACKAGE_CHANGES))
    # Most leaders have one block; the others' sets are dealt out.
    split = loads.select("leader", blocks.alias("blocks")).where("blocks > 1")
    dealt = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1)))
    return materialise(
        members.join(split, "leader", "left").withColumn("block", dealt.cast("int")).drop("blocks")
    )


def package_entries(lists: DataFrame, members: DataFrame) -> DataFrame:
    """``token, leader, block, low, high, at, left``: one entry of a package in each list.

    ``low`` and ``high`` bound its sets' sizes, ``at`` and ``left`` are the most shingles that
    one of them has before and behind. Lists of one package are left out, long ones have cells:
    an entry of part ``part`` meets those of the cell's other part, or all of its own.
    """
    of = members.select("id", "leader", "block")
    entries = materialise(
        lists.join(of, "id")
        .groupBy("token", "leader", "block")
        .agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.max("at").alias("at"),
            F.max(F.col("n") - F.col("at") - 1).alias("left"),
        )
    )
    lengths = entries.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    parts = F.ceil(F.col("length") / CELL).cast("int")
    part = F.pmod(F.xxhash64("leader", "block"), "parts").cast("int")
    met = entries.join(lengths.select("token", parts.alias("parts")), "token").withColumn("part", part)
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least(j, "part").alias("x"), F.greatest(j, "part").alias("y")),
    )
    return met.select("*", F.explode(cells).alias("cell")).select(
        "token", "cell.x", "cell.y", "part", "leader", "block", "low", "high", "at", "left"
    )


def _list_pairs(low, high, at, left, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries i < j of one list whose sets may be linked, by size and position.

    The list is in blocks of sizes that differ by less than a link's sets may, each sorted by
    the shingles left. What an entry and a block's smallest set need is a place in that order,
    and the block is skipped from there.
    """
    step = np.log(100 / percent) if percent < 100 else 1e-9
    band = np.floor(np.log(low) / step)
    order = np.lexsort((-left, band))
    edges = np.flatnonzero(np.r_[True, np.diff(band[order]) != 0, True])
    one, two = [], []
    for a, b in zip(edges, edges[1:]):
        block = order[a:b]
        behind, smallest, largest = -left[block], low[block].min(), high[block].max()
        sizes = (100 * high >= percent * smallest) & (100 * largest >= percent * low)
        need = least_overlap(low, smallest, percent) - 1 - at
        ends = np.where(sizes, np.searchsorted(behind, -need, "right"), 0)
        rows = np.repeat(np.arange(len(low)), ends)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(ends) - ends, ends)
        one.append(rows)
        two.append(block[inside])
    i, j = np.concatenate(one), np.concatenate(two)
    first = i < j
    i, j = i[first], j[first]
    shared = np.minimum(at[i], at[j]) + 1 + np.minimum(left[i], left[j])
    fits = (
        (100 * high[i] >= percent * low[j])
        & (100 * high[j] >= percent * low[i])
        & (shared >= least_overlap(low[i], low[j], percent))
    )
    return i[fits], j[fits]


def package_pairs(entries: DataFrame, percent: int, counted: bool = True) -> DataFrame:
    """Pairs of packages that meet in the lists: leader_a, block_a, leader_b, block_b.

    With ``counted`` the lists are those of all first shingles of a set in one order, of which
    linked sets share a number that follows from their sizes.
    """
    names = ["leader_a", "block_a", "leader_b", "block_b", "low_a", "high_a", "low_b", "high_b"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()] + [pa.int32()] * 4

    def pairs(cell: list[np.ndarray]) -> list[np.ndarray]:
        x, y = cell[1][0], cell[2][0]
        part, leader, block, low, high, at, left = cell[3:]
        # A pair has one order, whichever list it is found in.
        order = np.lexsort((block, leader))
        part, leader, block, low, high, at, left = (c[order] for c in (part, leader, block, low, high, at, left))
        i, j = _list_pairs(*[c.astype(np.int64) for c in (low, high, at, left)], percent)
        if x != y:
            across = part[i] != part[j]
            i, j = i[across], j[across]
        return [leader[i], block[i], leader[j], block[j], low[i], high[i], low[j], high[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for batch in _with_end(batches):
            rows = None if batch is None else [c.to_numpy() for c in batch.columns]
            if waiting:
                rows = waiting[0] if rows is None else [np.concatenate(c) for c in zip(waiting[0], rows)]
                waiting = []
            if rows is None or not len(rows[0]):
                continue
            key = np.stack(rows[:3])
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
            if batch is not None:
                # The last list may go on in the next batch.
                waiting = [[c[edges[-2] :] for c in rows]]
                edges = edges[:-1]
            found = [pairs([c[a:b] for c in rows]) for a, b in zip(edges, edges[1:]) if b - a > 1]
            if found:
                columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    lists = entries.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    schema = "leader_a long, block_a int, leader_b long, block_b int, low_a int, high_a int, low_b int, high_b int"
    met = (
        lists.mapInArrow(run, schema)
        .groupBy(*names[:4])
        .agg(
            F.count(F.lit(1)).alias("k"),
            *[F.min(c).alias(c) for c in ("low_a", "low_b")],
            *[F.max(c).alias(c) for c in ("high_a", "high_b")],
        )
    )
    if counted:
        rest = [F.ceil(F.col(f"high_{s}") * percent / 100) - 1 for s in "ab"]
        least = F.ceil((F.col("low_a") + F.col("low_b")) * percent / (100 + percent))
        met = met.where(F.col("k") >= least - F.greatest(*rest))
    return materialise(met.select(*names[:4]))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def packages_of(sets: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``leader, block, members, sets`` of the packages in ``wanted``: the leader's set, and the
    sets by their differences from it."""
    parts = (
        members.join(wanted, ["leader", "block"], "left_semi")
        .groupBy("leader", "block")
        .agg(F.collect_list(F.struct("id", "n", "added", "removed")).alias("sets"))
    )
    leaders = wanted.select(F.col("leader").alias("id")).distinct()
    whole = sets.join(leaders, "id", "left_semi").dropDuplicates(["id"])
    whole = whole.select(F.col("id").alias("leader"), "members")
    return materialise(parts.join(whole, "leader").select("leader", "block", "members", "sets"))


class _Package:
    """A leader's set and the differences of the sets kept with it. ``groups`` names the sets'
    groups; without it each set is one of its own."""

    def __init__(self, whole: bytes, sets: list[dict], groups: list[int] | None = None):
        self.whole = np.frombuffer(whole, np.uint64)
        self.names = [s["id"] for s in sets]
        self.groups = groups or self.names
        self.n = np.array([s["n"] for s in sets], np.int64)
        parts, signs, owners = [], [], []
        for i, s in enumerate(sets):
            for raw, sign in ((s["added"], 1), (s["removed"], -1)):
                part = np.frombuffer(raw, np.uint64)
                parts.append(part)
                signs.append(np.full(len(part), sign, np.int8))
                owners.append(np.full(len(part), i, np.int32))
        self.changed = np.concatenate(parts) if parts else self.whole[:0]
        self.signs, self.owners = np.concatenate(signs), np.concatenate(owners)

    def overlaps_with(self, other: np.ndarray) -> np.ndarray:
        """How much each set shares with a sorted set: the leader's share and the differences."""
        leader = len(np.intersect1d(self.whole, other, assume_unique=True))
        if not len(self.changed) or not len(other):
            return np.full(len(self.n), leader)
        found = other[np.minimum(np.searchsorted(other, self.changed), len(other) - 1)] == self.changed
        return leader + np.bincount(self.owners[found], self.signs[found], len(self.n)).astype(np.int64)


def _overlaps(a: _Package, b: _Package) -> np.ndarray:
    """Shared shingles of every set of ``a`` with every one of ``b``.

    The answers of a's leader come first; those of its followers differ only by shingles that
    they added or removed: for these the sets of b that hold them are looked up, of which the
    leader of b again answers for all but the differences.
    """
    out = np.repeat(b.overlaps_with(a.whole)[None, :], len(a.n), axis=0)
    shingles, column = np.unique(a.changed, return_inverse=True)
    if not len(shingles):
        return out
    held = b.whole[np.minimum(np.searchsorted(b.whole, shingles), max(len(b.whole) - 1, 0))] == shingles
    place = np.minimum(np.searchsorted(shingles, b.changed), len(shingles) - 1)
    hit = np.flatnonzero(shingles[place] == b.changed) if len(b.changed) else np.zeros(0, np.int64)
    for begin in range(0, len(shingles), COLUMNS):
        end = min(begin + COLUMNS, len(shingles))
        mine = (column >= begin) & (column < end)
        changes = np.zeros((len(a.n), end - begin), np.float32)
        changes[a.owners[mine], column[mine] - begin] = a.signs[mine]
        holds = np.repeat(held[None, begin:end], len(b.n), axis=0).astype(np.float32)
        theirs = hit[(place[hit] >= begin) & (place[hit] < end)]
        holds[b.owners[theirs], place[theirs] - begin] = b.signs[theirs] > 0
        out += np.rint(changes @ holds.T).astype(np.int64)
    return out


def _linked(a: _Package, b: _Package | None, percent: int) -> tuple[list[tuple], list[tuple], list[int]]:
    """Links that connect what is linked between two packages, or inside one, how many links
    each set has, and the groups of the sets of ``a`` after it: (id, id), (id, count), least ids.

    Groups that are connected inside their packages take one link, not one for each set: the
    links of a large group are few, however many pairs of its packages are compared.
    """
    other = b or a
    shared = _overlaps(a, other)
    union = a.n[:, None] + other.n[None, :] - shared
    linked = 100 * shared >= percent * union
    if b is None:
        linked &= ~np.eye(len(a.n), dtype=bool)
        counts = list(zip(a.names, linked.sum(axis=1).tolist()))
        linked = np.triu(linked)
    else:
        counts = list(zip(a.names, linked.sum(axis=1).tolist())) + list(zip(b.names, linked.sum(axis=0).tolist()))
    # Of the links only a spanning forest: a set is told of one partner in its group.
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    links = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = top(a.groups[i]), top(other.groups[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((a.groups[i], other.groups[j]))
    return links, [(name, k) for name, k in counts if k], [top(x) for x in a.groups]


def compare(packages: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``a, b, links``: links of a forest over each pair (links null), and link counts (b null)."""
    schema = "a long, b long, links long"
    row = pa.struct([(c, pa.int64()) for c in ("a", "b", "links")])
    own_kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(row)]

    def rows(links: list[tuple], counts: list[tuple], groups: list[int]) -> list[tuple]:
        return [(x, y, None) for x, y in links] + [(x, None, k) for x, k in counts]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            four = zip(*[batch.column(i).to_pylist() for i in range(4)])
            out = []
            for leader, block, whole, sets in four:
                linked = _linked(_Package(whole, sets), None, percent)
                out.append((leader, block, linked[2], rows(*linked)))
            columns = list(zip(*out)) or [[] for _ in own_kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, own_kinds)], names=["leader", "block", "groups", "found"]
            )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            six = zip(*[batch.column(i).to_pylist() for i in range(6)])
            found = [
                row
                for wa, sa, ga, wb, sb, gb in six
                for row in rows(*_linked(_Package(wa, sa, ga), _Package(wb, sb, gb), percent))
            ]
            columns = list(zip(*found)) or [[] for _ in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    with W.batch_rows(packages.sparkSession, 16):
        several = packages.where(F.size("sets") > 1).select("leader", "block", "members", "sets")
        found = "leader long, block int, groups array<long>, found array<struct<a:long,b:long,links:long>>"
        own = materialise(several.mapInArrow(inside, found))
        grouped = packages.join(own.select("leader", "block", "groups"), ["leader", "block"], "left")
        side = lambda s: grouped.select(
            *[F.col(c).alias(f"{c}_{s}") for c in ("leader", "block", "members", "sets", "groups")]
        )
        both = pairs.join(side("a"), ["leader_a", "block_a"]).join(side("b"), ["leader_b", "block_b"])
        both = both.select("members_a", "sets_a", "groups_a", "members_b", "sets_b", "groups_b")
        return own.select(F.inline("found")).union(materialise(both.mapInArrow(across, schema)))
