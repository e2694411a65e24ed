import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from samples import awkward, documents

from tillcast.llm import merkle


def hashed(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root of ``nodes`` and the siblings of each, level by level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, p in zip(paths, places):
            base = p - p % fanout
            path.append((level[base:p], level[p + 1 : base + fanout]))
        level = [hashed("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def whole(rows, fanout):
    """(doc_id, leaf, subroot, root, path) of all rows, in plain Python."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0], leaf(r)) for r in by[s]), key=lambda x: (x[0] is not None, x)) for s in names}
    trees = {s: climb([h for _, h in leaves[s]], fanout) for s in names}
    root, upper = climb([trees[s][0] for s in names], fanout)
    return [
        (key, h, trees[s][0], root, path + upper[i])
        for i, s in enumerate(names)
        for (key, h), path in zip(leaves[s], trees[s][1])
    ]


def table(spark, rows):
    kinds = "doc_id long, source string, lang string, n_chars long, text string, leaf string, s long, piece int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], kinds)


def found_rows(found):
    return [
        (r["doc_id"], r["leaf"], r["subroot"], r["root"], [(list(p["left"]), list(p["right"])) for p in r["path"]])
        for r in found.collect()
    ]


@pytest.mark.parametrize("fanout, depth", [(3, 1), (3, 2), (2, 1), (4, 1)])
def test_equals_plain_tree(spark, fanout, depth):
    """Sources of many sizes, so that groups are cut short at every level."""
    draw, rows = random.Random(fanout), []
    for i, size in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 31, 55, 5]):
        for _ in range(size):
            key = draw.randrange(10**9)
            rows.append((key, None if i == 4 else f"s{i}é", draw.choice(["en", None]), key % 7, f"t{key}\n"))
    found = merkle.manifest(table(spark, rows), ["doc_id"], fanout, depth)
    assert sorted(found_rows(found)) == sorted(whole(rows, fanout))


def test_awkward_rows(spark):
    rows = [(r[0], None if i % 3 else "a", "en", None, r[1]) for i, r in enumerate(awkward())]
    found = merkle.manifest(table(spark, rows), ["doc_id", "s"], depth=1)
    assert sorted(found_rows(found), key=repr) == sorted(whole(rows, 3), key=repr)
    assert found.columns == ["doc_id", "s", "leaf", "subroot", "root", "path"]
    assert merkle.manifest(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("sources, size", [(1, 1), (1, 40), (40, 1)])
def test_lone_nodes(spark, sources, size):
    rows = [(i * 100 + j, f"s{i:02d}", None, None, None) for i in range(sources) for j in range(size)]
    found = merkle.manifest(table(spark, rows), ["doc_id"], depth=1)
    assert sorted(found_rows(found)) == sorted(whole(rows, 3))


def test_fold_tells_changes(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(30)])
    other = F.sha2(F.concat("text", F.lit("!")), 256)
    found = merkle.manifest(docs, ["doc_id", "text"], depth=2)
    back = found.select(
        (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"),
        (merkle.fold(other, F.col("path")) == F.col("root")).alias("changed"),
    ).collect()
    assert all(r["same"] and not r["changed"] for r in back) and len(back) == 30
