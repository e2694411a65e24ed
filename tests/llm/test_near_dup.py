import random

import pytest
from samples import awkward, components, documents, prose, shingles

from tillcast.llm import graph, near_dup


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, size, percent):
    draw, rows = random.Random(size), []
    for group in range(12):
        text = prose(100 + group, draw.choice([40, 150, 400])).split()
        for _ in range(draw.randint(1, 9)):
            copy = list(text)
            for _ in range(draw.randint(0, 1 + len(copy) // 40)):
                copy[draw.randrange(len(copy))] = draw.choice(["alpha", "beta", "gamma", "delta"])
            rows.append((len(rows), " ".join(copy)))
    found = near_dup.near_duplicates(documents(spark, rows), ["doc_id"], size, percent).toPandas()
    want = components([t for _, t in rows], size, percent)
    assert found.set_index("doc_id").component_id.to_dict() == dict(enumerate(want))
    kept = near_dup.deduplicate(documents(spark, rows), size, percent).toPandas()
    assert sorted(kept.doc_id) == sorted(set(want))


def test_crowded_region(spark):
    """Many texts between the thresholds, in one crowd: none of the links may be missed."""
    draw, text = random.Random(9), prose(77, 220).split()
    rows = []
    for i in range(260):
        copy = list(text)
        for _ in range(draw.choice([2, 6, 9])):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = near_dup.near_duplicates(documents(spark, rows, False), ["doc_id"], 3, 85).toPandas()
    want = components([t for _, t in rows], 3, 85)
    assert found.set_index("doc_id").component_id.to_dict() == dict(enumerate(want))


def test_common_passage(spark):
    """Many texts share one passage and little else; a few of them are near copies of each other."""
    draw, passage, rows = random.Random(4), prose(5, 40), []
    for i in range(220):
        rows.append((i, prose(1000 + i, 90) + " " + passage))
    for i in range(0, 60, 3):
        words = rows[i][1].split()
        words[draw.randrange(80)] = "changed"
        rows.append((len(rows), " ".join(words)))
    found = near_dup.near_duplicates(documents(spark, rows, False), ["doc_id"], 3, 85).toPandas()
    want = components([t for _, t in rows], 3, 85)
    assert found.set_index("doc_id").component_id.to_dict() == dict(enumerate(want))


def test_packages_of_one_leader_meet(spark, monkeypatch):
    """A crowd of many small packages, in regions deeper than the shortest prefix."""
    monkeypatch.setattr(near_dup, "CROWD", 2)
    monkeypatch.setattr(near_dup.P, "PACKAGE_SETS", 4)
    draw, text, rows = random.Random(8), prose(31, 200).split(), []
    for i in range(90):
        copy = list(text)
        for _ in range(draw.choice([2, 4, 6])):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = near_dup.near_duplicates(documents(spark, rows, False), ["doc_id"], 3, 85).toPandas()
    want = components([t for _, t in rows], 3, 85)
    assert found.set_index("doc_id").component_id.to_dict() == dict(enumerate(want))


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = near_dup.near_duplicates(docs, ["doc_id", "row"], 3, 85).toPandas()
    assert len(found) == len(rows) and set(found.row) == {"a"}
    by = {}
    for r in found.itertuples():
        by.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append(r)
    texts = {r[0]: r[1] for r in rows}
    for i in (1, 2, 3, 7, 8, 9, 10, 11):
        assert by[i][0].n_shingles == len(shingles(texts[i], 3))
    assert [r.component_id for i in (1, 2, 3) for r in by[i]] == [1, 1, 1, 1]
    assert [r.kept for r in by[2]] == [False, False] and by[1][0].kept
    assert (by[8][0].component_id, by[10][0].component_id) == (7, 9)
    for i in (4, 5, 6):
        assert by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept
    assert sorted(r.n_shingles == 0 for r in by[None]) == [False, True]
    kept = near_dup.deduplicate(docs, 3, 85).toPandas()
    assert list(kept.columns) == docs.columns
    assert sorted(kept.doc_id.dropna()) == [1, 4, 5, 6, 7, 9, 11, 12, 13]


def test_repeated_id_keeps_one_row(spark):
    text = prose(5, 80)
    kept = near_dup.deduplicate(documents(spark, [(3, text), (3, text), (3, text), (9, text)])).toPandas()
    assert list(kept.doc_id) == [3]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert near_dup.near_duplicates(docs, ["doc_id"]).count() == 0
    assert near_dup.deduplicate(docs).columns == docs.columns


def test_components_of_long_paths(spark):
    draw, nodes = random.Random(4), list(range(200))
    draw.shuffle(nodes)
    links = [(nodes[i], nodes[i + 1]) for i in range(199) if i != 99] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    left, right = nodes[:100], nodes[100:]
    assert found == {n: min(left) for n in left} | {n: min(right) for n in right}


def test_pairs_in_a_crowd(spark):
    """Pairs at the threshold (0.8018) whose texts all share boilerplate (0.77 across pairs)."""
    common = [f"c{i}" for i in range(178)]
    rows = []
    for i in range(150):
        own = [f"p{i}w{k}" for k in range(4)]
        rows += [(2 * i + j, " ".join([*common, *own, *(f"d{i}x{j}w{k}" for k in range(22))])) for j in range(2)]
    found = near_dup.near_duplicates(documents(spark, rows), ["doc_id"], size=5, percent=80)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert [d for d, c in got.items() if c != d - d % 2] == []


def test_links_of_a_crowd_grow_with_its_sets(spark, monkeypatch):
    """Packages that are connected inside take one link for each pair of them, not one for each set."""
    monkeypatch.setattr(near_dup.P, "PACKAGE_SETS", 8)
    met = []
    whole = near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda links: whole(met.append(links.count()) or links))
    draw, text, rows = random.Random(3), prose(52, 300).split(), []
    for i in range(96):
        copy = list(text)
        copy[draw.randrange(len(copy))] = f"w{i}"
        rows.append((i, " ".join(copy)))
    found = near_dup.near_duplicates(documents(spark, rows, False), ["doc_id"], 3, 85).toPandas()
    assert set(found.component_id) == {0}
    # About twelve packages: eleven links or so for each pair of them would be 700 and more.
    assert met[0] <= 96 + 12 * 12
