import random
from collections import Counter

import numpy as np
import pytest
from samples import awkward, components, documents, prose, shingles

from tillcast.llm import jaccard_join as J
from tillcast.llm import packages as P


def plain(texts, size, percent):
    """n_shingles, component, class and number of linked classes of each text."""
    sets = [frozenset(shingles(t, size)) for t in texts]
    first, root = {}, components(texts, size, percent)
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    links = Counter()
    for a in first:
        for b in first:
            both = len(a & b)
            links[a] += a is not b and both and 100 * both >= percent * (len(a) + len(b) - both)
    return {i: (len(s), root[i], first[s] if s else i, int(links[s])) for i, s in enumerate(sets)}


def result(found):
    return {
        r.doc_id: (r.n_shingles, r.component_id, r.class_id, r.n_links) for r in found.toPandas().itertuples()
    }


def crowd(seed, groups, copies, changes, words=(60, 90, 200)):
    draw, out = random.Random(seed), []
    for group in range(groups):
        text = prose(1000 * seed + group, draw.choice(words)).split()
        for _ in range(draw.randint(1, copies)):
            copy = list(text)
            for _ in range(draw.randint(0, changes)):
                copy[draw.randrange(len(copy))] = f"w{draw.randrange(50)}"
            if draw.random() < 0.3:
                copy = copy[: draw.randint(len(copy) * 3 // 4, len(copy))]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size, percent", [(5, 80), (3, 60), (1, 100)])
def test_equals_all_pairs(spark, size, percent):
    texts = crowd(size, 14, 9, 4)
    found = J.jaccard_join(documents(spark, list(enumerate(texts))), ["doc_id"], size, percent)
    assert result(found) == plain(texts, size, percent)


@pytest.mark.parametrize("window_rows, id_bytes", [(0, 8), (3, 8), (1 << 20, 1)])
def test_frequent_shingles_and_clashing_numbers(spark, window_rows, id_bytes):
    """Lists that are too long for a window, and classes whose numbers clash, change nothing."""
    texts = crowd(7, 10, 6, 3, words=(50,)) + ["common words at the end of it " + prose(i, 12) for i in range(30)]
    found = J.jaccard_join(documents(spark, list(enumerate(texts))), ["doc_id"], 4, 70, window_rows, id_bytes)
    assert result(found) == plain(texts, 4, 70)


def test_crowd_in_many_packages(spark):
    """Hundreds of texts around the threshold: several packages of one leader meet."""
    draw, text = random.Random(5), prose(77, 120).split()
    texts = []
    for _ in range(420):
        copy = list(text)
        for _ in range(draw.choice([1, 2, 3])):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    found = J.jaccard_join(documents(spark, list(enumerate(texts)), False), ["doc_id"])
    want = plain(texts, 5, 80)
    assert result(found) == want and sum(w[3] for w in want.values()) > 1000


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = J.jaccard_join(docs, ["doc_id", "row", "class"]).toPandas()
    assert len(found) == len(rows) and set(found.row) == {"a"} and set(found["class"]) == {"b"}
    by = {}
    for r in found.itertuples():
        by.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append(r)
    texts = {r[0]: r[1] for r in rows}
    for i in (1, 2, 3, 7, 8, 9, 10, 11):
        assert by[i][0].n_shingles == len(shingles(texts[i], 5))
    assert [r.component_id for i in (1, 2, 3) for r in by[i]] == [1, 1, 1, 1]
    assert [r.class_id for i in (1, 2, 3) for r in by[i]] == [1, 1, 1, 3]
    assert [by[i][0].n_links for i in (1, 3, 9, 10, 11)] == [1, 1, 1, 1, 0]
    assert (by[8][0].component_id, by[10][0].component_id) == (7, 9)
    for i in (4, 5, 6):
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].n_links) == (0, i, 0)
    assert sorted(r.n_shingles == 0 for r in by[None]) == [False, True]
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_list_pairs_lose_no_link():
    """All pairs of a list that may be linked by size and position are found, each once."""
    draw = np.random.default_rng(3)
    for percent in (60, 80, 100):
        low = draw.integers(5, 60, 300)
        high = low + draw.integers(0, 3, 300)
        at = draw.integers(0, 12, 300)
        left = np.maximum(high - at - 1, 0)
        i, j = P._list_pairs(low, high, at, left, percent)
        got = set(zip(i.tolist(), j.tolist()))
        assert len(got) == len(i)
        for a in range(300):
            for b in range(a + 1, 300):
                need = -(-percent * (low[a] + low[b]) // (100 + percent))
                sizes = 100 * high[a] >= percent * low[b] and 100 * high[b] >= percent * low[a]
                fits = min(at[a], at[b]) + 1 + min(left[a], left[b]) >= need
                assert ((a, b) in got) == (sizes and fits)


def test_derived_overlaps():
    """Overlaps derived from the leaders' by differences equal those of the whole sets."""
    draw = np.random.default_rng(4)

    def package(whole, count):
        sets, rows = [], []
        for k in range(count):
            own = np.unique(np.r_[draw.permutation(whole)[: draw.integers(len(whole) // 2, len(whole) + 1)], draw.integers(0, 400, 9).astype(np.uint64)])
            sets.append(set(own.tolist()))
            added, removed = (np.array(sorted(x), np.uint64) for x in (sets[-1] - set(whole.tolist()), set(whole.tolist()) - sets[-1]))
            rows.append({"id": k, "n": len(own), "added": added.tobytes(), "removed": removed.tobytes()})
        return P._Package(whole.tobytes(), rows), sets

    for _ in range(20):
        one, two = (np.unique(draw.integers(0, 400, 120).astype(np.uint64)) for _ in "ab")
        (a, x), (b, y) = package(one, 7), package(two, 5)
        assert P._overlaps(a, b).tolist() == [[len(p & q) for q in y] for p in x]
        assert P._overlaps(a, a).tolist() == [[len(p & q) for q in x] for p in x]
