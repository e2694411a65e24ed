import pytest
from samples import awkward, documents, prose, table

from tillcast.llm import decontaminate


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def flagged(found):
    return {r.doc_id: sorted({o.item_id for o in r.overlaps}) for r in found.collect()}


@pytest.fixture(scope="module")
def benchmark_texts():
    return [prose(500 + i, 14 + 3 * i, 2000) for i in range(10)]


def test_finds_exact_changed_and_cut_passages(spark, benchmark_texts):
    draw = prose(1, 100, 2000)

    def around(text):
        return f"{draw} {text} {prose(2, 50, 2000)}"

    changed = [t.split() for t in benchmark_texts]
    for t in changed:
        t[len(t) // 2] = "changed"
        if len(t) > 20:
            t[3] = "new"
    rows = [(i, around(t)) for i, t in enumerate(benchmark_texts)]
    rows += [(100 + i, around(" ".join(t).upper())) for i, t in enumerate(changed)]
    rows += [(200, around(" ".join(benchmark_texts[9].split()[8:30]))), (300, draw), (301, prose(3, 500, 2000))]
    found = flagged(decontaminate.find(documents(spark, rows), items(spark, benchmark_texts)))
    assert found == {
        **{i: [i] for i in range(10)}, **{100 + i: [i] for i in range(10)}, 200: [9], 300: [], 301: [],
    }


def test_equals_plain_search_on_the_table(spark):
    from samples import SMALL

    docs, bench = table("documents"), table("benchmark")
    found = flagged(
        decontaminate.find(
            spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
        )
    )
    for doc_id, text in zip(docs.doc_id, docs.text):
        plain = " ".join(text.split())
        exact = [i for i, t in zip(bench.item_id, bench.text) if " ".join(t.split()) in plain]
        assert set(exact) <= set(found[doc_id])
        if not exact:
            # What else is found shares a long stretch, word by word.
            for i in found[doc_id]:
                assert longest_common(plain, bench.text[bench.item_id == i].iloc[0]) >= 3


def longest_common(a, b):
    a, b = a.lower().split(), b.lower().split()
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == b[j] else 0 for j in range(len(b))]
        best = max(best, *row)
    return best


def test_blocks_give_the_same(spark, benchmark_texts):
    rows = [(i, prose(9, 60) + " " + t) for i, t in enumerate(benchmark_texts)]
    docs = documents(spark, rows)
    one = flagged(decontaminate.find(docs, items(spark, benchmark_texts)))
    many = flagged(decontaminate.find(docs, items(spark, benchmark_texts), block_words=40))
    assert one == many and one[3] == [3]


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows).withColumnRenamed("mix", "overlaps")
    bench = items(spark, [rows[0][1], None, "", "too short", rows[0][1]])
    found = decontaminate.find(docs, bench).collect()
    assert len(found) == len(rows)
    texts = {r.text for r in found if {o.item_id for o in r.overlaps} == {0, 4}}
    assert texts == {rows[0][1], rows[3][1]}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert {r.overlaps for r in kept.collect()} == {"g"}
    assert decontaminate.clean(documents(spark, []), bench).count() == 0
    assert decontaminate.clean(docs, items(spark, []).limit(0)).count() == len(rows)


def test_changed_words_wherever_they_stand():
    """Every way to change as many words as the rule allows, in items of 6 to 16 words."""
    from itertools import combinations

    memory = decontaminate._memory()
    around = [f"a{i}" for i in range(20)]
    for n in range(6, 17):
        item = [f"w{i}" for i in range(n)]
        index = decontaminate.Index([(1, decontaminate._plain(" ".join(item).encode(), memory))])
        for changed in combinations(range(n), n - decontaminate._needed(n)):
            words = [f"x{i}" if i in changed else w for i, w in enumerate(item)]
            text = " ".join([*around, *words, *around]).encode()
            found = index.verified(decontaminate._plain(text, memory))
            assert found and max(x[3] for x in found) == n - len(changed), (n, changed)
