import pytest
from samples import awkward, documents, prose

from tillcast.llm import sharding


def check(found, shards):
    sizes = found.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 2 * found["size"].max()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sizes_are_near_equal_and_slots_gapless(spark, shards):
    rows = [(i, prose(i, 5 + i * 7 % 90)) for i in range(400)]
    found = sharding.shard(documents(spark, rows), shards, ranges_per_shard=4).toPandas()
    assert sorted(found.doc_id) == list(range(400))
    assert (found["size"] == [len(t.encode()) + 1 for t in found.text]).all()
    check(found, shards)


def test_one_text_with_most_rows_is_divided(spark):
    rows = [(i, "the same text") for i in range(600)] + [(1000 + i, prose(i, 9)) for i in range(200)]
    found = sharding.shard(documents(spark, rows), 8, ranges_per_shard=4).toPandas()
    check(found, 8)
    assert found[found.text == "the same text"].shard.nunique() >= 3


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = sharding.shard(docs, 2).toPandas()
    assert len(found) == len(rows) and list(found.columns) == [
        c for c in docs.columns if c not in ("size", "shard")
    ] + ["size", "shard", "slot"]
    assert set(found[found.text.isna()]["size"]) == {1}
    check(found, 2)


def test_empty_table(spark):
    assert sharding.shard(documents(spark, [])).count() == 0


def test_repeatable(spark):
    rows = [(i, prose(i, 30)) for i in range(100)] * 2
    one = sharding.shard(documents(spark, rows).repartition(3), 4).toPandas()
    two = sharding.shard(documents(spark, rows).repartition(7), 4).toPandas()
    key = ["shard", "slot"]
    assert one.sort_values(key).doc_id.tolist() == two.sort_values(key).doc_id.tolist()
