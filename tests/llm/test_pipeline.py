import corpus_pipeline
from samples import SMALL, awkward, components, documents, prose, table

from tillcast.session import materialise


def test_stages_and_run(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids, columns = [set(table("documents").doc_id)], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL))
        if name != "sharding":
            assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and docs.count() == len(ids[-1])
    assert ids[1] > ids[2] and ids[4] == ids[5]
    # Near duplicates: one document of each component of what the rules kept.
    kept = table("documents").query("doc_id in @ids[1]").sort_values("doc_id")
    roots = components(list(kept.text), 5, 80)
    assert ids[2] == {list(kept.doc_id)[i] for i in set(roots)}
    # Benchmark passages that stand whole in a text are gone.
    bench = [" ".join(t.split()) for t in table("benchmark").text]
    texts = dict(zip(kept.doc_id, (" ".join(t.split()) for t in kept.text)))
    dirty = {d for d in ids[2] if any(b in texts[d] for b in bench)}
    assert ids[3] == ids[2] - dirty
    ran = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(ran.doc_id) == ids[5] and set(ran.shard) <= set(range(8))


def test_stages_take_awkward_rows(spark):
    docs = documents(spark, [*awkward(), *[(100 + i, prose(i, 60)) for i in range(30)]])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL))
        assert sorted(docs.columns) == sorted(columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
