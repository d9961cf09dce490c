import corpus_pipeline as cp
from pagetext.llm import quality

from .helpers import frame, odd_documents, prose


def tables(spark, tmp_path, docs, labels, items):
    for name, df in (("documents", frame(spark, docs, clashing=("shard_no",))), ("labels", frame(spark, labels, "doc_id long, quality int, toxic int")),
                     ("benchmark", frame(spark, items, "item_id long, text string"))):
        df.repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_stages_apply_their_decisions(spark, tmp_path):
    import random
    rng = random.Random(3)
    docs = odd_documents()
    item = prose(rng, 30)
    docs += [(500 + i, prose(rng, 40) + " " + item, "en", "hot", 0) for i in range(3)]
    docs += [(600 + i, "$$$ %%% " * 50 + f"j{i} " * 20, "en", "hot", 0) for i in range(10)]
    labels = [(i, 1, 0) for i in (*range(60), *range(100, 110), *range(200, 213))] + [(600 + i, 0, 0) for i in range(10)]
    sf = tables(spark, tmp_path, docs, labels, [(1, item)])
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    now, ids = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        ids.append([r["doc_id"] for r in now.collect()])
    assert not any(i in ids[0] for i in range(600, 610))
    assert set(range(60)) <= set(ids[0])
    assert [i for i in ids[1] if i is not None and 200 <= i <= 212] == [200] and not any(i in ids[1] for i in range(100, 110))
    assert ids[1].count(307) == 1 and set(ids[2]) == set(ids[1]) - {500, 501, 502}
    assert sorted(map(str, ids[4])) == sorted(map(str, ids[3]))
    whole = cp.run(spark, sf)
    assert sorted(map(str, (r["doc_id"] for r in whole.collect()))) == sorted(map(str, ids[4]))


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [], [])
    assert cp.run(spark, sf).count() == 0


def test_quality_bound_is_a_parameter():
    assert quality.LABELLED == 20_000
