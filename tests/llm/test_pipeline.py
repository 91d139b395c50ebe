"""Each stage on its own input, against plain versions."""

import corpus_pipeline as pipeline
from helpers import DATA
from test_pairs import brute_components, brute_hits


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = pipeline.stored(stage(spark, docs, DATA), name)
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == docs.columns and out.count() == len(after) and set(after) <= set(before)
        if name == "near_dedup":
            assert set(after) == {int(i) for i, _, c, _ in brute_components(list(before.items())) if i == c}
        elif name == "decontaminate":
            assert set(after) == {i for i, t in before.items() if not brute_hits(t, items)[1]}
        elif name == "pii":
            assert set(after) == set(before) and not any("@mail" in (t or "") for t in after.values())
        else:
            assert 0.5 < len(after) / len(before) < 1
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert sorted(map(str, pipeline.run(spark, DATA).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted({str(x) for x in map(lambda r: type(r)(doc_id=r.doc_id, doc_tokens=r.doc_tokens), packed)})


def test_repeated_ids_prefer_a_text(spark):
    df = spark.createDataFrame([(7, None), (7, "a real article"), (8, ""), (8, "another article altogether"), (9, None), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, pipeline.near_dedup_stage(spark, df, DATA).collect())) == [(7, "a real article"), (8, "another article altogether"), (9, None)]


def test_different_texts_of_one_id_stay(spark):
    one, two = ("".join(f"{w}{k} " for k in range(60)) for w in ("stone", "river"))
    near = one.replace("stone30 ", "stone30 changed ")
    rows = [(7, one), (7, two), (3, near), (9, two), (9, two), (9, "a text of its own, quite short"), (5, one), (5, near), (6, ""), (6, None), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.near_dedup_stage(spark, df, DATA).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(3, near), (7, two), (9, "a text of its own, quite short"), (6, ""), (0, one)])


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= docs.count()
    kept = pipeline.near_dedup_stage(spark, odd, DATA).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 5, 6, 7, 7, 8, 10, 11, 12, 13, 14, 15] and sum(r.doc_id is None for r in kept) == 2
    assert pipeline.decontaminate_stage(spark, odd, DATA).count() == odd.count()
    assert pipeline.packing_stage(spark, none, DATA).count() == 0


def test_any_other_column_passes_every_stage(spark):
    text = "Some words of a plain text, and mail a@b.org, that no rule of any stage could drop. " * 3
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text)], "doc_id long, text string")
    others = ["map('k', doc_id) AS w", "array(map(1, 2)) AS prior", "7 AS _key", "8 AS key", "9 AS row", "10 AS `a.b`", "11 AS _row", "12 AS n", "13 AS kept", "14 AS spans", "15 AS score", "16 AS declared", "'x' AS n_chars", "1 AS b", "2 AS salt"]
    df = df.selectExpr("*", *others)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert all(r["a.b"] == 10 and r.key == 8 and r.n == 12 for r in rows), name
        assert len(rows) == (3 if name == "near_dedup" else len(rows)), name
    assert pipeline.packing_stage(spark, df, DATA).where("start = 0").count() == 4
