import corpus_pipeline as C
from pagelore.llm import decontaminate, language, pii, simhash


def test_each_stage_on_its_own_input(spark, tmp_path):
    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = docs.toPandas(), out.toPandas()
        if name != "packing":
            assert out.columns == columns
        if name == "language_id":
            found = language.identify(docs, language.learned(docs)).where("not rejected").toPandas()
            assert set(after.doc_id) == set(found.doc_id)
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs).toPandas().groupby("component_id").doc_id.min()
            assert sorted(after.doc_id) == sorted(groups)
        if name == "decontamination":
            items = [decontaminate.words_of(t) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
            holds = lambda t: any(f" {' '.join(i)} " in f" {' '.join(decontaminate.words_of(t))} " for i in items)
            assert {d for d, t in zip(before.doc_id, before.text) if not holds(t)} == set(after.doc_id)
        if name == "personal_data":
            assert set(after.doc_id) == set(before.doc_id)
            old, new = dict(zip(before.doc_id, before.text)), dict(zip(after.doc_id, after.text))
            assert all((old[d] == new[d]) == (not pii.base_spans(old[d])) for d in old) and not any(pii.base_spans(t) for t in new.values())
            assert (after.n_chars == after.text.map(len)).all()
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id) and after.groupby("sequence_id").length.sum().max() <= 2048
        kept[name], docs = len(after), out
    assert kept["language_id"] > 0.95 * 200 and kept["near_duplicates"] < kept["language_id"]


def test_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, "an item that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = C.run(spark, str(tmp_path)).toPandas()
    assert 300 not in set(out.doc_id) and 5 in set(out.doc_id) and 210 not in set(out.doc_id)
    assert out.groupby(["doc_id", "piece"], dropna=False).size().max() == 1
