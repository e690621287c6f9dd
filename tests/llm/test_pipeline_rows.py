import gc

import corpus_pipeline as C
from pagelore.llm import pack, runs, store


def test_decontamination_removes_rows_not_ids(spark, tmp_path):
    item = "seven grey herons waited beside the frozen canal before dawn"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "no id and nothing of it"), (4, f"it says: {item}"), (4, "another text under the same number"), (5, None)]
    out = C.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert {(x.doc_id, x.text) for x in out} == {rows[1], rows[3], rows[4]}


def test_empty_tables(spark, empty, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert C.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_tables_of_earlier_stages_go(spark, docs, tmp_path):
    from pagelore.llm import store

    docs.write.parquet(f"{tmp_path}/a")
    C.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/a"), "").write.parquet(f"{tmp_path}/b")
    own = store._staged[store.folder(spark)][:]
    with store.stage(spark.read.parquet(own[0])):
        assert store._staged[store.folder(spark)] == own[:1]  # what the input reads stays
    with store.stage(spark.read.parquet(f"{tmp_path}/b")):
        assert store.folder(spark) not in store._staged


def test_workers_drop_what_packing_keeps(spark, docs):
    """A worker that packed serves other stages without the tokenizer and its parts."""

    def held():
        return lambda texts: [[sum(isinstance(x, pack.Chunks) for x in gc.get_objects())] * len(list(texts))]

    pack.token_pieces(docs.repartition(16)).count()
    assert {r.held for r in runs.with_columns(docs.repartition(16), "text", held, "held long").select("held").collect()} == {0}


def test_workers_keep_the_tokenizer_from_task_to_task():
    class Rows:
        mapInArrow = staticmethod(lambda task, schema: task)

    seen = []
    task = lambda keep: list(runs.in_arrow(Rows, lambda b: seen.append(dict(runs.worker_keeps())) or b, "", keep)([]))
    runs.worker_keeps().update(a=1, b=2)
    for keep in ("a", "a", None):
        task(keep)
    assert seen == [{"a": 1}, {"a": 1}, {}]


def test_batches_of_long_texts_are_small(spark):
    """40 texts of 200 KB come in batches of about 2 MB, and each is whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 40000 + cast(id as int)) as text")

    def make():
        def compute(texts):
            sizes = list(map(len, texts))
            return [sizes, [len(sizes)] * len(sizes)]

        return compute

    try:
        spark.conf.set(key, "67108864b")
        with store.stage(docs.where("false")):
            out = runs.with_columns(docs, "text", make, "size long, n long").select("doc_id", "size", "n").collect()
        assert [(r.doc_id, r.size) for r in out] == [(i, 5 * (40000 + i)) for i in range(40)] and max(r.n for r in out) <= 12
        spark.conf.set(key, "7m")
        with store.stage(docs.where("false")):
            assert spark.conf.get(key) == "7m"
    finally:
        spark.conf.set(key, before)
