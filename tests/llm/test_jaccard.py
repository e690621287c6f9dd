import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from pagelore.llm import jaccard as J
from pagelore.llm.runs import sifted


def similarity(a, b):
    x, y = set(J.shingles(a, 5).tolist()), set(J.shingles(b, 5).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stage_against_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(2):
            n = r.randint(1, max(1, len(base) // 30))
            at = set(r.sample(range(len(base)), n))
            texts.append(" ".join(r.choice(words) if k in at else w for k, w in enumerate(base)))
    rows = list(enumerate(texts))
    group = list(range(len(rows)))
    for i, a in rows:
        for j, b in rows[:i]:
            if similarity(a, b) >= 0.8:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    out = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert len(set(group)) < 110 and sorted(x.doc_id for x in out.collect()) == sorted(set(group))
    small = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2)
    assert small.select("__group").distinct().count() == len(set(group))


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    rows = [(1, "one text of its own with some words"), (1, "quite another text under the same number"), (1, "one text of its own with some words"), (2, "ONE text of its own with some words")]
    out = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x.text.lower() for x in out) == [rows[0][1], rows[1][1]]


def test_texts_travel_once(spark, tmp_path):
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=20_000)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " and more") for i, t in enumerate(texts[:15])] + [(2000, texts[3].upper()), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    sent = lambda: sum(s.shuffleWriteBytes() for s in map(stages().apply, range(stages().size())))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    key, before = "spark.sql.autoBroadcastJoinThreshold", sent()
    spark.conf.set(key, "-1")  # as with tables that are too large for it
    try:
        C.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), "").write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset(key)
    assert sent() - before < 1.7 * sum(len(t) for _, t in rows)
    left = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0) for x in left) == [(False, 0)] + [(True, i) for i in range(150)]


def test_sifting_loses_no_row(spark):
    rows, of = spark.range(5000).withColumn("row", F.col("id") * 7919), spark.range(0, 5000, 10).select((F.col("id") * 7919).alias("row"))
    got = [x.id for x in sifted(rows, of, "row").collect()]
    assert len(got) == len(set(got)) < 1000 and set(range(0, 5000, 10)) <= set(got)
    assert set(range(0, 5000, 10)) <= {x.id for x in sifted(rows, of, "row", most=64).collect()}
    assert sifted(rows, of.where("false"), "row").isEmpty()
