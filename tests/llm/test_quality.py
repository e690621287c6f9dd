from pyspark.sql import functions as F

from pagelore.llm.quality import classify


def made(spark, docs):
    bad = spark.range(60).selectExpr("id + 5000 as doc_id", "repeat(concat('BUY NOW!!! ', id % 3, ' '), 20) as text", "'en' as lang", "if(id < 50, 's8', null) as source", "cast(null as long) n_chars")
    return docs.union(bad)


def test_quality(spark, docs):
    every = made(spark, docs)
    labels = every.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(5000, 0), (77777, 1), (None, 1), (4, None)], "doc_id long, quality int"))
    got = classify(every, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == every.count()
    for r in got:
        assert 0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5)
    real = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and not 300 <= r.doc_id < 310]
    assert sum(r.keep for r in real) >= 0.97 * len(real)
    assert not any(r.keep for r in got if r.doc_id and r.doc_id >= 5000)
    hosts = {r.host: r.host_posterior for r in got}
    assert hosts["s8"] < 0.5 < hosts["s1"] and "" in hosts


def test_no_labels_and_no_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.quality, r.keep) for r in classify(docs, none, F.col("source"), F.lit(None)).select(F.round("quality", 6).alias("quality"), "keep").collect()} == {(0.5, True)}
    assert classify(empty, none, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "plain words of a text", f"h{i % 10}") for i in range(1000)] + [(2000, "plain words of a text", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 10 > 1)) for i in range(1000)] + [(2000, 0)], "doc_id long, quality int")
    got = {r.host: r.host_posterior for r in classify(docs, labels, F.col("source"), F.lit("")).select("host", "host_posterior").distinct().collect()}
    assert got["h0"] < 0.1 and got["h5"] > 0.9 and got["h0"] + 0.1 < got["lone"] < 0.8


def auc(pairs):
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_held_out_documents(spark):
    """Labels of half the documents rank the other half; sites add to the text's evidence, and digits are seen."""
    import random

    r = random.Random(4)
    words = "the river and old stone house by a light winter morning in market".split()
    rows, truth = [], {}
    for i in range(800):
        host = i % 20
        good = r.random() < (0.9 if host < 10 else 0.2)
        noise = 0.02 if good else r.choice((0.03, 0.3))
        text = " ".join(str(r.randint(0, 9999)) if r.random() < noise else r.choice(words) for _ in range(60))
        rows.append((i, text, f"h{host}", "x"))
        truth[i] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, evidence string")
    known = [(i, y) for i, y in truth.items() if i // 20 % 2]
    got = classify(docs, spark.createDataFrame(known, "doc_id long, quality int"), F.col("host"), F.col("evidence")).collect()
    unseen = [x for x in got if x.doc_id // 20 % 2 == 0]
    text_alone, whole = (auc([(x[c], truth[x.doc_id]) for x in unseen]) for c in ("evidence", "quality"))
    assert text_alone > 0.65 and whole > 0.85 and whole > text_alone


def test_own_label_is_left_out(spark):
    """Two alike documents of sites of their own: what one's label is doesn't move its own quality."""
    rows = [(i, "plain words of a text", f"h{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {round(x.quality, 9) for x in classify(docs, labels, F.col("host"), F.lit("")).collect()}
    assert len(got) == 1


def test_ties_long_texts_and_repeated_rows(spark):
    rows = [(1, "word " * 200_000, "a")] * 2 + [(None, None, None)] * 3
    got = classify(spark.createDataFrame(rows, "doc_id long, text string, host string"), spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int"), F.col("host"), F.col("host")).collect()
    assert len(got) == 5 and all(0 <= x.quality <= 1 for x in got)
