from pyspark.sql import functions as F

from pagelore.llm import language as L


def test_predictions(docs, rows):
    model = L.learned(docs)
    got = L.identify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    known = [r for r in got if r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known)


def test_rejection_by_distance(spark, docs):
    model = L.learned(docs)
    got = L.identify(spark.createDataFrame([(1, "これは日本語の文章です。とても遠い。"), (2, "the stone house of the river")], "doc_id long, text string"), model)
    assert {r.doc_id: r.rejected for r in got.collect()} == {1: True, 2: False}


def test_long_text_in_blocks(monkeypatch):
    text = "the quick brown fox " * 500
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "BLOCK", 64)
    assert (L.ngram_counts(text) == whole).all()


def test_nothing_learned(docs, empty):
    assert L.learned(empty).langs == []
    assert {r.lang_pred for r in L.identify(docs, L.learned(empty)).collect()} == {"und"}
    assert L.identify(empty, L.learned(docs)).count() == 0


def test_held_out_is_never_learned(docs):
    kept = docs.where(~L.held_out()).where("doc_id is not null")
    assert kept.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).count() == 0


def test_a_language_of_copies_is_learned(spark, docs):
    """Most rows of a language are copies of one text; it is in the model all the same, and the sample stays small."""
    copies = spark.range(3000).selectExpr("id + 10000 as doc_id", "'kala vesi puu talo ilta' as text", "'fi' as lang", "'s' as source", "cast(null as long) as n_chars")
    model = L.learned(docs.union(copies))
    assert set(model.langs) == {"de", "en", "fi"} and model.langs.count("fi") == 1
    got = L.identify(spark.createDataFrame([(1, "kala vesi puu"), (1, "kala vesi puu"), (2, "the stone house")], "doc_id long, text string"), model).collect()
    assert sorted((x.doc_id, x.lang_pred) for x in got) == [(1, "fi"), (1, "fi"), (2, "en")]
