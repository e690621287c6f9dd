import zlib

from pyspark.sql import functions as F

from pagelore.llm.shard import shard_by_bytes, write_shards


def test_law_and_slots(docs, rows):
    got = shard_by_bytes(docs.withColumns({"slot": F.lit("x"), "__n": F.lit(1)}), 5).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    total, largest, sums = sum(r.size for r in got), max(r.size for r in got), {}
    for r in got:
        sums.setdefault(r.shard, []).append(r)
    assert set(sums) <= set(range(5))
    for shard in range(5):
        assert abs(sum(r.size for r in sums.get(shard, [])) - total / 5) <= 2 * largest
        assert sorted(r.slot for r in sums.get(shard, [])) == list(range(len(sums.get(shard, []))))


def test_hot_group_is_split_and_others_stay(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same text ', 10), concat('text ', id div 4, repeat(' word', 15))) as text")
    got = shard_by_bytes(docs, 12).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == 12 and max(r.s for r in got) < 1.02 * min(r.s for r in got)
    groups = shard_by_bytes(docs, 12).where("text not like 'same%'").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert groups.where("n > 1").count() <= 11


def test_native_plan(docs):
    plan = shard_by_bytes(docs, 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edges(spark, empty, docs, tmp_path):
    assert shard_by_bytes(empty).count() == 0
    assert [(r.shard, r.slot) for r in shard_by_bytes(docs.where("doc_id = 7"), 1).collect()] == [(0, 0)]
    write_shards(docs, f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()
