import numpy as np
import pandas as pd
import pytest
import xxhash

from pagelore.llm import simhash as S
from pagelore.llm.graph import components
from pagelore.llm.runs import join_labels


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fp, ids, distance):
    label = np.arange(len(fp))
    for i in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) + i + 1
        label = join_labels(label, np.full(len(j), i), j)
    return pd.Series(ids, dtype="Int64").groupby(label).transform("min")


def test_documents(docs, rows):
    got = S.near_duplicates(docs).toPandas()
    want = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert all(want[None if pd.isna(d) else int(d)] == int(f) % 2**64 for d, f in zip(got.doc_id, got.fp)) and len(got) == len(rows)
    want = brute_components(np.array([int(f) % 2**64 for f in got.fp], np.uint64), got.doc_id.astype("Int64").to_numpy(), 4)
    assert (got.component_id.astype("Int64").fillna(-1).to_numpy() == want.fillna(-1).to_numpy()).all()


@pytest.mark.parametrize("distance,groups,block", [(4, 3, 1 << 17), (4, 2, 16), (3, 3, 8), (4, 5, 64), (5, 2, 10)])
def test_links_find_everything(spark, distance, groups, block):
    rng = np.random.default_rng(distance * 10 + groups)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(600)]
    fp = np.unique(np.array([int(base[0 if k < 200 else rng.integers(60)]) ^ f for k, f in enumerate(flips)], np.uint64))
    reps = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64), "rep": np.arange(len(fp))}))
    found = {r.node: r.root for r in components(S.links(reps, distance, groups, block)).collect()}
    want = brute_components(fp, np.arange(len(fp)), distance)
    assert [found.get(i, i) for i in range(len(fp))] == want.tolist()


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(5, 5), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, 50)}


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0


def test_any_column_names_and_many_copies(spark):
    """A third of all rows is one text; columns are named like those that are used inside."""
    rows = [(i, "the same few words in a row of six", 1, 2, 3, 4) for i in range(2000)] + [(5000 + i, f"text {i} with words {i * 7} of its {i * 3} own", 5, 6, 7, 8) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __row int, __key int, __part int, __bands int")
    got = S.grouped(table)
    assert got.count() == 2200 and {"__row", "__key", "__part", "__bands"} <= set(got.columns)
    assert got.where("__row = 1 and __key = 2 and __part = 3 and __bands = 4").count() == 2000 and got.select("__group").distinct().count() == 201
    for share in (0.8, None):
        got = S.near_duplicates(table, share=share)
        assert got.count() == 2200 and got.where("component_id = 0").count() == 2000
