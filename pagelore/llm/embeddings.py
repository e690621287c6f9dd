"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to unit length, so that cosine and Euclidean distance say the same. Each of ``tables`` hash tables quantises
``hashes`` Gaussian projections with cells of width ``width``; vectors of one label that agree on a whole table meet in a bucket,
where exact cosines in double precision decide. At a cosine of 0.98 (distance 0.2) a pair meets in a table with probability 0.32,
so 16 tables miss it with probability 0.002; closer pairs are missed less. A pair counts in the first table where it meets.

Equal vectors are one row with a count from the start. Names of buckets travel first, without vectors; a vector is then sent only to
those of its buckets that hold another one, and names are computed again there. Buckets are compared where they lie; each gives its
members' link counts and a spanning forest, not its pairs, and a bucket of over ``block`` vectors is compared in pairs of blocks on
many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .runs import join_labels, pairs, read, split_runs, spread_join, whole_runs
from .store import written


def _unit(vs: list[np.ndarray]) -> np.ndarray:
    x = np.array(vs, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _buckets(x: np.ndarray, label: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket name for each vector (of one dimension) and table, the same wherever it is computed: coordinates are whole
    multiples of 2^-20 and projections of 2^-10, whose sums of products are exact in any order."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = np.rint(rng.standard_normal((x.shape[1], tables * hashes)) * 2**10)
    b = rng.uniform(0, width, tables * hashes)
    cell = np.floor((np.rint(x * 2**20) @ a * 2.0**-30 + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, hashes)
    odd = rng.integers(0, 1 << 63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    name = (cell * odd).sum(axis=2, dtype=np.uint64) + label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    name ^= name >> np.uint64(29)
    return (name * np.uint64(0xBF58476D1CE4E5B9) ^ rng.integers(0, 1 << 63, tables, dtype=np.uint64)).view(np.int64)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, tables: int = 16, hashes: int = 10, width: float = 1.5, block: int = 4096, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links: other rows linked directly; component_id: the smallest id reachable; kept: it is the row's own. A row links with
    nothing if its id, label or vector is null, or the vector is empty, zero, or holds a null or non-finite component. Vectors of
    different dimensions don't link. Rows that repeat, id and all, link with each other like any two equal vectors. An id is to name
    one vector; those of a smallest id that names several are counted together. Other columns are ignored; an empty table gives no
    rows. At most 62 tables.
    """
    kind = vectors.schema[vector_col].dataType.elementType
    stored = np.dtype("<f4" if isinstance(kind, T.FloatType) else "<f8")
    of_vector = F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if stored.itemsize == 4 else "array<double>").alias("v"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), of_vector.alias("g"))
    finite = F.forall("g.v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("g.label").isNotNull() & finite & F.exists("g.v", lambda x: x != 0), F.lit(False))
    groups = written(rows.where(good).groupBy("g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))

    def by_dimension(vs: list[np.ndarray]) -> Iterator[np.ndarray]:
        size = np.array([len(v) for v in vs])
        return (np.flatnonzero(size == d) for d in np.unique(size))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, label = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vs = [np.asarray(x.values, stored) for x in b.column(2)]
            for at in by_dimension(vs):
                names = _buckets(_unit([vs[i] for i in at]), label[at], tables, hashes, width, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.ascontiguousarray(names[:, t]), np.full(len(at), t, np.int32), rep[at])], names=["bucket", "t", "rep"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, n, label, mask = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            vs = [np.asarray(x.values, stored) for x in b.column(3)]
            for at in by_dimension(vs):
                names, data = _buckets(_unit([vs[i] for i in at]), label[at], tables, hashes, width, seed), [vs[i].tobytes() for i in at]
                for t in range(tables):
                    here = np.flatnonzero(mask[at] >> t & 1)
                    columns = (np.ascontiguousarray(names[here, t]), np.full(len(here), t, np.int32), rep[at[here]], n[at[here]], label[at[here]], pa.array([data[i] for i in here], pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "t", "rep", "w", "label", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "run"):
            run, t, rep, w, label, side = (part.column(k).to_numpy() for k in ("run", "t", "rep", "w", "label", "side"))
            vs = [np.frombuffer(v, stored) for v in part.column("v").to_pylist()]
            size, names = np.array([len(v) for v in vs]), np.zeros((len(run), tables), np.int64)
            for at in by_dimension(vs):
                names[at] = _buckets(_unit([vs[i] for i in at]), label[at], tables, hashes, width, seed)
            flat, begin = np.concatenate(vs), np.cumsum(size) - size
            root, n = np.arange(len(run)), np.zeros(len(run), np.int64)
            for i, j in pairs(run, np.ones(len(run), bool), 1 << 14):
                ok = (label[i] == label[j]) & (size[i] == size[j]) & ((side[i] == 0) | (side[i] != side[j])) & (t[i] == t[j])
                i, j = i[ok], j[ok]
                first = (names[i] == names[j]).argmax(axis=1) == t[i]
                i, j = i[first], j[first]
                for d in np.unique(size[i]).tolist():
                    own = size[i] == d
                    a, b = i[own], j[own]
                    x, y = (flat[begin[k][:, None] + np.arange(d)].astype(np.float64) for k in (a, b))
                    near = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine
                    a, b = a[near], b[near]
                    np.add.at(n, a, w[b])
                    np.add.at(n, b, w[a])
                    root = join_labels(root, a, b)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root[at]]), pa.array(n[at])], names=["a", "b", "n"])

    names = written(groups.select("rep", "g.label", "g.v").mapInArrow(named, "bucket long, t int, rep long"))
    shared = written(names.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    masks = spread_join(names, shared, "bucket").groupBy("rep").agg(F.expr("bit_or(shiftleft(1L, t))").alias("mask"))
    dealt = groups.join(masks, "rep").select("rep", "n", "g.label", "g.v", "mask").mapInArrow(deal, "bucket long, t int, rep long, w long, label long, v binary")
    runs = split_runs(dealt, "bucket", "rep", block, shared).drop("bucket")
    found = written(runs.repartition("run").sortWithinPartitions("run").mapInArrow(verify, "a long, b long, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("links"))
    of = groups.join(counts, groups.rep == counts.a, "left").join(components(found), F.col("rep") == F.col("node"), "left")
    of = written(of.select("g", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = spread_join(rows.where(good), of, "g").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Exact: all pairs of a label. For small tables.
SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
