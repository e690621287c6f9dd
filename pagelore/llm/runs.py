"""Helpers for Python stages over rows that are hash-partitioned and sorted by a key."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .store import small_batches, written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one in fewer splits than there are cores (a small file is often one row group) is dealt over all of them. Its rows are the same either way."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def worker_keeps() -> dict:
    """What the Python worker keeps from task to task, by name."""
    return sys.modules.setdefault("_pagelore_kept", types.ModuleType("_pagelore_kept")).__dict__.setdefault("own", {})


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keep: str | None = None) -> DataFrame:
    """``df.mapInArrow``, in workers that hold no more than the task needs: a worker serves many tasks of all stages, and what one leaves would stay in memory for the others.

    Before the task, all that ``worker_keeps`` goes but what has the name ``keep``; after it, memory that is free goes back to the system.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in worker_keeps().keys() - {keep}:
            del worker_keeps()[name]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(task, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows again, in tables that never cut a run of equal keys; a run that goes past its batch is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(k, k[-1]))
        if at == 0 and held and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at)]
        if sum(x.num_rows for x in done):
            yield pa.Table.from_batches(done)
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def pairs(key: np.ndarray, left: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal (sorted) keys with left[i], at most about ``most`` at a time."""
    n = len(key)
    ends = np.searchsorted(key, key, side="right")
    at = np.flatnonzero(left & (ends > np.arange(n) + 1))
    counts = ends[at] - at - 1
    total = np.cumsum(counts)
    lo = 0
    while lo < len(at):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, side="right")))
        c = counts[lo:hi]
        i = np.repeat(at[lo:hi], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield i, j
        lo = hi


def split_runs(rows: DataFrame, key: str, by: str, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``run`` and ``side``, so that no run has many more than twice ``block`` rows and each pair of a key meets once.

    A key with more rows is dealt into blocks by a hash of ``by``; each pair of blocks is a run of its own. side 0: compare with
    all of the run; 1 and 2: compare with the other side only. ``sizes``: rows n of each key, if they are known.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    hot = written(sizes.where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias("__parts")))
    if hot.isEmpty():
        return rows.withColumns({"run": F.col(key), "side": F.lit(0)})
    parts = F.coalesce("__parts", F.lit(1))
    own = F.pmod(F.xxhash64(by, F.lit("block")), parts).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    run = F.when(F.col("__parts").isNull(), F.col(key)).otherwise(F.xxhash64(key, low, high))
    side = F.when(low == high, 0).when(F.col("__own") == low, 1).otherwise(2)
    return dealt.withColumns({"run": run, "side": side}).drop("__parts", "__own", "__other")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with so many underscores before them that no column begins like that."""
    lead = "_" * (1 + max(map(len, columns), default=0))
    return [lead + n for n in names]


def spread_join(rows: DataFrame, of: DataFrame, key: str, how: str = "inner", block: int = 256, hot_keys: int = 4096) -> DataFrame:
    """``rows`` joined to ``of`` by ``key``, without its column ``n``: how many rows (about) have each key; keys are unique there.

    A key with more rows than ``block``, or than a ``hot_keys``-th of all, is dealt over tasks, its row of ``of`` to each. There
    are fewer such keys than ``hot_keys``, so their list is broadcast whatever the size of the tables. Rows are dealt by their place in
    ``rows``, so that has to be a table (or narrow steps on one): a task that is run again deals them the same way.
    """
    total, most = (x or 0 for x in of.agg(F.sum("n"), F.max("n")).first())
    block = max(block, total // hot_keys)
    if most <= block:
        return rows.join(of.drop("n"), key, how)
    place, name, count, part = fresh([*rows.columns, *of.columns], "place", "key", "parts", "part")
    hot = F.broadcast(written(of.where(F.col("n") > block).select(F.col(key).alias(name), F.ceil(F.col("n") / block).cast("int").alias(count))))
    parts, same = F.coalesce(count, F.lit(1)), F.col(key).eqNullSafe(F.col(name))
    left = rows.withColumn(place, F.monotonically_increasing_id()).join(hot, same, "left")
    left = left.withColumn(part, F.pmod(F.xxhash64(place, F.lit("part")), parts).cast("int")).drop(name, count, place)
    right = of.drop("n").join(hot, same, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop(name, count)
    return left.join(right, [key, part], how).drop(part)


def sifted(rows: DataFrame, of: DataFrame, key: str, most: int = 1 << 26) -> DataFrame:
    """The rows whose ``key`` is in ``of``, and by chance a few others: what an exact join with ``of`` would drop stays where it lies.

    A bitmap of the keys' hashes, 16 bits a key and ``most`` bits at most, is broadcast; beyond that more others pass, but none is lost.
    ``of`` has to be a table.
    """
    bits = max(1 << 15, min(most, 1 << (16 * of.count() - 1).bit_length()))
    place, bucket, bitmap = fresh([*rows.columns, *of.columns], "place", "bucket", "bitmap")
    hashed = F.pmod(F.xxhash64(key, F.lit("sifted")), F.lit(bits)) + 1  # Spark's bitmaps count from 1
    number, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = of.select(hashed.alias(place)).groupBy(number.alias(bucket)).agg(F.bitmap_construct_agg(at).alias(bitmap))
    out = rows.withColumn(place, hashed).withColumn(bucket, number).join(F.broadcast(maps), bucket)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(rows.columns)


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of linked indices: each index's label is the smallest index of its set. ``label`` holds such labels already."""
    while True:
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            return label
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def texts(column: pa.Array) -> Iterator[str | None]:
    """A column's strings one by one, so that only one long text at a time is held twice."""
    return (x.as_py() for x in column)


def with_columns(docs: DataFrame, text_col: str, make: Callable[[], Callable[[Iterator[str | None]], list[pa.Array]]], new: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and the columns that ``make()`` computes from the texts of a batch. ``new`` is their schema.

    ``make`` is called once in each task. Kept columns with the name of a new one give way to it.
    """
    added = T.StructType.fromDDL(new)
    fields = [f for f in docs.schema if f.name not in added.names and (keep is None or f.name in keep)]
    names = [*(f.name for f in fields), *added.names]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            made = compute(texts(b.column(len(fields))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), *(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds))], names=names)

    into = docs.select(*(F.col(f"`{f.name}`") for f in fields), F.col(text_col).cast("string").alias("__text"))
    return in_arrow(into, run, T.StructType([*fields, *added]))
