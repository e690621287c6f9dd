"""Shards of near-equal bytes by histogram sort. DataFrame functions only.

Rows are ordered by a 64-bit key: 40 bits of the text's hash, then 24 bits of the id's. For each of the shards' boundaries the
exact bytes below candidate keys are counted across all partitions; candidates are evenly spaced in the interval that is known
to hold the boundary, and each round narrows the interval by 12 bits, until a candidate is within the tolerance of the wanted
bytes. A round returns at most 4,096 numbers for each boundary. Then rows are exchanged once, with their text.

Equal texts are neighbours in that order, so a group of copies stays in one shard as long as ``whole`` allows the bytes; a larger
group is split between neighbouring shards by the ids' hashes.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Bits of the key after each round; the first 40 belong to the text.
LEVELS, TEXT_BITS = (12, 24, 36, 40, 52, 64), 40
ROW_BYTES = 16


def sort_key(id_col: str, text_col: str) -> Column:
    low = (1 << 64 - TEXT_BITS) - 1
    return F.xxhash64(text_col).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(id_col).bitwiseAND(F.lit(low)))


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.0005, whole: float = 0.005) -> list[int]:
    """Keys at which shards 1, 2, ... begin, from (__key, size). tolerance and whole are shares of a shard's bytes."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    found: dict[int, tuple[float, int]] = {}
    todo = {i: (None, 0) for i in range(1, shards)}  # boundary: prefix that holds it, bytes below that prefix
    for level, bits in enumerate(LEVELS):
        if not todo or not total:
            break
        prefix, rows = F.shiftright("__key", 64 - bits), keyed
        if level:
            rows = keyed.where(F.shiftright("__key", 64 - LEVELS[level - 1]).isin([p for p, _ in {todo[i][0]: 0 for i in todo}.items()]))
        bins: dict[int | None, list[tuple[int, int, bool]]] = {}
        for p, size, one in rows.groupBy(prefix.alias("p")).agg(F.sum("size"), F.min("__key") == F.max("__key")).orderBy("p").collect():
            bins.setdefault(p >> bits - LEVELS[level - 1] if level else None, []).append((p, size, one))
        for i, (parent, below) in list(todo.items()):
            want = total * i / shards
            edges = []
            for p, size, one in bins[parent]:
                edges.append((below, p, size, one))
                below += size
            k = max(0, bisect_right([e[0] for e in edges], want) - 1)
            start, p, size, one = edges[k]
            for at, edge in ((start, p), (start + size, p + 1)):
                found[i] = min(found.get(i, (float("inf"), 0)), (abs(at - want), edge << 64 - bits))
            near = tolerance if bits != TEXT_BITS else whole
            if one or found[i][0] <= near * total / shards:
                del todo[i]
            else:
                todo[i] = (p, start)
    return sorted(edge for _, edge in found.values())


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text, none for null, plus 16), text_crc32, law, shard, slot and grown_shard.

    Columns of those names are replaced. slot is gapless from 0 in each shard. Null texts are one group of equal texts; repeated
    rows get slots of their own; null ids hash like any value. Without rows there are no shards' rows. ``docs`` is read twice and has
    to give the same rows each time (so no limit without an order).
    """
    docs = docs.withColumns({
        "size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES,
        "text_crc32": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")),
        "__key": sort_key(id_col, text_col),
    })
    keyed = written(docs.select("__key", "size"))
    edges = [x for x in splitters(keyed, shards) if x < 1 << 63]
    shard = sum((F.when(F.col("__key") >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0))
    parts = max(8, keyed.count() // (shards * 50_000))
    part = F.pmod(F.shiftright(F.xxhash64("__key"), 7), F.lit(parts))  # of a shard: slots are counted in parts
    counts = keyed.groupBy(shard.alias("shard"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    ranked = docs.withColumns({"shard": shard, "__part": part}).withColumn("slot", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__key", id_col)))
    out = ranked.join(starts, ["shard", "__part"]).withColumns({"slot": F.col("__from") + F.col("slot") - 1, "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.drop("__key", "__part", "__from")


def write_shards(docs: DataFrame, path: str, shards: int = 40, **names: str) -> None:
    """One folder for each shard, rows in slot order within files."""
    shard_by_bytes(docs, shards, **names).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_shard(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
