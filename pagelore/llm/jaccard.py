"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Texts with one set of shingles are one node. Candidates are the components of SimHash fingerprints (``fingerprints.links``) and,
for pairs with more differing bits, ``BANDS`` MinHash bands of ``ROWS`` values each: at a similarity of 0.8 a pair shares no band
with probability 3e-6. Of buckets with the same members one is kept; in it, the exact similarity decides. Each bucket gives a
spanning forest of its links, and one of over ``block`` sets is compared in pairs of blocks.

Texts don't travel to be compared: the candidates' shingles are made where the texts lie (``runs.sifted``), and all else works on rows of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import fingerprint, links, shingle_hashes
from .graph import components
from .runs import fresh, in_arrow, join_labels, sifted, split_runs, spread_join, whole_runs, with_columns
from .store import dropped, written, written_alone

BANDS, ROWS = 24, 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    return np.unique(shingle_hashes(text or "", size))


def bands(x: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name for each band."""
    least = np.min([(x[at : at + 4096, None] * odd).min(axis=0) for at in range(0, len(x), 4096)], axis=0).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)], np.uint64).view(np.int64)


def near_duplicates(docs: DataFrame, text_col: str = "text", size: int = 5, share: float = 0.8, block: int = 512, fingerprint_size: int = 4, distance: int = 4, groups: int = 7) -> DataFrame:
    """``docs`` with fp, the SimHash fingerprint, __set, which equal sets of shingles share, and __group: the smallest __set reachable over pairs with a Jaccard similarity of ``share`` or more.

    Columns of those names are replaced. Texts without words, null ones too, are one set that links with nothing else. Repeated rows
    stay; ids play no part; an empty table gives no rows.
    """
    marked, of, row = _marked(docs, text_col, size, share, block, fingerprint_size, distance, groups)
    return spread_join(marked.drop(row), of, "__set")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``near_duplicates`` one with the smallest id, and all with a null id. Only the rows' numbers are grouped; texts travel once, to those that stay."""
    marked, of, row = _marked(docs, text_col)
    name = fresh([*marked.columns, *of.columns], "id")[0]
    numbered = written(spread_join(marked.select(row, F.col(id_col).alias(name), "__set"), of, "__set").drop("__set"))
    known = F.col(name).isNotNull()
    least = numbered.where(known).groupBy("__group").agg(F.min(F.struct(name, row)).alias(name)).select(f"`{name}`.`{row}`")
    stay = written_alone(least.union(numbered.where(~known).select(row)))
    dropped(numbered, of)
    return marked.join(stay, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def _marked(docs: DataFrame, text_col: str, size: int = 5, share: float = 0.8, block: int = 512, fingerprint_size: int = 4, distance: int = 4, groups: int = 7) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` with fp, __set and a number for each row, as a table; __set, __group and n, the rows of each set; the name of the rows' number."""

    def make():
        odd = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def compute(texts: Iterator[str | None]) -> list[pa.Array]:
            names, fps, buckets = [], [], []
            for t in texts:
                x = shingles(t, size)
                names.append(xxhash.xxh64_intdigest(x.tobytes()) if len(x) else 0)
                fps.append(fingerprint(shingle_hashes(t or "", fingerprint_size)))
                buckets.append(bands(x, odd) if len(x) else [])
            return [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(buckets, pa.list_(pa.int64()))]

        return compute

    in_bands, row = fresh(docs.columns, "bands", "row")
    marked = written(with_columns(docs, text_col, make, f"__set long, fp long, `{in_bands}` array<long>").withColumn(row, F.monotonically_increasing_id()))
    # of equal sets one row, the first, stands for all
    some = marked.where(F.size(in_bands) > 0).select(F.col("__set").alias("node"), F.struct(F.col(row).alias("row"), "fp", F.col(in_bands).alias("bands")).alias("r"))
    nodes = written(some.groupBy("node").agg(F.min("r").alias("r")).select("node", "r.row", "r.fp", "r.bands"))
    # of the sets with one fingerprint the least stands for all
    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    near = components(links(reps, distance, groups))
    near = reps.join(near, reps.rep == near.node, "left").select("fp", F.coalesce("root", "rep").alias("bucket"))
    same = nodes.join(near, "fp").select("node", F.xxhash64("bucket", F.lit("simhash")).alias("bucket"))
    dealt = written_alone(nodes.select("node", F.explode("bands").alias("bucket")).union(same))
    members = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of")).where("n > 1")
    rows = written(dealt.join(members.groupBy("n", "of").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(x.as_py(), size).tobytes() for x in b.column(2)], pa.binary())], names=["node", "row", "x"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run"):
            run = table.column("run").to_numpy()
            for lo, hi in zip(*(np.searchsorted(run, np.unique(run), s) for s in ("left", "right"))):
                part = table.slice(lo, hi - lo)
                node, side = part.column("node").to_numpy(), part.column("side").to_numpy()
                held = [np.frombuffer(x, np.uint64) for x in part.column("x").to_pylist()]
                n = np.array([len(x) for x in held])
                begin, label = np.cumsum(n) - n, np.arange(len(n))
                every, at = np.unique(np.concatenate(held), return_inverse=True)
                for i in range(len(n) - 1):
                    if (label == label[i]).all():
                        continue
                    mine = np.zeros(len(every), np.int64)
                    mine[at[begin[i] : begin[i] + n[i]]] = 1
                    both = np.add.reduceat(mine[at], begin)
                    near = (both >= share * (n + n[i] - both) - 1e-9) & ((side[i] == 0) | (side != side[i]))
                    j = np.flatnonzero(near)
                    label = join_labels(label, np.full(len(j), i), j)
                moved = np.flatnonzero(label != np.arange(len(n)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    chosen = written(nodes.join(rows.select("node").distinct(), "node").select("node", "row"))
    dropped(reps, dealt)
    texts = marked.select(F.col("__set").alias("node"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    held = in_arrow(sifted(texts, chosen, "row"), sets, "node long, row long, x binary")
    runs = split_runs(rows, "bucket", "node", block).select("run", "side", "node").join(chosen, "node").join(held, ["node", "row"])
    linked = in_arrow(runs.select("run", "side", "node", "x").repartition("run").sortWithinPartitions("run"), verify, "a long, b long")
    found = components(linked).select(F.col("node").alias("__set"), F.col("root").alias("__root"))
    sizes = marked.groupBy("__set").agg(F.count(F.lit(1)).alias("n"))
    of = written_alone(sizes.join(found, "__set", "left").select("__set", F.coalesce("__root", "__set").alias("__group"), "n"))
    dropped(nodes, rows, chosen)
    return marked.drop(in_bands), of, row
