"""SimHash fingerprints of word shingles, linked through a grid of per-segment bit counts.

Method. A 64-bit fingerprint is mapped to the bit counts (0, 1, 2) of its 32 two-bit segments. The Manhattan distance of two
such vectors is a lower bound of the fingerprints' Hamming distance. The 32 dimensions are dealt into ``groups`` groups; of two
vectors within distance d, at most d groups differ (pigeonhole), so they share the grid cell of some choice of groups - d groups. The
grid range join is one equality join on the cells of all choices: 35 for 7 groups and 4 bits. Two unrelated random fingerprints share
a given cell with a probability of 0.375^(number of its dimensions), in all 5e-5. Pairs that share a cell are tested by the
Manhattan bound, then by the exact Hamming distance. Cells are processed where they lie, after one exchange by cell; of each
cell only a spanning forest of its links leaves the task, so a large group of near copies doesn't give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import in_arrow, join_labels, pairs, split_runs, texts, whole_runs

SEED = 42


def _spread() -> np.ndarray:
    """For each byte value, its bits in eight byte lanes."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


_SPREAD = _spread()


def shingle_hashes(text: str, size: int = 4) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words (ASCII letters lower-cased, ASCII white space parts words), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(n, 8)], np.arange(0, n, 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty and has fingerprint 0. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(t, size)) if t else 0 for t in texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: 32 fields of two bits, each the bit count (0 to 2) of a segment."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distances of embeddings, a lower bound of the fingerprints' Hamming distances. Fields of 0, 1, 2 become unary, 00, 01, 11, where it is the Hamming distance."""
    odd = np.uint64(0x5555555555555555)
    unary = lambda f: f | (f >> np.uint64(1) & odd)  # noqa: E731  2 is binary 10
    return np.bitwise_count(unary(x) ^ unary(y))


def cells(fp: np.ndarray, distance: int, groups: int) -> Iterator[np.ndarray]:
    """For each choice of ``groups - distance`` groups of dimensions, the grid cell of each fingerprint there; cells of different choices have different numbers."""
    half = popcounts(fp)
    bounds = [32 * g // groups for g in range(groups + 1)]
    for k, chosen in enumerate(combinations(range(groups), groups - distance)):
        mask = np.uint64(sum(((1 << 2 * (bounds[g + 1] - bounds[g])) - 1) << 2 * bounds[g] for g in chosen))
        x = (half & mask) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xBF58476D1CE4E5B9 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        yield (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)  # one to one within a choice


def links(reps: DataFrame, distance: int = 4, groups: int = 7, block: int = 1 << 14) -> DataFrame:
    """(fp, rep) with distinct fingerprints to (a, b): links between reps that connect whatever is within ``distance`` bits.

    ``groups`` (32 at most): into how many groups the dimensions are dealt; never into fewer than ``distance`` + 1. A cell with
    more than ``block`` fingerprints is compared in pairs of blocks, each a run of its own.
    """
    groups = max(groups, distance + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0), b.column(1)
            for cell in cells(fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), distance, groups):
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), fp, rep], names=["cell", "fp", "rep"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "run"):
            run, fp, rep, side = (t.column(k).to_numpy() for k in ("run", "fp", "rep", "side"))
            fp, label = fp.view(np.uint64), np.arange(len(fp))
            at = popcounts(fp)
            for i, j in pairs(run, np.ones(len(run), bool), 1 << 21):
                able = (manhattan(at[i], at[j]) <= distance) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[able], j[able]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                label = join_labels(label, i[near], j[near])
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], names=["a", "b"])

    dealt = in_arrow(reps.select("fp", "rep").where("rep is not null"), deal, "cell long, fp long, rep long")
    runs = split_runs(dealt, "cell", "fp", block).drop("cell")
    return in_arrow(runs.repartition("run").sortWithinPartitions("run"), verify, "a long, b long")
