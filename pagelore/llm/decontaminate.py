"""Benchmark decontamination by latent semantic retrieval.

Features are the benchmark's words, weighted by IDF over all documents. A randomised SVD of the benchmark's TF-IDF passages,
computed in two distributed passes, gives the latent space. Passages are taken in groups, each with a space of as many directions
as it has passages, so that a passage keeps its whole norm however many items there are. Overlapping windows of every document are
folded in and compared by cosine with the benchmark's passages. A window is folded in only if its words' weights, each with the
largest that any passage gives it, can add up to the cosine at all. Candidates are verified on the words themselves: longest common
subsequence with the item, and for paraphrases the item's answer (its last words).

Items are compared with windows of their own length class (``CLASSES``), so that a short item isn't lost among the words around it.
Documents are read twice for all items together: for document frequencies, and for all windows against all passages. What is
sent to executors grows with the benchmark alone: a passage's part of the space is kept as the words that it has a cosine with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import in_arrow, read, texts

WORD = re.compile(r"[^\W_]+")
#: (most words of an item, words of a window, stride): up to eight words, windows of just the item's length begin at every word;
#: longer items are cut into passages of a window's length.
CLASSES = [(n, n, 1) for n in range(1, 9)] + [(12, 15, 3), (16, 20, 4), (1 << 30, 24, 12)]
COSINE, SURE, LIKELY, ANSWER = 0.3, 0.8, 0.5, 0.5
#: The fewest words of an item that is looked for in paraphrase; a shorter one needs SURE.
PARAPHRASE = 8
#: A word's largest IDF weight.
MOST = 4.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in batches:
            for t in texts(b.column(0)):
                n += 1
                at = [vocabulary[w] for w in vocabulary.keys() & set(words_of(t))]
                df[at] += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "n"])

    rows = in_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()  # at most a row for each benchmark word
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for k, n in rows:
        df[k] = n
    return df[:-1], int(df[-1])


def latent_space(passages: DataFrame, size: int, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (size x rank or fewer) of the rows of (distinct ids array<int>, weights array<float>), by a randomised range finder.

    Pass 1 sums the Gram matrix of A Omega, pass 2 the projected rows; each task returns one matrix, added up by row.
    """
    width = rank + 16
    omega = np.random.default_rng(seed).standard_normal((size, width))

    def rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, weights in zip(b.column(0), b.column(1)):
            yield np.array(ids.as_py(), np.int64), np.array(weights.as_py(), np.float64)

    def summed(part, height: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, height))
            for b in batches:
                for i, w in rows(b):
                    part(total, i, w)
            yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["j", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for j, x in zip(b.column(0).to_pylist(), b.column(1)):
                    total[j] = total.get(j, 0) + x.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["j", "x"])

        out = np.zeros((width, height))
        kind = "j long, x array<double>"
        for j, x in in_arrow(in_arrow(passages, run, kind).repartition("j"), add, kind).collect():  # ``width`` rows
            out[j] = x
        return out

    def gram(total, i, w):
        y = w @ omega[i]
        total += np.outer(y, y)

    values, vectors = np.linalg.eigh(summed(gram, width))
    good = values > values[-1] * 1e-10
    white = vectors[:, good] / np.sqrt(values[good])  # A omega white has orthonormal columns

    def project(total, i, w):
        q = (w @ omega[i]) @ white
        total[: len(q), i] += np.outer(q, w)

    u, s, vt = np.linalg.svd(summed(project, size), full_matrices=False)
    return vt[: min(rank, int((s > s[0] * 1e-9).sum()))].T


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def verified(item: list[str], own: Counter, region: list[str]) -> tuple[float, float]:
    """(LCS as a share of the item, share of its answer's words there) in the best stretch of the region not much longer than the item.

    own: the item's words, counted.
    """
    n = len(item)
    if sum(map(own.__getitem__, own.keys() & region)) < (LIKELY if n >= PARAPHRASE else SURE) * n:  # the subsequence can't be longer than that
        return 0.0, 0.0
    answer = item[-max(2, n // 4) :]
    length, best = n + n // 4 + 4, (0.0, 0.0)
    for at in range(0, max(1, len(region) - length + max(1, n // 4)), max(1, n // 4)):
        stretch = region[at : at + length]
        share = common(item, stretch) / n
        if share > best[0]:
            best = (share, common(answer, stretch) / len(answer))
    return best


@dataclass
class Group:
    """Passages with a latent space of their own: their words, the largest weight of each in a passage, and each passage's item.

    cosines[begin[w]:begin[w + 1]]: what word w adds to the cosine with the passages ``near`` at the same places.
    """

    words: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    near: np.ndarray
    cosines: np.ndarray
    owner: np.ndarray

    def table(self) -> np.ndarray:
        """Words by passages."""
        out = np.zeros((len(self.words), len(self.owner)), np.float32)
        out[np.repeat(np.arange(len(self.words)), np.diff(self.begin)), self.near] = self.cosines
        return out


def _group(spark, passages: list[tuple[int, list[int]]], idf: np.ndarray) -> Group:
    """The latent space has a direction for each passage, so none of a passage's norm is lost in it."""
    words = np.unique(np.concatenate([p for _, p in passages]))
    idf, ids, weights, most = idf[words], [], [], np.zeros(len(words))
    for _, p in passages:
        distinct, n = np.unique(np.searchsorted(words, p), return_counts=True)
        w = n * idf[distinct]
        ids.append(distinct)
        weights.append(w / np.linalg.norm(w))
        most[distinct] = np.maximum(most[distinct], weights[-1])
    table = spark.createDataFrame([(i.tolist(), w.tolist()) for i, w in zip(ids, weights)], "ids array<int>, weights array<double>")
    space = latent_space(table, len(words), min(len(passages), len(words)))
    targets = np.array([w @ space[i] for i, w in zip(ids, weights)])
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    cosines = (space * idf[:, None]) @ targets.T
    at, near = np.nonzero(np.abs(cosines) > 1e-5)  # what is less is the decomposition's rounding
    return Group(words, most, np.searchsorted(at, np.arange(len(words) + 1)), near.astype(np.int32), cosines[at, near].astype(np.float32), np.array([k for k, _ in passages]))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... numbers."""
    out = np.zeros(len(x) + 1)
    np.cumsum(x, out=out[1:])
    return out


@dataclass
class LengthClass:
    """Passages of items of about one length: size and stride of the windows, groups, and the largest weight that any passage gives each word of the vocabulary."""

    size: int
    stride: int
    groups: list[Group]
    bound: np.ndarray

    def windows(self, at: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and norm of the windows whose weights allow the cosine with some passage. total: sums of squared weights up to each word."""
        starts = np.arange(0, max(1, len(at) - self.size + self.stride), self.stride)
        ends = np.minimum(starts + self.size, len(at))
        most = _sums(self.bound[at])
        norm, able = np.sqrt(total[ends] - total[starts]), most[ends] - most[starts]
        w = (able >= COSINE * norm) & (able > 0)
        return starts[w], ends[w], norm[w]

    def retrieved(self, at: np.ndarray, size: np.ndarray, norm: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, items and cosines where a window is near a passage of the item; ``at`` has the words of all windows, end to end."""
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        local = np.empty(len(idf) + 1, np.int64)
        for g in self.groups:
            local.fill(-1)
            local[g.words] = np.arange(len(g.words))
            rows = local[at]
            known = rows >= 0
            weight = np.where(known, np.append(idf[g.words] * g.most, 0)[rows], 0)
            able = np.add.reduceat(weight, begin) >= COSINE * norm * (1 - 1e-6)
            known &= able[of]
            rows, window = rows[known], of[known]
            n = np.bincount(window, minlength=len(size))
            chosen = np.argsort(-n, kind="stable")[: int((n > 0).sum())]  # the windows with most words first
            if not len(chosen):
                continue
            first, table = (np.cumsum(n) - n)[chosen], g.table()
            cos = np.zeros((len(chosen), len(g.owner)), np.float32)
            for k in range(int(n.max())):
                m = int(np.searchsorted(-n[chosen], -k, "left"))  # those with more than k words
                cos[:m] += table[rows[first[:m] + k]]
            cos /= norm[chosen, None].astype(np.float32)
            w, p = np.nonzero(cos >= COSINE)
            yield chosen[w], g.owner[p], cos[w, p]


def _classes(spark, items: list[tuple[int, list[str]]], vocabulary: dict[str, int], idf: np.ndarray, rank: int) -> list[LengthClass]:
    out, least = [], 0
    for most, size, stride in CLASSES:
        passages = []
        for k, (_, ws) in enumerate(items):
            if least < len(ws) <= most:
                passages += [(k, [vocabulary[w] for w in ws[at : at + size]]) for at in range(0, max(1, len(ws) - (stride if len(ws) > size else len(ws))), stride)]
        least = most
        if passages:
            groups = [_group(spark, passages[at : at + rank], idf) for at in range(0, len(passages), rank)]
            weight = np.zeros(len(idf) + 1)
            for g in groups:
                weight[g.words] = np.maximum(weight[g.words], g.most)
            out.append(LengthClass(size, stride, groups, np.append(idf, 0) * weight))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = 256, block: int = 50_000) -> DataFrame:
    """(doc_id, item_id, similarity, lcs, answer): a row for each document and item whose text, or a close paraphrase, is in it.

    ``rank`` passages at most share a latent space, which has a direction for each. The driver and each task hold about ``block`` items
    at a time; a larger benchmark takes another reading of the documents for each so many.

    A pair is returned if some window's latent cosine is COSINE or more and the longest common subsequence holds SURE of the
    item's words, or, for items of PARAPHRASE words or more, LIKELY of them with ANSWER of the answer's. Case, punctuation and spacing don't
    count. Items without words leak nowhere; null and empty texts hold nothing; repeated documents, and those with a null id, are each
    returned; a repeated item, id and text, counts once, and an item_id with several texts is each of them; of ties for the best
    stretch the first counts. Other columns are ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // block))
    out = None
    for k in range(blocks):
        rows = {(r.item, tuple(words_of(r.text))) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()}  # about ``block`` items
        part = _leaks(docs, [(i, list(ws)) for i, ws in sorted(rows) if ws], id_col, text_col, rank)
        out = part if out is None else out.union(part)
    return out


def _leaks(docs: DataFrame, items: list[tuple[int, list[str]]], id_col: str, text_col: str, rank: int) -> DataFrame:
    schema = "doc_id long, item_id long, similarity double, lcs double, answer double"
    spark = docs.sparkSession
    if not items:
        return spark.createDataFrame([], schema)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    df, n = document_frequencies(docs, vocabulary, text_col)
    idf = np.minimum(np.log((1 + n) / (1 + df)) + 0.1, MOST)  # so that rare words around a leak don't drown an item of frequent words
    rare = float(np.median(idf))  # of a word outside the benchmark
    classes = _classes(spark, items, vocabulary, idf, rank)
    mass, unknown, counts = np.append(idf**2, rare**2), len(vocabulary), [Counter(ws) for _, ws in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[str], np.ndarray, list[tuple]]] = []

        def out() -> pa.RecordBatch:
            found: list[list] = [[], [], [], [], []]
            hits: dict[tuple[int, int], tuple[float, float, float]] = {}
            for c, of_class in enumerate(classes):
                some = [d for d, h in enumerate(held) if len(h[3][c][0])]
                if not some:
                    continue
                starts, ends, norm = (np.concatenate([held[d][3][c][k] for d in some]) for k in range(3))
                of = np.repeat(some, [len(held[d][3][c][0]) for d in some])
                words = np.concatenate([held[d][2][a:z] for d in some for a, z in zip(*(x.tolist() for x in held[d][3][c][:2]))])
                near = list(of_class.retrieved(words, ends - starts, norm, idf))
                if not near:
                    continue
                window, item_at, cosine = (np.concatenate(x) for x in zip(*near))
                pair, place = np.unique(window * len(items) + item_at, return_inverse=True)
                most = np.zeros(len(pair), np.float32)
                np.maximum.at(most, place, cosine)  # of an item's passages
                window, item_at = np.divmod(pair, len(items))
                for doc, k, a, z, cos in zip(of[window].tolist(), item_at.tolist(), starts[window].tolist(), ends[window].tolist(), most.tolist()):
                    item, ws = items[k][1], held[doc][1]
                    lcs, answer = verified(item, counts[k], ws[max(0, a - len(item)) : z + len(item)])
                    if lcs >= SURE or len(item) >= PARAPHRASE and lcs >= LIKELY and answer >= ANSWER:
                        hits[doc, k] = max(hits.get((doc, k), (0.0, 0.0, 0.0)), (lcs, answer, cos))
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for (doc, k), hit in hits.items():  # items of one id
                best[doc, items[k][0]] = max(best.get((doc, items[k][0]), (0.0, 0.0, 0.0)), hit)
            for (doc, item), (lcs, answer, cos) in sorted(best.items()):
                for column, value in zip(found, (held[doc][0], item, min(cos, 1.0), lcs, answer)):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "similarity", "lcs", "answer"])

        waiting = 0
        for b in batches:
            for doc, text in zip(b.column(0), texts(b.column(1))):
                ws = words_of(text)
                if not ws:
                    continue
                at = np.fromiter(map(vocabulary.get, ws, repeat(unknown)), np.int64, len(ws))
                total = _sums(mass[at])
                chosen = [c.windows(at, total) for c in classes]
                if some := sum(len(x[0]) for x in chosen):
                    held.append((doc.as_py(), ws, at, chosen))
                    waiting += some
                if waiting > 2000:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    return in_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
