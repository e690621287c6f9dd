"""Language identification: TF-IDF vectors of byte n-grams, nearest of several centroids per language by cosine, with rejection.

Document frequencies are counted over all training rows. Centroids are fitted by spherical k-means on a bounded sample: at most
``sample`` distinct training texts in all (but 20 of each language), dealt evenly over the languages: those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import in_arrow, read, texts, with_columns

DIMS, ORDERS, BLOCK = 8192, (2, 3), 1 << 20
#: A text is rejected under this share of the cosine that all but a few (LOW of them) of its language's sampled texts reach.
REJECT, LOW = 0.2, 0.01
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    """centroids: unit rows; langs, least: the language of each and the cosine under which it rejects."""

    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    langs: list[str] = field(default_factory=list)
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the text's byte 2- and 3-grams, lower-cased, with everything that is no letter as one space."""
    words = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "
    counts = np.zeros(DIMS, np.int64)
    for lo in range(0, max(1, len(words) - 2), BLOCK):
        a = np.frombuffer(words[lo : lo + BLOCK + 2], np.uint8).astype(np.uint32)
        two = a[:-1] * np.uint32(0x01000193) + a[1:] * np.uint32(0x9E3779B1)
        three = two[:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
        counts += np.bincount(np.concatenate((two[:BLOCK] >> np.uint32(19), (three ^ three >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(19))), minlength=DIMS)
    return counts


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first centres; empty clusters go."""
    centres = [x.mean(axis=0) / max(np.linalg.norm(x.mean(axis=0)), 1e-12)]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([x[nearest == i].mean(axis=0) for i in range(len(c)) if (nearest == i).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = 4, sample: int = 1200) -> Model:
    """A model from labelled rows; rows with a null text or language, or without letters, teach nothing. No rows: no language."""
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in texts(b.column(0)):
                df += ngram_counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bin", "n"])

    seen = dict(in_arrow(rows.select("text"), frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect())  # at most DIMS + 1 rows
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 40)))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # a row for each language: less than the model has
    if not sizes:
        return Model()
    df = np.array([seen.get(i, 0) for i in range(DIMS)])
    idf = (np.log((1 + seen[-1]) / (1 + df)) + 1).astype(np.float32)
    most = max(20, sample // len(sizes))
    spark = rows.sparkSession
    # twice as many as wanted, so that an approximate count leaves enough; copies of a text count once
    under = spark.createDataFrame([(k, int(min(1.0, 2 * most / max(1, n)) * (1 << 40))) for k, n in sizes.items()], "lang string, under long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.minimum(ngram_counts(t), 60_000).astype(np.uint16).tobytes() for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(data, pa.binary())], names=["lang", "h", "v"])

    chosen = rows.join(F.broadcast(under), "lang").where("h < under").groupBy("lang", "h").agg(F.min("text").alias("text"))
    got: dict[str, list[tuple[int, bytes]]] = {}
    for lang, h, v in in_arrow(chosen.select("text", "lang", "h"), counted, "lang string, h long, v binary").collect():  # about 2 * most for each language
        got.setdefault(lang, []).append((h, v))
    model = Model(idf=idf)
    centroids = []
    for lang in sorted(sizes):
        mine = [np.frombuffer(v, np.uint16) for _, v in sorted(got.get(lang, []))[:most]]
        x = _vectors(np.array(mine), idf) if mine else np.zeros((0, DIMS), np.float32)
        x = x[np.linalg.norm(x, axis=1) > 0.5]
        if len(x):
            c = kmeans(x, clusters)
            centroids.append(c)
            model.langs += [lang] * len(c)
            model.least = np.append(model.least, np.full(len(c), REJECT * np.quantile((x @ c.T).max(axis=1), LOW, method="higher"), np.float32))
    model.centroids = np.concatenate(centroids).astype(np.float32) if centroids else model.centroids
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the ``keep`` columns) with lang_pred, score (the best centroid's cosine, 0 to 1) and rejected.

    ``und``, score 0 and rejected: a null text, one without a letter, or no language learned. Any other text gets the nearest
    centroid's language, and is rejected if the cosine is under that language's least. Ties go to the first language by name.
    Rows that repeat are each judged, alike; columns with the new ones' names give way; an empty table gives no rows.
    """

    def make():
        def compute(batch: Iterator[str | None]) -> list:
            lang, score, rejected = [], [], []
            held: list[str | None] = []

            def flush() -> None:
                x = _vectors(np.array([ngram_counts(t) if t else np.zeros(DIMS, np.int64) for t in held]), model.idf)
                cos = x @ model.centroids.T
                for t, row in zip(held, cos):
                    if t is None or not len(row):
                        found = ("und", 0.0, True)
                    else:
                        k = int(row.argmax())
                        found = (model.langs[k], float(min(max(row[k], 0), 1)), bool(row[k] < model.least[k]))
                    for column, value in zip((lang, score, rejected), found):
                        column.append(value)
                held.clear()

            for t in batch:
                held.append(t if t and any(map(str.isalpha, t)) else None)
                if len(held) == 64:
                    flush()
            if held:
                flush()
            return [lang, score, rejected]

        return compute

    return with_columns(docs, text_col, make, "lang_pred string, score double, rejected boolean", keep)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id") -> Model:
    return train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.withColumn("held_out", held_out()), learned(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
