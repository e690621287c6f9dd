r"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

The model is a trigram model trained on the corpus that it scores; a document's own n-grams are left out of every count that it is
scored with. With c' for such counts: S(w | u v) = c'(uvw) / c'(uv) if c'(uvw) > 0, else 0.4 c'(vw) / c'(v) if c'(vw) > 0, else
0.16 max(c'(w), 1/2) / N'. Every word counts, however rare; two start marks stand before each text.

1. Texts become batches of documents: each batch's distinct words by hash, and its tokens as places among them.
2. A batch is exploded to its distinct n-grams (1, 2 and 3 words, as one 64-bit key each) with counts, pre-aggregated in the batch.
   They go to the partition of their key: the count tables. A key occurs there at most once for each batch, however frequent it is.
3. In each partition, keys are joined to their totals, and each batch gets its keys' totals back.
4. Totals are joined to the batch's n-grams, a document's own counts subtracted, and scores summed for each document.

A partition of the count tables holds about ``KEYS`` keys at any size of the corpus: there are as many as the tokens need, each is
worked on by itself, and Spark deals them over tasks. A row is what a batch and a partition share, so there are never more rows
than n-grams. Two n-grams of one key, out of 2^64, would be counted together: among 10^9 distinct ones 0.03 such pairs are expected.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import read, texts, whole_runs
from .store import written, written_alone

WORD = re.compile(r"[^\W_]+")
BACKOFF = 0.4
#: Tokens of a batch, and keys of a partition of the count tables, about.
BATCH, KEYS = 1_000_000, 1 << 20
_START = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _pressed(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expanded(data: pa.Buffer, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, n)
    x = np.zeros((n, 8), np.uint8)
    x[:, :width] = planes.T
    return x.view("<u8").ravel()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, not negative, in as few bytes as the largest needs; the first byte says how many."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _pressed(x, width)


def unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    data = data.as_buffer()
    return _expanded(data.slice(1), n, int(np.frombuffer(data, np.uint8, 1)[0]))


def batches_of(docs: DataFrame) -> DataFrame:
    """(batch, doc_ids, lengths, n, words, tokens): documents in batches of about ``BATCH`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place), np.uint64, len(place))
            lengths, at = [len(x) for x in held], np.concatenate(held)
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # frequent words first: small numbers
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            made = (uuid.uuid4().int >> 65, ids, lengths, len(at), words[order].tobytes(), packed(rank[at]))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], names=["batch", "doc_ids", "lengths", "n", "words", "tokens"])

        waiting = 0
        for b in batches:
            for doc, text in zip(b.column(0), texts(b.column(1))):
                ws = WORD.findall(text.lower()) if text else []
                held.append(np.fromiter((place.setdefault(w, len(place)) for w in ws), np.uint32, len(ws)))
                ids.append(doc.as_py())
                waiting += len(ws) + 20
                if waiting > BATCH:
                    yield out()
                    place, ids, held, waiting = {}, [], [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "batch long, doc_ids array<long>, lengths array<long>, n long, words binary, tokens binary")


class Grams:
    """A batch's n-grams. keys: the distinct ones, sorted; one, two, three: the place there of the word, bigram and trigram that ends at each token."""

    def __init__(self, words: pa.Scalar, tokens: pa.Scalar, lengths: np.ndarray):
        word = np.frombuffer(words.as_buffer(), np.uint64)
        self.lengths, self.doc = lengths, np.repeat(np.arange(len(lengths)), lengths)
        n = len(self.doc)
        at = unpacked(tokens, n).astype(np.int64)
        self.first = (np.cumsum(lengths) - lengths)[lengths > 0]  # the tokens that begin a text
        self.second = (self.first + 1)[lengths[lengths > 0] > 1]
        h = word[at] if n else np.zeros(0, np.uint64)
        before, last = np.roll(h, 1), np.roll(h, 2)
        before[self.first] = last[self.first] = last[self.second] = _START
        two = _mix(_mix(before) + h * np.uint64(3))
        three = _mix(two + _mix(last ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(5))
        self.keys, places = np.unique(np.concatenate((_mix(h + np.uint64(1)), two, three)), return_inverse=True)
        self.one, self.two, self.three = places.reshape(3, n)
        self.places = places

    def counts(self) -> np.ndarray:
        return np.bincount(self.places, minlength=len(self.keys))

    def own(self, places: np.ndarray) -> np.ndarray:
        """How often the token's document has the same n-gram."""
        _, same, n = np.unique(self.doc * len(self.keys) + places, return_inverse=True, return_counts=True)
        return n[same]

    def previous(self, of: np.ndarray, at_start: int) -> np.ndarray:
        """The numbers of the token before; ``at_start`` where a text begins."""
        x = np.roll(of, 1)
        x[self.first] = at_start
        return x

    def scores(self, totals: np.ndarray, documents: int, tokens: int) -> np.ndarray:
        """log10 of the score of each document."""
        left, inside = {}, {}
        for name in ("one", "two", "three"):
            places = getattr(self, name)
            left[name] = totals[places] - self.own(places)
        inside = {name: self.previous(left[name], documents - 1) for name in ("one", "two")}  # of the contexts
        rest = np.maximum(tokens - self.lengths, 1)[self.doc]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(left["three"] > 0, left["three"] / inside["two"], np.where(left["two"] > 0, BACKOFF * left["two"] / inside["one"], BACKOFF**2 * np.maximum(left["one"], 0.5) / rest))
        return np.bincount(self.doc, np.log10(share), len(self.lengths))


def _grams(row: dict[str, pa.Array], k: int) -> Grams:
    return Grams(row["words"][k], row["tokens"][k], row["lengths"][k].values.to_numpy())


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log10_score, mean_score) of every document; mean_score is null without tokens, log10_score 0 then.

    Tokens are lower-cased runs of letters and digits. Rows of one doc_id (null is one, too) are summed; each row counts as a
    document of its own in the counts, so a repeated row sees its other copy. Null and empty texts have no tokens; other columns are
    ignored; an empty table gives no rows. A text is held whole by one task.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(batches_of(docs))
    tokens, documents = (x or 0 for x in table.agg(F.sum("n"), F.sum(F.size("doc_ids"))).first())
    parts = max(1, 3 * tokens // KEYS)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n: min(100_000, max(cores, n))  # noqa: E731  each takes what it has one by one, so the number is only about speed

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = dict(zip(b.schema.names, b.columns))
            for k in range(b.num_rows):
                grams = _grams(row, k)
                part = ((grams.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                counts, edges = grams.counts(), np.flatnonzero(np.diff(part, prepend=-1, append=parts))
                for at in range(0, len(edges) - 1, 256):  # small record batches
                    slices = [slice(a, z) for a, z in zip(edges[at : at + 256], edges[at + 1 : at + 257])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["batch"][k].as_py()] * len(slices), pa.int64()),
                        pa.array(part[[s.start for s in slices]]),
                        pa.array([s.stop - s.start for s in slices], pa.int32()),
                        pa.array([packed(np.diff(grams.keys[s], prepend=np.uint64(0))) for s in slices], pa.binary()),
                        pa.array([packed(counts[s]) for s in slices], pa.binary()),
                    ], names=["batch", "p", "m", "keys", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "p"):
            part = table.column("p").to_numpy()
            for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
                batch, p, m, keys, counts = (table.column(c).slice(lo, hi - lo) for c in ("batch", "p", "m", "keys", "counts"))
                sizes = m.to_numpy()
                _, at = np.unique(np.concatenate([np.cumsum(unpacked(x, n)) for x, n in zip(keys, sizes)]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([unpacked(x, n) for x, n in zip(counts, sizes)])).astype(np.int64)
                ends = np.cumsum(sizes)
                totals = [packed(sums[at[z - n : z]]) for z, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.combine_chunks(), p.combine_chunks(), m.combine_chunks(), pa.array(totals, pa.binary())], names=["batch", "p", "m", "totals"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "batch"):
            name = table.column("batch").to_numpy()
            for lo, hi in zip(*(np.searchsorted(name, np.unique(name), side) for side in ("left", "right"))):
                own = table.slice(lo, hi - lo).combine_chunks()
                row = {c: own.column(c).combine_chunks() for c in own.column_names}  # the batch itself comes first
                grams = _grams(row, 0)
                totals = [unpacked(x, int(n)).astype(np.int64) for x, n in zip(row["totals"][1:], row["m"][1:].to_numpy(zero_copy_only=False))]
                made = grams.scores(np.concatenate(totals) if totals else np.zeros(0, np.int64), documents, tokens)
                yield pa.RecordBatch.from_arrays([row["doc_ids"][0].values, pa.array(grams.lengths, pa.int64()), pa.array(made, pa.float64())], names=["doc_id", "n_tokens", "score"])

    def totals_of(exploded: DataFrame) -> DataFrame:
        return exploded.repartition(tasks(parts // 8), "p").sortWithinPartitions("p").mapInArrow(total, "batch long, p long, m int, totals binary")

    # no name here holds the exploded n-grams, so their files can go
    totals = written_alone(totals_of(table.mapInArrow(explode, "batch long, p long, m int, keys binary, counts binary")))
    nothing = lambda kind: F.lit(None).cast(kind)
    whole = table.select("batch", F.lit(-1).cast("long").alias("p"), nothing("int").alias("m"), nothing("binary").alias("totals"), "doc_ids", "lengths", "words", "tokens")
    back = totals.select("batch", "p", "m", "totals", nothing("array<long>").alias("doc_ids"), nothing("array<long>").alias("lengths"), nothing("binary").alias("words"), nothing("binary").alias("tokens"))
    sums = whole.union(back).repartition(tasks(tokens // (2 * BATCH)), "batch").sortWithinPartitions("batch", "p").mapInArrow(score, "doc_id long, n_tokens long, score double")
    out = sums.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("log10_score"))
    return out.withColumn("mean_score", F.col("log10_score") / F.nullif("n_tokens", F.lit(0)))


SQL = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS l FROM documents),
    t AS (SELECT r, doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM d),
    h AS (SELECT r, doc_id, w, coalesce(lag(w) OVER x, '<s>') AS v, coalesce(lag(w, 2) OVER x, '<s>') AS u FROM t WINDOW x AS (PARTITION BY r ORDER BY i)),
    g AS (SELECT r, doc_id, u, v, w, count(*) AS n FROM h GROUP BY ALL), c3 AS (SELECT u, v, w, sum(n) AS n FROM g GROUP BY ALL),
    o2 AS (SELECT r, v, w, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT r, '<s>', '<s>', 1 FROM d), c2 AS (SELECT v, w, sum(n) AS n FROM o2 GROUP BY ALL),
    o1 AS (SELECT r, w, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT r, '<s>', 1 FROM d), c1 AS (SELECT w, sum(n) AS n FROM o1 GROUP BY ALL),
    k AS (SELECT g.doc_id, g.n, c3.n - g.n AS n3, c2.n - o2.n AS n2, c1.n - o1.n AS n1, cx.n - ox.n AS d3, cy.n - oy.n AS d2, (SELECT count(*) FROM t) - len(d.l) AS rest
          FROM g JOIN c3 USING (u, v, w) JOIN d ON d.r = g.r
          JOIN o2 ON o2.r = g.r AND o2.v = g.v AND o2.w = g.w JOIN c2 ON c2.v = g.v AND c2.w = g.w
          JOIN o1 ON o1.r = g.r AND o1.w = g.w JOIN c1 ON c1.w = g.w
          JOIN o2 ox ON ox.r = g.r AND ox.v = g.u AND ox.w = g.v JOIN c2 cx ON cx.v = g.u AND cx.w = g.v
          JOIN o1 oy ON oy.r = g.r AND oy.w = g.v JOIN c1 cy ON cy.w = g.v),
    x AS (SELECT doc_id, sum(n) AS n, sum(n * log10(CASE WHEN n3 > 0 THEN CAST(n3 AS DOUBLE) / d3 WHEN n2 > 0 THEN {BACKOFF} * n2 / d2 ELSE {BACKOFF**2:.2f} * greatest(CAST(n1 AS DOUBLE), 0.5) / greatest(rest, 1) END)) AS score FROM k GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(x.n, 0) AS BIGINT) AS n_tokens, floor(coalesce(score, 0) * 1e4 + 0.5) / 1e4 AS log10_score, floor(score / x.n * 1e6 + 0.5) / 1e6 AS mean_score
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN x USING (doc_id)"""


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores rounded half up, so that the order of summing doesn't show."""
    out = scores(read(spark, sf_dir, "documents"))
    half_up = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k).alias(c)
    return out.select("doc_id", "n_tokens", half_up("log10_score", 1e4), half_up("mean_score", 1e6))
