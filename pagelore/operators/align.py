"""Alignment of two word sequences of one page: repeated local alignment, run-together words, and marks between matched words.

All of a page's work is one Python call inside a grouped map, so it is bounded by the page: by its words and by a budget of cells.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .structure import _FOLD

#: Scores of an exact, a fuzzy and no match and of a gap; words a page, cells a page; words skipped and spanned by a run.
EXACT, FUZZY, NONE, GAP = 3, 1, -3, -1
MOST_WORDS, BUDGET = 4000, 50_000_000
SKIPPED, SPANNED = 8, 32
LONGEST = 63


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance; anything over ``most`` as soon as it is certain. Words of over 63 characters are equal or far."""
    if len(b) > LONGEST:
        return 0 if a == b else most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def similar(a: str, b: str) -> bool:
    most = max(len(a), len(b)) // 4
    return min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


class Scores:
    """Score rows of distinct words of one side against the distinct words of the other.

    Edit distances are only computed for words that can be near: one edit changes a word's counts of characters by two at most.
    """

    def __init__(self, page: list[str]):
        self.words = list(dict.fromkeys(page))
        place = {w: k for k, w in enumerate(self.words)}
        self.columns = np.array([place[w] for w in page], np.int64)
        self.counts = np.array([self._counted(w) for w in self.words], np.int64).reshape(-1, 64)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.rows: dict[str, np.ndarray] = {}

    @staticmethod
    def _counted(word: str) -> np.ndarray:
        return np.bincount(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 64, minlength=64)

    def row(self, word: str) -> np.ndarray:
        if word not in self.rows:
            most = np.maximum(self.lengths, len(word)) // 4
            near = (np.abs(self.lengths - len(word)) <= most) & (np.minimum(self.lengths, len(word)) >= 4)
            near &= np.abs(self.counts - self._counted(word)).sum(axis=1) <= 2 * most
            row = np.full(len(self.words), NONE, np.int64)
            for k in np.flatnonzero(near).tolist():
                row[k] = FUZZY if similar(word, self.words[k]) else NONE
            self.rows[word] = row = np.where([w == word for w in self.words], EXACT, row)
        return self.rows[word]


def best_stretch(left: list[str], columns: np.ndarray, scores: Scores) -> tuple[int, list[tuple[int, int]]]:
    """The best local alignment's score and matched pairs. Of equal scores the first cell counts; diagonals before gaps on the left's side."""
    n, m = len(left), len(columns)
    table = np.zeros((n + 1, m + 1), np.int64)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.maximum(table[i - 1] + GAP, 0)
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + scores.row(left[i - 1])[columns])
        table[i] = np.maximum(np.maximum.accumulate(row - GAP * step) + GAP * step, 0)
        table[i, 0] = 0
    best = int(table.max())
    i, j = divmod(int(table.argmax()), m + 1)
    pairs: list[tuple[int, int]] = []
    while i and j and table[i, j] > 0:
        s = int(scores.row(left[i - 1])[columns[j - 1]])
        if table[i, j] == table[i - 1, j - 1] + s:
            i, j = i - 1, j - 1
            if s > 0:
                pairs.append((i, j))
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, pairs[::-1]


def align(left: list[str], right: list[str], budget: int = BUDGET) -> tuple[list[int], bool]:
    """For each word of ``left`` the place of its match in ``right`` or -1, and whether the budget was enough.

    Empty words never match. A stretch counts from a score of two exact matches, or of all words left if they are fewer.
    """
    match, free = [-1] * len(left), np.array([bool(w) for w in right], bool)
    scores, gaps = Scores(right), [(0, len(left))]
    while gaps:
        a, b = gaps.pop()
        mine, theirs = [i for i in range(a, b) if left[i]], np.flatnonzero(free)
        if not mine or not len(theirs):
            continue
        budget -= len(mine) * len(theirs)
        if budget < 0:
            return match, False
        best, pairs = best_stretch([left[i] for i in mine], scores.columns[theirs], scores)
        if not pairs or best < min(2 * EXACT, EXACT * len(mine)):
            continue
        found = [mine[x] for x, _ in pairs]
        for i, (_, y) in zip(found, pairs):
            match[i] = int(theirs[y])
            free[theirs[y]] = False
        edges = [*zip([i + 1 for i in found[:-1]], found[1:])]
        gaps += [(a, found[0]), (found[-1] + 1, b), *((x, y) for x, y in edges if x < y)]
    return match, True


def _bare(word: str) -> str:
    return "".join(c for c in word if unicodedata.category(c)[0] in "LN")


def match_runs(left: list[str], right: list[str], match: list[int]) -> list[int]:
    """Between words matched in order: unmatched words that together spell one unmatched word of the other side all match it."""
    out, mine = list(match), [_bare(w) for w in left]
    taken = {t for t in match if t >= 0}
    anchors = [-1, *(k for k, t in enumerate(match) if t >= 0), len(left)]
    for before, after in zip(anchors, anchors[1:]):
        low = match[before] if before >= 0 else -1
        high = match[after] if after < len(left) else len(right)
        at = before + 1
        for t in range(low + 1, high):
            want = _bare(right[t])
            if t in taken or not want or at >= after:
                continue
            for start in range(at, min(after, at + SKIPPED)):
                end, spelled = start, ""
                while mine[start] and end < min(after, start + SPANNED) and len(spelled) < len(want) and want.startswith(spelled + mine[end]):
                    spelled, end = spelled + mine[end], end + 1
                if mine[start] and spelled == want:
                    for k in range(start, end):
                        out[k] = t if mine[k] else out[k]
                    taken.add(t)
                    at = end
                    break
    return out


def match_marks(left: list[str], right: list[str], match: list[int]) -> list[int]:
    """Between neighbouring matches with as many words on either side: words that read the same (NFKC, plain quotes and dashes) match."""
    out, same = list(match), lambda w: unicodedata.normalize("NFKC", w).translate(_FOLD)
    taken = {t for t in match if t >= 0}
    anchors = [k for k, t in enumerate(match) if t >= 0]
    for a, b in zip(anchors, anchors[1:]):
        if b - a > 1 and match[b] - match[a] == b - a:
            for k in range(1, b - a):
                t = match[a] + k
                if t not in taken and same(left[a + k]) == same(right[t]):
                    out[a + k] = t
                    taken.add(t)
    return out


def align_page(left: tuple[list[str], list[str]], right: tuple[list[str], list[str]], budget: int = BUDGET) -> tuple[list[int] | None, bool]:
    """Matches of a page's words, from the (normalised, shown) words of both sides: alignment, run-together words, then marks.

    None and false for a page of over 4,000 words on either side.
    """
    if max(len(left[0]), len(right[0])) > MOST_WORDS:
        return None, False
    found, complete = align(left[0], right[0], budget)
    return match_marks(left[1], right[1], match_runs(left[0], right[0], found)), complete


@F.pandas_udf(T.StructType([T.StructField("match", T.ArrayType(T.IntegerType())), T.StructField("complete", T.BooleanType())]))
def align_arrays(left_norm: pd.Series, left_text: pd.Series, right_norm: pd.Series, right_text: pd.Series) -> pd.DataFrame:
    """struct<match array<int>, complete>: ``align_page`` of the word arrays of a row."""
    every = zip(left_norm, left_text, right_norm, right_text)
    rows = [align_page((list(a), list(b)), (list(c), list(d))) for a, b, c, d in every]
    return pd.DataFrame({"match": [m for m, _ in rows], "complete": [c for _, c in rows]})


def near_words(words: DataFrame, column: str) -> DataFrame:
    """(a, b), a < b: pairs of distinct words that are ``similar``.

    Two words within d edits agree on one of the d + 1 segments of the longer one, moved by d places at most. So words are joined by
    (length of the longer, segment, its text), not by length alone, and what meets is compared exactly.
    """
    from ..functions.text import similar as near

    w = words.select(F.col(column).alias("w")).where(f"length({column}) between 4 and {LONGEST}").distinct().withColumn("n", F.length("w"))
    start = lambda i: F.floor(i * F.col("L") / (F.floor(F.col("L") / 4) + 1))
    parts = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("L") / 4)))).withColumns({"p": start(F.col("i")), "z": start(F.col("i") + 1)})
    piece = lambda at: F.substring("w", (at + 1).cast("int"), (F.col("z") - F.col("p")).cast("int"))
    long = parts(w.withColumn("L", F.col("n"))).select(F.col("w").alias("b"), "L", "i", piece(F.col("p")).alias("s"))
    lengths = F.filter(F.sequence("n", F.least(F.lit(LONGEST), F.ceil(F.col("n") * 4 / 3).cast("int") + 1)), lambda x: x - F.col("n") <= F.floor(x / 4))
    short = parts(w.withColumn("L", F.explode(lengths)))
    d, last = F.floor(F.col("L") / 4), F.col("n") - (F.col("z") - F.col("p"))
    first, end = F.greatest(F.lit(0), F.col("p") - d), F.least(last, F.col("p") + d)
    moved = short.withColumn("at", F.explode(F.when(first <= end, F.sequence(first, end)))).select(F.col("w").alias("a"), "L", "i", piece(F.col("at")).alias("s")).distinct()
    met = long.join(moved, ["L", "i", "s"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.where(near(F.col("a"), F.col("b")))


def run_hashes(words: list[str], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    return np.unique(mixed).view(np.int64)


def word_runs(words: Column, size: int) -> Column:
    """array<long>: ``run_hashes`` of the word array of a row."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(rows: pd.Series) -> pd.Series:
        return pd.Series([run_hashes(list(r), size) for r in rows])

    return hashes(words)


def align_words(left: DataFrame, right: DataFrame, keys: list[str], budget: int = BUDGET) -> DataFrame:
    """(keys, word_ord, tok_ord, complete): every word of ``left`` with its match in ``right`` (tok_ord, -1 without one).

    Both have word_ord, norm and text. Pages of over 4,000 words on either side are not aligned: tok_ord null, complete false.
    Words without a partner page have no match.
    """
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("word_ord"), b.sort_values("word_ord")
        side = lambda x: (x["norm"].fillna("").tolist(), x["text"].fillna("").tolist())
        found, complete = align_page(side(a), side(b), budget)
        order = b["word_ord"].tolist()
        found = [None] * len(a) if found is None else [order[t] if t >= 0 else -1 for t in found]
        out = pd.DataFrame({"word_ord": a["word_ord"].to_numpy(), "tok_ord": pd.array(found, "Int64"), "complete": complete})
        for k, value in zip(keys, key):
            out.insert(0, k, value)
        return out[[*keys, "word_ord", "tok_ord", "complete"]]

    pick = lambda df: df.select(*keys, F.col("word_ord").cast("long"), "norm", "text").toDF(*keys, "word_ord", "norm", "text")  # noqa: E731  both sides may come from one table
    return pick(left).groupBy(*keys).cogroup(pick(right).groupBy(*keys)).applyInPandas(one, f"{kinds}, word_ord long, tok_ord long, complete boolean")
