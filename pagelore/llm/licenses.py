"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased runs of letters and digits; shingles are five words (for a shorter template, as many as it has). A template
with n shingles belongs to the class of the power of two N with N/2 < n <= N. For that class, every text is covered by windows of
three blocks of S = max(1, N/2) shingles, one window starting at each block, so any run of N shingles lies in one window, and a
template that is there has a Jaccard similarity of at least 1/3 with it. Each of ``bands`` bands is one MinHash value, so a whole
copy is missed with a probability of at most (2/3)^bands, 0.006 % at 24 bands. A copy with 0.8 of a template's shingles has a similarity
of at least 0.8 / 3.2 (the window's other shingles being foreign), so at the edge of what counts at most 0.1 % is missed. Block minima of a class are minima of two blocks of
the class below, so all classes together cost twice the first.

A retrieved template counts if the window, with half a template on either side, holds at least 0.8 of its shingles.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .runs import read, texts

WORD = re.compile(r"[^\W_]+")
SIZE, CONTAINED, BANDS = 5, 0.8, 24
BLOCK = 1 << 17  # shingles that are looked at together
_ODD = np.random.default_rng(5).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        ws = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h = (h ^ h >> np.uint64(31)) * _STEP + words[k : k + n]
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def band_minima(hashes: np.ndarray, bands: int) -> np.ndarray:
    """(bands, n): a MinHash value of each single shingle."""
    return ((hashes[None, :] * _ODD[:bands, None]) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Templates by shingle size, class and band."""

    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS):
        self.bands, self.names, self.sets, self.sizes = bands, [], [], []
        self.classes: dict[int, dict[int, list[int]]] = {}
        hashes = WordHashes()
        for name, text in templates:
            words = hashes.of(text)
            size = min(SIZE, len(words))
            if size:
                own = np.unique(shingles(words, size))
                k = len(self.names)
                self.names.append(name)
                self.sets.append(own)
                self.sizes.append(len(words))
                self.classes.setdefault(size, {}).setdefault(max(0, (len(own) - 1).bit_length()), []).append(k)
        self.tables = {(s, c): self._table(ks) for s, cs in self.classes.items() for c, ks in cs.items()}

    def _table(self, ks: list[int]) -> tuple[np.ndarray, list[dict[int, list[int]]]]:
        """For each band which upper 16 bits occur, and templates by value."""
        bits, values = [], []
        for j in range(self.bands):
            there, by = np.zeros(1 << 16, bool), {}
            for k in ks:
                v = int(band_minima(self.sets[k], self.bands)[j].min())
                there[v >> 16] = True
                by.setdefault(v, []).append(k)
            bits.append(there)
            values.append(by)
        return np.array(bits), values

    def retrieved(self, hashes: np.ndarray, size: int) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of windows that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        n = len(hashes)
        classes = self.classes.get(size, {})
        if not n or not classes:
            return found
        low, step, every = band_minima(hashes, self.bands), 1, np.arange(self.bands)[:, None]
        for c in range(max(classes) + 1):
            if c >= 2:  # blocks of 1, 1, 2, 4, ... shingles
                if low.shape[1] % 2:
                    low = np.concatenate((low, low[:, -1:]), axis=1)
                low, step = np.minimum(low[:, ::2], low[:, 1::2]), step * 2
            if c not in classes:
                continue
            window = low.copy()
            for shift in (1, 2):
                if low.shape[1] > shift:
                    np.minimum(window[:, :-shift], low[:, shift:], out=window[:, :-shift])
            bits, values = self.tables[size, c]
            for j, w in zip(*(x.tolist() for x in np.nonzero(bits[every, window >> np.uint32(16)]))):
                for k in values[j].get(int(window[j, w]), ()):
                    found.add((k, w * step, min(n, (w + 3) * step)))
        return found

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end word, containment) of every occurrence, for texts as word hashes; occurrences of one template don't overlap."""
        spans: dict[tuple[int, int], set[tuple[float, int, int]]] = {}
        overlap = 3 * max((len(x) for x in self.sets), default=1)
        for size in self.classes:
            each = [shingles(words, size) for words in docs]
            hashes, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            found = set()
            for at in range(0, len(hashes), BLOCK):  # long texts in overlapping blocks; windows over two texts are looked at in both
                found |= {(k, a + at, b + at) for k, a, b in self.retrieved(hashes[at : at + BLOCK + overlap], size)}
            for k, a, b in sorted(found):
                own = self.sets[k]
                for doc in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b - 1, side="right")) + 1):
                    begin = int(ends[doc]) - len(each[doc])
                    lo, hi = max(begin, a - len(own) // 2), min(int(ends[doc]), b + len(own) // 2)
                    inside = np.flatnonzero(np.isin(hashes[lo:hi], own))
                    there = hashes[lo:hi][inside].tolist()
                    share = len(set(there)) / len(own)
                    if share >= CONTAINED:
                        first, last = _shortest(there, inside.tolist())
                        spans.setdefault((doc, k), set()).add((share, lo - begin + first, lo - begin + last + size))
        out = []
        for (doc, k), seen in sorted(spans.items()):
            kept: list[tuple[int, int, float]] = []
            for share, a, z in sorted(seen, key=lambda x: (-x[0], x[2] - x[1], x[1])):  # the fullest first, of those the shortest, then the first
                if all(z <= x or a >= y for x, y, _ in kept):
                    kept.append((a, z, share))
            out += [(doc, k, a, z, share) for a, z, share in sorted(kept)]
        return out

    def winners(self, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
        """Without matches that lie, by at least CONTAINED of their words, in a match of another template with more of its shingles there (of equal ones: with more containment, then the first template)."""
        out, weight = [], lambda m: (m[4] * len(self.sets[m[1]]), m[4], -m[1])
        for _, group in groupby(found, key=lambda m: m[0]):
            group = sorted(group, key=lambda m: m[2])
            starts, longest = [m[2] for m in group], max(m[3] - m[2] for m in group)
            kept = []
            for m in group:
                near = group[bisect_left(starts, m[2] - longest) : bisect_left(starts, m[3])]
                if not any(o[1] != m[1] and min(o[3], m[3]) - max(o[2], m[2]) >= CONTAINED * (m[3] - m[2]) and weight(o) > weight(m) for o in near):
                    kept.append(m)
            out += sorted(kept, key=lambda m: (m[1], m[2]))
        return out


def _shortest(items: list[int], at: list[int]) -> tuple[int, int]:
    """First and last place of the shortest stretch that has all distinct items."""
    wanted, counts, begin, best = len(set(items)), {}, 0, (at[0], at[-1])
    for k, item in enumerate(items):
        counts[item] = counts.get(item, 0) + 1
        while counts[items[begin]] > 1:
            counts[items[begin]] -= 1
            begin += 1
        if len(counts) == wanted and at[k] - at[begin] < best[1] - best[0]:
            best = (at[begin], at[k])
    return best


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(doc_id, license, template int, start long, end long, containment double): a row for each occurrence of a template in a document.

    start and end are code points of the text around the matching shingles. A match inside one of another template with more shingles
    there is left out, so a licence that quotes another counts once (``Index.winners``, with its ties). Null and empty texts hold
    nothing; repeated rows and rows with a null id are each scanned; very long texts are taken in overlapping blocks; other columns are
    ignored; templates without words are, too. An empty table gives no rows. ``templates``: (name, text); the bundled ones by default.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(templates, bands), WordHashes()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())

        def out(held: list[tuple[int | None, str, np.ndarray]]) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], [], []]
            for at, k, a, z, share in index.winners(index.matches([words for _, _, words in held])):
                doc, text, _ = held[at]
                spans = _spans(text)
                for column, value in zip(rows, (doc, index.names[k], k, spans[a][0], spans[z - 1][1], share)):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["doc_id", "license", "template", "start", "end", "containment"])

        held, waiting = [], 0
        for b in batches:
            for doc, text in zip(b.column(0), texts(b.column(1))):
                if text:
                    held.append((doc.as_py(), text, words := hashes.of(text)))
                    waiting += len(words)
                if waiting >= BLOCK:
                    yield out(held)
                    held, waiting = [], 0
        if held:
            yield out(held)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, license string, template int, start long, end long, containment double")


def _spans(text: str) -> list[tuple[int, int]]:
    """Word spans in the text as it is, where lower-casing may have changed lengths."""
    if text.isascii():
        return [m.span() for m in WORD.finditer(text)]
    lowered = [c.lower() for c in text]
    if all(len(c) == 1 for c in lowered):
        return [m.span() for m in WORD.finditer(text.lower())]
    at = np.repeat(np.arange(len(text)), [len(c) for c in lowered])
    return [(int(at[m.start()]), int(at[m.end() - 1]) + 1) for m in WORD.finditer("".join(lowered))]


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
