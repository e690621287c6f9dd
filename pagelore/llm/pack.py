"""Packing of token sequences by bin completion, over the histogram of piece lengths.

Documents become token pieces of at most ``capacity`` tokens. All that the search needs is how many pieces each length has: at
most ``capacity`` numbers, whatever the size of the corpus. The search (on the driver) places fillings by the number of times
that they can be used at once, so its result is bounded too: every step uses up at least one length or all the waste that is
allowed. Pieces then find their place by their rank among the pieces of their length; ranks come from counts by (length, bucket), so a length that a third of
all pieces share is dealt over many tasks.

Bin completion: the largest piece left opens a bin; its undominated fillings are tried in the order of their waste. A filling is
not made that wastes more than the best packing known allows, and a branch is left when its waste, or a lower bound of the bins
that the rest needs, shows that it can't beat that packing. The first packing known is best-fit decreasing; at the nodes of the
search the rest is completed by best fit, and if that is better it becomes the best one known. The search is bounded by nodes, by steps of
an enumeration and by fillings tried at a node, so it is no proof of optimality unless the bins reach the lower bound; what is
packed is never cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import fresh, in_arrow, read, texts, worker_keeps
from .store import written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
Pattern = tuple[tuple[int, int], ...]  # (length, times in the bin)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer makes its parts; any other one is given whole texts.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Latin-1 in lower case, and the kinds of its characters there: white space, letters, numbers, others.
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_SPACES = re.compile(b"[\t-\r \x85\xa0]")
_KINDS = bytes(_SPACE if _SPACES.match(c.encode("latin-1")) else _LETTER if c.isalpha() else _NUMBER if re.match("[0-9\xb2\xb3\xb9\xbc-\xbe]", c) else _OTHER for c in map(chr, _LOWER))


class Chunks(dict):
    """Parts of texts to the bytes of their token ids; a text's ids are those of its parts.

    In Latin-1 the parts are the tokenizer's own (nothing there changes under NFC, and letters have one lower case). They are cut and
    told apart for a block of texts at once, so Python sees each different part of a block once, and those that are new go to
    the tokenizer in one call. Any other text, or one that may hold a special token, is taken in chunks between spaces: the tokenizer
    drops white space, and nothing it does reaches across it. Only short parts are kept, up to a bounded number: when ``most`` are
    reached they become the old ones, of which those still in use come back.
    """

    def __init__(self, path: str, most: int = 230_000, block: int = 1 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.block, self.old = Tokenizer.from_file(path), most, block, {}
        made = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.known = made == [_NORMAL, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}]
        if self.known:  # for parts, which have been normalized and split
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab, suffix = self.bare.get_vocab(), getattr(self.bare.model, "end_of_word_suffix", None)
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a part
            if suffix:
                self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    @classmethod
    def of_worker(cls, path: str) -> Chunks:
        """The Python worker's own, which its later tasks use again until one of another kind comes."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        if path not in (own := worker_keeps()):
            own[path] = cls(path)
        return own[path]

    def __missing__(self, part: str) -> bytes:
        if part in self.old:
            self[part] = ids = self.old[part]
            return ids
        ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= 40:
            self[part] = ids
        return ids

    def _turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of new parts, from one call."""
        text = b" ".join(parts).decode("latin-1")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):  # the ids don't tell
            got = self.bare.encode(text, add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            ends = np.searchsorted(np.array(got.word_ids), np.arange(1, len(parts) + 1))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        self.update((part, x) for part, x in zip(parts, out) if len(part) <= 40)
        return out

    def _of_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different parts."""
        out = list(map(self.get, parts))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := self.old.get(parts[i])) is None:
                new.append(i)
            else:
                out[i] = self[parts[i]] = x
        for i, x in zip(new, self.learn([parts[i] for i in new]) if new else ()):
            out[i] = x
        return out

    def _of_block(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts in Latin-1."""
        self._turn()
        joined = (b" ".join(raw) + b"    ").translate(_LOWER)
        chars, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
        first = kinds == _NUMBER  # a part begins there
        first[0] = True
        first[1:] |= kinds[1:] != kinds[:-1]
        quotes = np.flatnonzero(chars == ord("'"))
        quotes = quotes[first[quotes] & (kinds[quotes + 1] == _LETTER)]
        a, b = chars[quotes + 1], chars[quotes + 2]
        one = np.isin(a, list(b"stmd"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, n in ((quotes[one], 1), (quotes[two], 2)):  # the quote takes these letters, and those after them are a part
            first[at + 1] = False
            first[at + 1 + n] |= kinds[at + 1 + n] == _LETTER
        held = kinds != _SPACE
        first &= held
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])[:-1]
        ends = np.cumsum(np.add.reduceat(first, begins, dtype=np.int64))  # parts up to each text's end
        if not ends[-1]:
            return [b""] * len(raw)
        body = chars[held]
        offsets = np.append(np.flatnonzero(first[held]), len(body)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        ids = pa.array(self._of_parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[ids.offset :][ends].tolist()
        data = memoryview(data)
        return [bytes(data[a:b]) for a, b in zip([0, *ends], ends)]

    def _cuts(self, raw: bytes) -> Iterator[bytes]:
        """A text in pieces of about a block, cut at white space."""
        at = 0
        while at < len(raw):
            space = _SPACES.search(raw, at + self.block)
            end = space.start() if space else len(raw)
            yield raw[at:end]
            at = end

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; those of about a block are held."""
        out: list[bytes | None] = []
        raw: list[bytes] = []
        size = 0

        def done() -> Iterator[bytes]:
            made = iter(self._of_block(raw) if raw else ())
            return (next(made) if x is None else x for x in out)

        for text in texts:
            latin = None
            if text and self.known:
                try:
                    latin = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if not text:
                out.append(b"")
            elif not self.known:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif latin is None or b"<|" in latin:
                self._turn()
                out.append(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))))
            elif len(latin) > self.block:
                out.append(b"".join(self._of_block([x])[0] for x in self._cuts(latin)))
            else:
                out.append(None)
                raw.append(latin)
            size += len(text or "")
            if size >= self.block or len(out) >= 4096:
                yield from done()
                out, raw, size = [], [], 0
        yield from done()

    def ids(self, text: str | None) -> bytes:
        return next(self.many([text]))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids array<int>]): each document's ids, then ``end_id``, cut into pieces.

    A null or empty text has the end id alone. Ids are of the whole text. ``ids=False`` leaves the ids themselves out.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = Chunks.of_worker(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, found in zip(b.column(0), chunks.many(texts(b.column(1)))):
                data = memoryview(found + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    held += 1
                    for column, value in zip(rows, (doc.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if ids else None)):
                        column.append(value)
                if held >= 4096:
                    yield batch(rows)
                    rows, held = [[], [], [], [], [], []], 0
            if held:
                yield batch(rows)

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)][: 5 + ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, path)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs. counts[n]: pieces of length n."""
    at = np.arange(capacity + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * at)
    k = np.arange(capacity // 2 + 1)
    large = n[-1] - n[capacity - k]
    half_n, half_s = n[capacity - k] - n[capacity // 2], s[capacity - k] - s[capacity // 2]
    small = s[capacity // 2] - np.where(k > 0, s[np.maximum(k - 1, 0)], 0)
    return int((large + half_n + np.maximum(0, -((half_n * capacity - half_s - small) // capacity))).max(initial=0))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over lengths with counts: (pattern, bins of that pattern)."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # those of bins, sorted

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, (), -(-left // (capacity // length)))
                continue
            room = rooms[at]
            pattern, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            fits = room // length  # the bin stays the fullest that fits as long as it fits
            whole = min(times, left // fits)
            if whole:
                put(room - fits * length, (*pattern, (length, fits)), whole)
                left -= whole * fits
            if whole < times and left:  # one more, in part
                part = min(fits, left)
                put(room - part * length, (*pattern, (length, part)), 1)
                left -= part
                whole += 1
            if whole < times and pattern:
                put(room, pattern, times - whole)
    return [(p, n) for group in bins.values() for p, n in group if p]


def fillings(counts: np.ndarray, room: int, most_waste: int, steps: int, wanted: int) -> list[list[int]]:
    """Undominated fillings of the room from what is left, the least waste first; none wastes more than most_waste."""
    below = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0)).tolist()
    stock, used, found, left_steps, exact = counts, {}, [], steps, 0

    def more(top: int, room: int, chosen: list[int]) -> None:
        nonlocal left_steps, exact
        left_steps -= 1
        b = below[min(top, room)]
        if b and b == room and stock[b] > used.get(b, 0):  # fills it
            found.append((0, [*chosen, b]))
            exact += 1
            return
        fitted = False
        while b and left_steps > 0 and exact < wanted:
            if stock[b] > used.get(b, 0):
                fitted = True
                used[b] = used.get(b, 0) + 1
                more(b, room - b, [*chosen, b])
                used[b] -= 1
            b = below[b - 1]
        if not fitted and room <= most_waste:
            found.append((room, chosen))

    more(room, room, [])
    out: list[list[int]] = []
    for waste, chosen in sorted(found, key=lambda x: (x[0], len(x[1])))[: 4 * wanted]:  # an undominated one is among those of least waste
        own = {b: chosen.count(b) for b in chosen}
        free = lambda b: stock[b] > own.get(b, 0)
        ends = sorted(own)
        dominated = any(below[min(a + waste, len(below) - 1)] > a and free(below[a + waste]) for a in ends) if waste else False
        for k, a in enumerate(chosen):
            for b in chosen[k + 1 :]:
                if dominated:
                    break
                c = below[min(a + b + waste, len(below) - 1)]
                dominated = c >= a + b and free(c)  # one piece in place of two leaves smaller pieces for later
        if not dominated:
            out.append(chosen)
        if len(out) >= wanted:
            break
    return out


def complete(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = 6000, steps: int = 1500, wanted: int = 4, work: int = 60_000) -> list[tuple[Pattern, int]]:
    """Bin completion: (pattern, bins of that pattern) for all pieces. nodes, steps, wanted and work (lengths in best-fit completions) bound the search, not what is packed."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    stack: list[tuple[np.ndarray, int, int, list, Iterator[list[int]] | None]] = [(counts.copy(), 0, 0, [], None)]
    path: list[tuple[Pattern, int]] = []
    while stack and nodes > 0 and bins > bound:
        left, used, waste, taken, tries = stack.pop()
        path = taken
        if tries is None:
            nodes -= 1
            lengths = np.flatnonzero(left)
            if not len(lengths):
                if used < bins:
                    best, bins = _patterns(path), used
                continue
            spare = (bins - 1) * capacity - total - waste
            if spare < 0 or used + lower_bound(left, capacity) >= bins:
                continue
            if taken and work > 0:  # the rest by best fit
                work -= len(lengths)
                rest_fit = best_fit(left, capacity)
                if (n := used + sum(t for _, t in rest_fit)) < bins:
                    best, bins = _patterns(path) + rest_fit, n
                    if bins <= bound:
                        break
                    spare = (bins - 1) * capacity - total - waste
            top = int(lengths[-1])
            rest = left.copy()
            rest[top] -= 1
            tries = iter(fillings(rest, capacity - top, spare, steps, wanted))
        else:
            top = int(np.flatnonzero(left)[-1])
        if (filling := next(tries, None)) is None:
            continue
        stack.append((left, used, waste, taken, tries))
        own: dict[int, int] = {}
        for b in (top, *filling):
            own[b] = own.get(b, 0) + 1
        empty = capacity - top - sum(filling)
        times = min(int(left[b]) // n for b, n in own.items())
        if empty:  # no more often than the waste allows, so that another filling can follow
            spare = (bins - 1) * capacity - total - waste
            times = max(1, min(times, spare // empty))
        rest = left.copy()
        for b, n in own.items():
            rest[b] -= n * times
        stack.append((rest, used + times, waste + empty * times, (taken, (tuple(own.items()), times)), None))
    return best


def _patterns(path) -> list[tuple[Pattern, int]]:
    out = []
    while path:
        path, last = path
        out.append(last)
    return out[::-1]


def _places(plan: list[tuple[Pattern, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by (length, rank): where ranks begin, pieces of the length in a bin, first sequence, offset."""
    ranks, rows, sequence = [0] * (capacity + 1), [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern:
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(table.T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to capacity, any others) with sequence_id and offset (in tokens, gapless from 0 in each sequence).

    Columns of those two names are replaced. Repeated rows are packed as often as they come; ids may be null, many alike. Pieces of one
    length are told apart by chance, so which of them goes where isn't defined; the number of sequences is. No pieces give no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    dealt, bucket, n, begin, rank = fresh(pieces.columns, "dealt", "bucket", "n", "begin", "rank")
    # dealt by chance and written, so that neither a common id nor repeated rows gather, and every later reading sees the same
    pieces = written(pieces.withColumn(dealt, F.floor(F.rand() * (1 << 52))))
    buckets = max(64, pieces.count() // 50_000)
    put = pieces.withColumn(bucket, F.pmod(F.col(dealt), F.lit(buckets)))
    pieces = pieces.drop(dealt)
    counts = written(put.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n)))
    hist = np.zeros(capacity + 1, np.int64)
    for length, many in counts.groupBy("length").agg(F.sum(n)).collect():  # at most ``capacity`` rows
        hist[length] = many
    length_, rank_, each, first, at = _places(complete(hist, capacity), capacity)
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(begin))
    ranked = put.withColumn(rank, F.row_number().over(Window.partitionBy("length", bucket).orderBy(dealt)))
    ranked = ranked.join(starts, ["length", bucket]).withColumn(rank, F.col(begin) + F.col(rank) - 1).select(*pieces.columns, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 48
        keys = length_ * shift + rank_
        for b in batches:
            length, at_rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", rank))
            k = np.searchsorted(keys, length * shift + at_rank, side="right") - 1
            over = at_rank - rank_[k]
            where = {"sequence_id": first[k] + over // each[k], "offset": at[k] + over % each[k] * length}
            kept = [i for i, f in enumerate(b.schema) if f.name != rank]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *map(pa.array, where.values())], names=[*(b.schema.field(i).name for i in kept), *where])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return in_arrow(ranked, place, schema)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read(spark, sf_dir, "documents"), ids=False))
