"""Where words of the HTML go on the page: parts of one drawn word, places by flow, and owners of character codes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame

from .rows import per_row


def _plain(s: str) -> str:
    return "".join(unicodedata.normalize("NFKC", s).split())


def _mark(c: str) -> bool:
    return all(unicodedata.category(x)[0] not in "LN" for x in c)


def _eaten(drawn: list[str], at: int, word: str) -> int | None:
    """Where the word ends if the drawn characters from ``at`` spell it."""
    want, got = _plain(word), ""
    while at < len(drawn) and len(got) < len(want):
        got += _plain(drawn[at])
        at += 1
        if not want.startswith(got):
            return None
    return at if want and got == want else None


def spread(drawn: list[str], words: dict[int, str], low: int, high: int) -> list[tuple[int, int, int]] | None:
    """(word, first character, end) of the HTML words that one drawn word holds, or None.

    words: the texts of unmatched words and of low..high, which have to be there in order; before one of them punctuation may be
    skipped. Unmatched neighbours to the right, then to the left, may take the rest. What no word takes has to be punctuation.
    """
    out: list[tuple[int, int, int]] = []
    at = 0
    for j in range(low, high + 1):
        if j not in words:
            return None
        begin, end = at, _eaten(drawn, at, words[j])
        while end is None and begin < len(drawn) and _mark(drawn[begin]):
            begin += 1
            end = _eaten(drawn, begin, words[j])
        if end is None:
            return None
        out.append((j, begin, end))
        at = end
    first, j = out[0][1], high + 1
    while j in words and (end := _eaten(drawn, at, words[j])) is not None:
        out.append((j, at, end))
        at, j = end, j + 1
    j = low - 1
    while j in words and (begin := first - len(_plain(words[j]))) >= 0 and "".join(map(_plain, drawn[begin:first])) == _plain(words[j]):
        out.append((j, begin, first))
        first, j = begin, j - 1
    return out if all(map(_mark, drawn[:first] + drawn[at:])) else None


def flow(words: list[dict], page: tuple[float, float, float, float], width: Callable[[str], float], breaks: set[int]) -> list[dict]:
    """Places for words that have none: each follows the word before it at its natural width, and wraps at the page's edge.

    words: dicts with text, space and, if placed, box, baseline and size. breaks: places in the list where a new line starts.
    """
    left, top, right, bottom = page
    anchor = next((w for w in words if w.get("box")), {"box": (left + 10, top + 10, left + 10, top + 20), "baseline": top + 20, "size": 10.0})
    out: list[dict] = []
    for k, w in enumerate(words):
        if not w.get("box"):
            before = out[-1] if out else anchor
            size, line = before["size"], before["size"] * 1.2
            wide = min(width(w["text"]) * size, right - left - 2)
            x = before["box"][2] + (width(" ") * size if before.get("space", True) else 0) if out else anchor["box"][0]
            down = 0.0
            if k in breaks or x + wide > right - 1:
                x = anchor["box"][0] if k in breaks and anchor["box"][0] + wide <= right - 1 else left + 1
                down = line if before["box"][3] + line <= bottom else top + line - before["box"][3]
            w = w | {"box": (x, before["box"][1] + down, x + wide, before["box"][3] + down), "baseline": before["baseline"] + down, "size": size}
        out.append(w)
    return out


def segments(runs: list[list[int]], codes: dict[int, list[int]], alone: set[int], text_objects: list[int], inked: set[int], shown: set[int] | None = None) -> tuple[dict[int, int], set[int]]:
    """(segment of each code, words that keep their codes).

    runs: word ids of each run; codes: each word's code ids, from 1; alone: words that own their codes by themselves; text_objects:
    the text object of each code; inked: codes that draw something; shown: words with text (all by default). Words of a run share one
    owner until a word with text but no codes parts them. Codes that two owners claim take both words' codes away, until none is
    left. Codes without an owner or ink between two codes of one owner in one text object are that owner's.
    """
    codes = dict(codes)
    while True:
        owner: dict[int, tuple] = {}
        contested: set[int] = set()
        for r, run in enumerate(runs):
            part, parted = 0, False
            for w in run:
                if w not in codes:
                    parted |= shown is None or w in shown
                    continue
                part, parted = part + parted, False
                mine = ("word", w) if w in alone else ("run", r, part)
                for c in codes[w]:
                    if owner.setdefault(c, mine) != mine:
                        contested.add(c)
        if not contested:
            break
        codes = {w: cs for w, cs in codes.items() if not contested.intersection(cs)}
    segment: dict[int, int] = {}
    n, before, waiting = 0, None, []
    for c, obj in enumerate(text_objects, 1):
        mine = owner.get(c)
        if before and before[1] != obj or mine is None and c in inked:
            before, waiting = None, []
        if mine is None:
            waiting += [c] if before else []
            continue
        if before and before[0] == mine:
            segment |= dict.fromkeys(waiting, n)
        else:
            n += 1
        segment[c] = n
        before, waiting = (mine, obj), []
    return segment, set(codes)


def flow_words(pages: DataFrame, *keys: str, wide: float = 0.5) -> DataFrame:
    """(keys, word_ord, box, baseline, size): a place for every word of a page; those without one follow the word before.

    pages: width, height, words array<struct<text, space, new_line, box, baseline, size>> in reading order, box null where there is
    none. A character is ``wide`` of its size. New lines count only on a page where no word has a place.
    """

    def places(width, height, words):
        words = words or []
        flat = [{"text": w["text"], "space": w["space"], **({"box": tuple(w["box"][c] for c in ("x0", "y0", "x1", "y1")), "baseline": w["baseline"], "size": w["size"]} if w["box"] else {})} for w in words]
        breaks = {k for k, w in enumerate(words) if k and w["new_line"]} if not any("box" in w for w in flat) else set()
        out = flow(flat, (0.0, 0.0, width, height), lambda s: wide * len(s), breaks)
        return [(k, dict(zip(("x0", "y0", "x1", "y1"), map(float, w["box"]))), float(w["baseline"]), float(w["size"])) for k, w in enumerate(out)]

    return per_row(pages, list(keys), ["width", "height", "words"], places, "word_ord int, box struct<x0:double,y0:double,x1:double,y1:double>, baseline double, size double")


def drawn_parts(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, word_ord, first, end): the characters of a drawn word that each HTML word is; no rows if they can't be told apart.

    tokens: drawn string, words array<struct<word_ord, text>> (its own and unmatched ones beside them), low and high, its own.
    """

    def parts(drawn, words, low, high):
        return spread(list(drawn or ""), {w["word_ord"]: w["text"] for w in words or []}, low, high) or []

    return per_row(tokens, list(keys), ["drawn", "words", "low", "high"], parts, "word_ord int, first int, end int")


def code_segments(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, code, segment): the marked-content sequence that each character code of a page goes into.

    pages: runs array<array<int>> of word ids, codes map<int, array<int>> of words that own some (from 1), alone array<int>, objects
    array<int> (the text object of each code) and inked array<int>.
    """

    def owned(runs, codes, alone, objects, inked):
        codes = dict(codes or [])
        found, _ = segments(runs or [], codes, set(alone or []), objects or [], set(inked or []))
        return sorted(found.items())

    return per_row(pages, list(keys), ["runs", "codes", "alone", "objects", "inked"], owned, "code int, segment int")
