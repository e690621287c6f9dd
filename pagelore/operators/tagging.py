"""A page's HTML put on its drawn words: the whole page pipeline over logical tables.

A page is one row, its drawn words an array, so all its steps run where it is, in one Arrow function, without a shuffle: structure of the
HTML, tokens of the page (hyphens joined), alignment, run-together words and marks, places of all words, parts of shared words,
furniture, lost words in runs, counters and warnings.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import placement
from .align import BUDGET, MOST_WORDS, align_page
from .structure import Page, norm

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PLACED = f"word_ord long, node_id long, text string, tok_ord long, box {BOX}, baseline double, size double, part array<int>"
LOST = f"after_block int, run int, words array<string>, boxes array<{BOX}>"
REPORT = "text_source string, words long, matched long, added_from_html long, furniture long, lost long, unmapped long, complete boolean"
#: A word without a place is as wide as so many of its sizes a character.
WIDE = 0.5


def tokens_of(words: list[dict]) -> list[list[int]]:
    """Places of the drawn words of each token: a word that ends in a letter and a hyphen goes with a lower-case word on a lower line."""
    out: list[list[int]] = []
    k = 0
    while k < len(words):
        a, b = words[k], words[k + 1] if k + 1 < len(words) else None
        broken = b is not None and len(a["text"]) > 1 and a["text"][-1] == "-" and a["text"][-2].isalpha() and b["text"][:1].islower()
        joined = broken and b["box"]["y0"] > (a["box"]["y0"] + a["box"]["y1"]) / 2
        out.append([k, k + 1] if joined else [k])
        k += 1 + joined
    return out


def token_text(words: list[dict], token: list[int]) -> str:
    return words[token[0]]["text"][:-1] + words[token[1]]["text"] if len(token) > 1 else words[token[0]]["text"]


def _corners(b: dict) -> tuple[float, float, float, float]:
    return b["x0"], b["y0"], b["x1"], b["y1"]


class Drawn:
    """A page's own words: tokens, and which words are at an edge, the page's number, or inside a form field."""

    def __init__(self, words: list[dict], number: int, width: float, height: float, fields: list[dict]):
        inside = [_corners(f) for f in fields]
        self.words = [w for w in words if not any(self._in(f, _corners(w["box"])) for f in inside)]
        self.number, self.width, self.height = str(number), width, height
        self.tokens = tokens_of(self.words)
        self.shown = ["".join(self.words[k]["text"] for k in t) for t in self.tokens]
        self.norms = [norm(token_text(self.words, t)) for t in self.tokens]

    @staticmethod
    def _in(field: tuple, box: tuple, share: float = 0.5) -> bool:
        wide, high = min(field[2], box[2]) - max(field[0], box[0]), min(field[3], box[3]) - max(field[1], box[1])
        return wide > 0 and high > 0 and wide * high >= max(0, box[2] - box[0]) * max(0, box[3] - box[1]) * share

    def at_edge(self, k: int) -> bool:
        box = self.words[k]["box"]
        return box["y1"] <= self.height * 0.1 or box["y0"] >= self.height * 0.9

    def is_number(self, k: int) -> bool:
        return norm(self.words[k]["text"]) == self.number and self.at_edge(k)

    def is_furniture(self, k: int) -> bool:
        return norm(self.words[k]["text"]) in ("", self.number) or self.at_edge(k)

    def place(self, token: int) -> dict:
        """Where a token's first word is, clamped to the page's sides."""
        w = self.words[self.tokens[token][0]]
        box = w["box"]
        return {"box": (max(box["x0"], 0.0), box["y0"], min(box["x1"], self.width), box["y1"]), "baseline": w["baseline"], "size": w["size"]}


def _shared(place: dict, norms: list[str]) -> list[dict]:
    """A token's place dealt among the HTML words on it, by their lengths."""
    if len(norms) < 2:
        return [place]
    x0, y0, x1, y1 = place["box"]
    total, out, done = sum(map(len, norms)) or 1, [], 0
    for w in norms:
        a, done = done, done + len(w)
        out.append(place | {"box": (x0 + (x1 - x0) * a / total, y0, x0 + (x1 - x0) * done / total, y1)})
    return out


def tag_page(html: str, number: int, drawn: Drawn, lang: str = "en", shift: int = 0, prefix: str = "", width: Callable[[str], float] = lambda s: WIDE * len(s), budget: int = BUDGET) -> dict:
    """The page's nodes, its words with their places, lost runs, report and warnings.

    Over MOST_WORDS words on either side nothing is aligned: one error, ``too_many_words``, and no words.
    """
    page = Page(html, lang, prefix, shift)
    nodes, words = page.rows()
    warnings = [{"code": c, "detail": d} for c, d in page.warnings]
    unmapped = sum(w["text"].count("\N{REPLACEMENT CHARACTER}") for w in drawn.words)
    if unmapped:
        warnings.append({"code": "unmapped_glyph", "detail": f"{unmapped} characters of the page's own text have no Unicode value."})
    report = {"text_source": "pdf-text" if drawn.words else "none", "words": len(drawn.words), "matched": 0, "added_from_html": 0, "furniture": 0, "lost": 0, "unmapped": unmapped, "complete": True}
    out = {"nodes": nodes, "placed": [], "lost": [], "report": report, "warnings": warnings}
    match, complete = align_page(([w["norm"] for w in words], [w["text"] for w in words]), (drawn.norms, drawn.shown), budget)
    if match is None:
        warnings.append({"code": "too_many_words", "detail": f"Page {number} has more than {MOST_WORDS} words."})
        return out | {"report": report | {"complete": False}}
    if words and not drawn.words:
        report["text_source"] = "approximate"
        warnings.append({"code": "no_text_positions", "detail": "The page has no words of its own; those of the HTML are placed approximately."})
    if not complete:
        report["complete"] = False
        warnings.append({"code": "alignment_incomplete", "detail": "The page and the HTML differ too much to match every word in time."})
    # the page's number is left out of the HTML, so a word matched to it is another one
    match = [-1 if t >= 0 and any(map(drawn.is_number, drawn.tokens[t])) else t for t in match]

    on: dict[int, list[int]] = {}
    for k, t in enumerate(match):
        if t >= 0:
            on.setdefault(t, []).append(k)
    report["matched"] = sum(map(len, on.values()))
    report["added_from_html"] = sum(t < 0 and bool(w["norm"]) for t, w in zip(match, words))
    places: dict[int, dict] = {}
    parts: dict[int, list[int]] = {}
    for t, ks in on.items():
        places |= dict(zip(ks, _shared(drawn.place(t), [words[k]["norm"] for k in ks])))
        if len(drawn.tokens[t]) == 1:  # which characters of the drawn word each HTML word is
            free = {j: words[j]["text"] for j in range(max(0, ks[0] - 8), min(len(words), ks[-1] + 9)) if j in ks or match[j] < 0}
            for j, a, z in placement.spread(list(drawn.shown[t]), free, ks[0], ks[-1]) or ():
                parts[j] = [a, z]
    flowing = [{"text": w["text"], "space": w["space"], **places.get(k, {})} for k, w in enumerate(words)]
    breaks = {k for k, w in enumerate(words) if k and w["new_line"]} if not drawn.words else set()
    for k, (w, at) in enumerate(zip(words, placement.flow(flowing, (0.0, 0.0, drawn.width, drawn.height), width, breaks))):
        box = dict(zip(("x0", "y0", "x1", "y1"), map(float, at["box"])))
        out["placed"].append({"word_ord": k, "node_id": w["node_id"], "text": w["text"], "tok_ord": match[k] if match[k] >= 0 else None, "box": box, "baseline": float(at["baseline"]), "size": float(at["size"]), "part": parts.get(k)})

    block, runs = -1, []
    fresh = True
    for t, own in enumerate(drawn.tokens):
        if t in on:
            block, fresh = words[on[t][-1]]["block"], True
            continue
        for k in own:
            if drawn.is_furniture(k):
                report["furniture"] += 1
                continue
            report["lost"] += 1
            if fresh:
                runs.append({"after_block": block, "run": len(runs), "words": [], "boxes": []})
                fresh = False
            runs[-1]["words"].append(drawn.words[k]["text"])
            runs[-1]["boxes"].append(drawn.words[k]["box"])
    out["lost"] = runs
    for at in dict.fromkeys(r["after_block"] for r in runs):
        warnings.append({"code": "unmatched_text", "detail": " / ".join(" ".join(r["words"]) for r in runs if r["after_block"] == at)})
    return out


def tag_pages(pages: DataFrame, *keys: str, lang: str | None = None, shift: str | None = None, budget: int = BUDGET) -> DataFrame:
    """(keys, page, nodes, placed, lost, report, warnings): each page's HTML put on its drawn words.

    pages: page, html, width, height, words array<struct<text, box, baseline, size>> in reading order, and, if it has one, fields, the
    boxes of form fields, whose words are theirs. lang, shift: columns with the document's language and heading shift. placed: every
    HTML word with its place, tok_ord (the page's token that it matched) and part (its characters of a drawn word). lost: words that
    the HTML lacks, in runs, after the top-level block that they follow (-1: before all). A null HTML or null words count as none.
    """
    from .structure import NODE, WARNING

    kept = [f for f in pages.schema if f.name in (*keys, "page")]
    made = T.StructType([
        T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(NODE))),
        T.StructField("placed", T.ArrayType(T.StructType.fromDDL(PLACED))),
        T.StructField("lost", T.ArrayType(T.StructType.fromDDL(LOST))),
        T.StructField("report", T.StructType.fromDDL(REPORT)),
        T.StructField("warnings", T.ArrayType(T.StructType.fromDDL(WARNING))),
    ])
    arrow = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                rows = []
                for r in part.select(["page", "__html", "__width", "__height", "__words", "__fields", "__lang", "__shift"]).to_pylist():
                    drawn = Drawn(r["__words"] or [], r["page"], r["__width"], r["__height"], r["__fields"] or [])
                    rows.append(tag_page(r["__html"] or "", r["page"], drawn, r["__lang"] or "en", r["__shift"] or 0, f"p{r['page']}-", budget=budget))
                arrays = [pa.array([row[f.name] for row in rows], t) for f, t in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], names=[*(f.name for f in kept), *made.names])

    fields = F.col("fields") if "fields" in pages.columns else F.array().cast(f"array<{BOX}>")
    rest = (F.col("html"), F.col("width").cast("double"), F.col("height").cast("double"), F.col("words"), fields, F.col(lang) if lang else F.lit("en"), F.col(shift).cast("int") if shift else F.lit(0))
    names = ("__html", "__width", "__height", "__words", "__fields", "__lang", "__shift")
    return pages.select(*(f.name for f in kept), *(c.alias(n) for c, n in zip(rest, names))).mapInArrow(run, T.StructType([*kept, *made]))


def elements(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, element, parent, ord, type, elem_id, alt, lang, href): a page's elements in reading order, numbered from 1.

    Nodes of the HTML and, after the top-level block that each follows, the runs of lost words as paragraphs. parent is 0 for those at
    the top.
    """
    own = F.transform("nodes", lambda n: F.struct(n["block"].alias("block"), F.lit(0).alias("kind"), n["node_id"].cast("int").alias("n"), n["parent_id"].cast("int").alias("up"), n["type"].alias("type"), *(n[c].alias(c) for c in ("elem_id", "alt", "lang", "href"))))
    none = F.lit(None).cast("string")
    left = F.transform("lost", lambda r: F.struct(r["after_block"].alias("block"), F.lit(1).alias("kind"), r["run"].alias("n"), F.lit(0).alias("up"), F.lit("P").alias("type"), *(none.alias(c) for c in ("elem_id", "alt", "lang", "href"))))
    ordered = tagged.select(*keys, "page", F.array_sort(F.concat(own, left)).alias("e"))
    # where each node is now; parents are looked up before the array becomes rows
    numbers = F.map_from_entries(F.filter(F.transform("e", lambda y, i: F.when(y["kind"] == 0, F.struct(y["n"].alias("key"), (i + 1).alias("value")))), lambda x: x.isNotNull()))
    placed = F.transform("e", lambda y, i: y.withField("element", i + 1).withField("parent", F.coalesce(F.try_element_at("m", y["up"]), F.lit(0))))
    rows = ordered.withColumn("m", numbers).select(*keys, "page", F.explode(placed).alias("x"))
    return rows.select(*keys, "page", *(F.col(f"x.{c}").alias(c) for c in ("element", "parent")), F.col("x.kind").alias("lost"), *(F.col(f"x.{c}").alias(c) for c in ("n", "type", "elem_id", "alt", "lang", "href")))


def marked_content(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, mcid, element, text, box): what each element draws itself, numbered from 0 on its page in the order of its elements.

    Sorted by page and mcid this is the parent tree. Elements without words have no number.
    """
    words = tagged.select(*keys, "page", F.inline("placed")).groupBy(*keys, "page", F.lit(0).alias("lost"), F.col("node_id").cast("int").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("word_ord", "text", "box")))
    own = words.agg(listed.alias("w")).select(*keys, "page", "lost", "n", F.transform("w", lambda x: x["text"]).alias("words"), F.transform("w", lambda x: x["box"]).alias("boxes"))
    left = tagged.select(*keys, "page", F.inline("lost")).select(*keys, "page", F.lit(1).alias("lost"), F.col("run").alias("n"), "words", "boxes")
    found = elements(tagged, *keys).select(*keys, "page", "element", "lost", "n").join(own.unionByName(left), [*keys, "page", "lost", "n"])
    side = lambda c, f: f(F.transform("boxes", lambda b: b[c])).alias(c)
    box = F.struct(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
    mcid = F.row_number().over(Window.partitionBy(*keys, "page").orderBy("element")) - 1
    return found.select(*keys, "page", mcid.alias("mcid"), "element", F.array_join("words", " ").alias("text"), box.alias("box"))


def id_tree(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, elem_id, page, element): elements with an id, in the order of their ids' code points, from 0; of equal ids the first element."""
    named = elements(tagged, *keys).where("elem_id is not null").groupBy(*keys, "elem_id").agg(F.min(F.struct("page", "element")).alias("e"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("elem_id")) - 1
    return named.select(*keys, at.alias("ord"), "elem_id", "e.page", "e.element")
