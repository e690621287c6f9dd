"""Boxes: predicates, unions, shares of a box, reading order, image groups. A box is struct<x0, y0 (top), x1, y1 (bottom)>."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlaps(a: Column, b: Column, share: float) -> Column:
    """At least ``share`` of b's area is inside a; a box without area never is."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return (wide > 0) & (high > 0) & (wide * high >= area(b) * share)


def inside(x: Column, y: Column, b: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def meets(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def tiles(a: Column, b: Column, within: float = 1.0) -> Column:
    """The boxes share a whole edge."""
    near = lambda p, q: F.abs(p - q) <= within
    rows = near(a["y0"], b["y0"]) & near(a["y1"], b["y1"]) & (near(a["x1"], b["x0"]) | near(b["x1"], a["x0"]))
    columns = near(a["x0"], b["x0"]) & near(a["x1"], b["x1"]) & (near(a["y1"], b["y0"]) | near(b["y1"], a["y0"]))
    return rows | columns


def within_page(b: Column, width: Column) -> Column:
    """The box clamped to the page's left and right edges."""
    return b.withField("x0", F.greatest(F.lit(0.0), F.least(b["x0"], width))).withField("x1", F.greatest(F.lit(0.0), F.least(b["x1"], width)))


def shares(words: DataFrame, *keys: str) -> DataFrame:
    """Words that share one drawn token's box get their part of it, by length: box becomes the part."""
    w = Window.partitionBy(*keys).orderBy("word_ord")
    done = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.length("text")).over(Window.partitionBy(*keys))
    wide = (F.col("box.x1") - F.col("box.x0")) / total
    out = F.col("box").withField("x0", F.col("box.x0") + wide * done).withField("x1", F.col("box.x0") + wide * (done + F.length("text")))
    return words.withColumn("box", out)


def image_groups(images: DataFrame, keys: list[str], text_layer: str | None = None) -> DataFrame:
    """(keys, image, x0, y0, x1, y1, ops) in reading order from (op_ord, box, page_width, page_height).

    Images that share a whole edge are one, transitively; groups under 2 points either way go, and so do groups over half of a page
    that has no text layer. Rows of images go from the top; an image joins a row if its middle is above the bottom of the row's first.
    """
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def one(key, page: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in page.sort_values("op_ord").itertuples():
            box, ops = (r.x0, r.y0, r.x1, r.y1), [r.op_ord]
            while hit := next((g for g in groups if _touch(g[0], box)), None):
                groups.remove(hit)
                box = (min(box[0], hit[0][0]), min(box[1], hit[0][1]), max(box[2], hit[0][2]), max(box[3], hit[0][3]))
                ops = hit[1] + ops
            groups.append([box, sorted(ops)])
        size, has_text = page["page_width"].iloc[0] * page["page_height"].iloc[0], bool(page["has_text"].iloc[0])
        kept = [g for g in groups if g[0][2] - g[0][0] >= 2 and g[0][3] - g[0][1] >= 2 and (has_text or (g[0][2] - g[0][0]) * (g[0][3] - g[0][1]) <= size / 2)]
        rows: list[list] = []
        for g in sorted(kept, key=lambda g: (g[0][1], g[0][0])):
            if rows and (g[0][1] + g[0][3]) / 2 < rows[-1][0][0][3]:
                rows[-1].append(g)
            else:
                rows.append([g])
        ordered = [g for row in rows for g in sorted(row, key=lambda g: g[0][0])]
        out = pd.DataFrame([(*key, k, *g[0], ",".join(map(str, g[1]))) for k, g in enumerate(ordered)], columns=[*keys, "image", "x0", "y0", "x1", "y1", "ops"])
        return out

    flat = images.select(*keys, "op_ord", "box.*", "page_width", "page_height", (F.col(text_layer) if text_layer else F.lit(True)).alias("has_text"))
    return flat.groupBy(*keys).applyInPandas(one, f"{kinds}, image int, x0 double, y0 double, x1 double, y1 double, ops string")


def _touch(a, b, within: float = 1.0) -> bool:
    near = lambda p, q: abs(p - q) <= within
    return (near(a[1], b[1]) and near(a[3], b[3]) and (near(a[2], b[0]) or near(b[2], a[0]))) or (near(a[0], b[0]) and near(a[2], b[2]) and (near(a[3], b[1]) or near(b[3], a[1])))


def figures_to_images(figures: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Each figure with the page image of the same number, only on pages where HTML and page have equally many."""
    counts = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return figures.join(counts, keys).where(F.col("images") == F.col("__n")).join(images, [*keys, "image"]).drop("__n")


def links_to_annotations(links: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, link_ord, annot_ord): each link takes the first unused annotation that overlaps one of its word boxes by 30%, else the
    first unused one with its address.

    links: (link_ord, href, boxes array<box>); annotations: (annot_ord, uri, box). Pages without annotations give null annot_ord.
    """
    kinds = ", ".join(f"`{k}` {links.schema[k].dataType.simpleString()}" for k in keys)

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, out = {r.annot_ord: r for r in b.sort_values("annot_ord").itertuples()}, []
        for r in a.sort_values("link_ord").itertuples():
            boxes = [tuple(x[k] for k in ("x0", "y0", "x1", "y1")) for x in (r.boxes if r.boxes is not None else [])]
            hit = next((k for k, v in free.items() if any(_covers(tuple(v.box[c] for c in ("x0", "y0", "x1", "y1")), x, 0.3) for x in boxes)), None)
            if hit is None:
                hit = next((k for k, v in free.items() if v.uri == r.href and r.href is not None), None)
            free.pop(hit, None)
            out.append((*key, r.link_ord, hit))
        return pd.DataFrame(out, columns=[*keys, "link_ord", "annot_ord"]).astype({"annot_ord": "Int64"})

    return links.groupBy(*keys).cogroup(annotations.groupBy(*keys)).applyInPandas(one, f"{kinds}, link_ord long, annot_ord long")


def _covers(a, b, share: float) -> bool:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return wide > 0 and high > 0 and wide * high >= (b[2] - b[0]) * (b[3] - b[1]) * share


def words_under(boxes: DataFrame, words: DataFrame, keys: list[str], box_ord: str, share: float = 0.3) -> DataFrame:
    """(keys, box_ord, text): the page's words that lie under each box, by ``share`` of their area, joined by spaces."""
    w = words.select(*keys, "word_ord", "text", F.col("box").alias("__w"))
    hit = boxes.join(w, keys).where(overlaps(F.col("box"), F.col("__w"), share))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", "text"))), lambda x: x["text"]), " ")
    return hit.groupBy(*keys, box_ord).agg(text.alias("text"))
