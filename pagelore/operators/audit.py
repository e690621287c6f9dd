"""Checks and roll-ups over tables read from files: metadata packets, content, fonts, layers, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_escapes(c: Column) -> Column:
    """Markup characters as numeric references."""
    out = F.replace(c, F.lit("&"), F.lit("&#38;"))
    for a, b in (("<", "&#60;"), (">", "&#62;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def metadata_packet(old: Column, title: Column, claim: Column) -> Column:
    """An XMP packet with one title and one accessibility claim, in a description of their own; those that were there go.

    A packet that can't be patched is replaced. Title and claim may be missing (null or empty, false).
    """
    has = F.coalesce(title, F.lit("")) != ""
    said = F.when(has, F.concat(F.lit('<dc:title><rdf:Alt><rdf:li xml:lang="x-default">'), numeric_escapes(title), F.lit("</rdf:li></rdf:Alt></dc:title>"))).otherwise("")
    claimed = F.when(F.coalesce(claim, F.lit(False)), "<pdfuaid:part>1</pdfuaid:part>").otherwise("")
    ours = F.concat(F.lit('<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdfuaid="http://www.aiim.org/pdfua/ns/id/">'), said, claimed, F.lit("</rdf:Description>"))
    bare = F.regexp_replace(old, r"(?s)<pdfuaid:(\w+)[^>]*?(?:/>|>.*?</pdfuaid:\1>)|\spdfuaid:\w+\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    bare = F.when(has, F.regexp_replace(bare, r"(?s)<dc:title\b[^>]*?(?:/>|>.*?</dc:title>)", "")).otherwise(bare)
    new = F.concat(F.lit('<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'), ours, F.lit('</rdf:RDF></x:xmpmeta><?xpacket end="w"?>'))
    at = F.instr(bare, "</rdf:RDF>")
    return F.when(old.contains("</rdf:RDF>"), F.concat(F.substring(bare, F.lit(1), at - 1), ours, F.substring(bare, at, F.length(bare)))).otherwise(new)


def safe_content(ops: DataFrame, *keys: str) -> DataFrame:
    """(keys, safe): states and text objects nest, text objects not in each other, and nothing depends on where it is drawn.

    ops: (op_ord, op, args).
    """
    w = Window.partitionBy(*keys).orderBy("op_ord").rowsBetween(Window.unboundedPreceding, 0)
    depth = lambda a, b: F.sum(F.when(F.col("op") == a, 1).when(F.col("op") == b, -1).otherwise(0)).over(w)
    bad = F.col("op").isin("BI", "BMC", "BDC", "EMC", "MP", "DP") | (F.col("op").isin("scn", "SCN") & F.coalesce(F.try_element_at("args", F.lit(-1)).startswith("/"), F.lit(False)))
    run = ops.withColumns({"__q": depth("q", "Q"), "__t": depth("BT", "ET"), "__bad": bad})
    ends = (F.max_by("__q", "op_ord") == 0) & (F.max_by("__t", "op_ord") == 0)
    return run.groupBy(*keys).agg((ends & (F.min("__q") >= 0) & F.min("__t").between(0, 0) & (F.max("__t") <= 1) & ~F.bool_or("__bad")).alias("safe"))


def new_fonts(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Font names that are there only afterwards."""
    return after.select(*keys, "font").subtract(before.select(*keys, "font"))


def unembedded_fonts(fonts: DataFrame, *keys: str) -> DataFrame:
    """Fonts in use without a program of their own, by name; those drawn by content (type 3) need none."""
    return fonts.where("used and not embedded and subtype <> 'Type3'").select(*keys, "font").distinct()


def width_mismatches(glyphs: DataFrame, widths: DataFrame, *keys: str, default: float = 1000.0, within: float = 1.0) -> DataFrame:
    """(keys, font): fonts in which a drawn glyph's stated width and its program's advance differ by more than a unit.

    glyphs: (font, cid, advance, default_width), drawn ones only; widths: runs (font, first, last, width). A glyph outside all runs
    has the font's default width.
    """
    runs = widths.select(*keys, "font", F.explode(F.sequence("first", "last")).alias("cid"), "width").groupBy(*keys, "font", "cid").agg(F.first("width").alias("width"))
    stated = F.coalesce("width", "default_width", F.lit(default))
    return glyphs.join(runs, [*keys, "font", "cid"], "left").where(F.abs(stated - F.col("advance")) > within).select(*keys, "font").distinct()


def layers_switch_themselves(configs: DataFrame, *keys: str) -> DataFrame:
    """Whether some layer configuration has automatic states: such a file makes no claim."""
    return configs.groupBy(*keys).agg(F.bool_or("auto_state").alias("layers_switch"))


def verification(pixels: DataFrame, texts: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pixels, differing_pixels, text_preserved, error): both checks of each document rolled up.

    pixels: (page, differing); texts: (page, missing, overlay_missing) of failing pages. The error is the first failing page's.
    """
    p = pixels.where("differing > 0").groupBy(key).agg(F.sum("differing").alias("differing_pixels"), F.min("page").alias("__p"))
    t = texts.groupBy(key).agg(F.min("page").alias("__t"))
    out = docs.select(key).distinct().join(p, key, "left").join(t, key, "left")
    error = F.when(F.col("__p").isNotNull(), "pixels_changed").when(F.col("__t").isNotNull(), "text_lost")
    return out.select(key, F.when(F.col("__p").isNull(), "identical-outside-fields").otherwise("failed").alias("pixels"), F.coalesce("differing_pixels", F.lit(0)).alias("differing_pixels"), F.col("__t").isNull().alias("text_preserved"), error.alias("error"))


def subtree_has(tree: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """Nodes of a walked tree with an element of the type in their subtree, themselves included."""
    return tree.where(F.col("type") == kind).select(key, F.explode("seen").alias("node_id")).distinct()
