"""Tag trees as tables: walks, inherited values, text in reading order, outlines, capped detail.

A tree is (keys, node_id, parent_id, ord, type, ...); the root's parent is null. Walks are recursive queries with a path, so they end
on cycles and at the depth cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote

DEPTH = 64


def walk(nodes: DataFrame, key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """Reachable nodes with depth and path (ordinals from the root): sorting by path is reading order. Cycles and deeper nodes are left out."""
    name = f"tree_{abs(hash((id(nodes), key, depth))):x}"
    nodes.createOrReplaceTempView(name)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE reach (k, id, depth, path, seen) MAX RECURSION LEVEL {depth + 2} AS (
            SELECT {key}, node_id, 0, array(ord), array(node_id) FROM {name} WHERE parent_id IS NULL
            UNION ALL
            SELECT r.k, n.node_id, r.depth + 1, array_append(r.path, n.ord), array_append(r.seen, n.node_id)
            FROM reach r JOIN {name} n ON n.{key} = r.k AND n.parent_id = r.id
            WHERE r.depth < {depth} AND NOT array_contains(r.seen, n.node_id)
        )
        SELECT n.*, r.depth, r.path, r.seen FROM reach r JOIN {name} n ON n.{key} = r.k AND n.node_id = r.id""")


def inherited(nodes: DataFrame, value: str, key: str = "doc_id", steps: int = 32) -> DataFrame:
    """Each node with the nearest value on its way up, itself included."""
    tree = walk(nodes, key, steps)
    up = tree.select(key, "node_id", F.posexplode("seen").alias("at", "above")).alias("a")
    own = nodes.select(F.col(key).alias("__k"), F.col("node_id").alias("__id"), F.col(value).alias("__v"))
    found = up.join(own, (F.col(key) == F.col("__k")) & (F.col("above") == F.col("__id"))).where("__v is not null")
    nearest = found.groupBy(key, "node_id").agg(F.max_by("__v", "at").alias(f"inherited_{value}"))
    return nodes.join(nearest, [key, "node_id"], "left")


def full_names(fields: DataFrame, name: str = "t", key: str = "doc_id", steps: int = 32) -> DataFrame:
    """Terminal fields (no child has a name of its own) with their dotted name from the root."""
    tree = walk(fields, key, steps)
    parts = tree.select(key, "node_id", F.posexplode("seen").alias("at", "above"))
    own = fields.select(F.col(key).alias("__k"), F.col("node_id").alias("__id"), F.col(name).alias("__t"))
    joined = parts.join(own, (F.col(key) == F.col("__k")) & (F.col("above") == F.col("__id"))).where("__t is not null")
    dotted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "__t"))), lambda x: x["__t"]), ".")
    inner = fields.where(F.col(name).isNotNull() & F.col("parent_id").isNotNull()).select(F.col(key), F.col("parent_id").alias("node_id")).distinct()
    return joined.groupBy(key, "node_id").agg(dotted.alias("full_name")).join(inner, [key, "node_id"], "left_anti")


def page_of(tree: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, page): the pages that each subtree touches, from (key, node_id, page) of the nodes' own content."""
    above = tree.select(key, "node_id", F.explode("seen").alias("__a"))
    return above.join(pages, [key, "node_id"]).select(key, F.col("__a").alias("node_id"), "page").distinct()


def outline(nodes: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, line_ord, line): what a screen reader gets of each page: the elements that touch it, two spaces a level, with what
    is read aloud of each.

    nodes: (type, text, and where there are any elem_id, alt, actual_text, lang, title, scope, col_span, row_span, headers, contents,
    href, field, field_name). Text stands on the element's line if it has no child elements, else on a line of its own.
    """
    tree = walk(nodes, key)
    touched = page_of(tree, pages, key)
    inner = nodes.where("parent_id is not null").select(key, F.col("parent_id").alias("node_id"), F.lit(True).alias("__inner")).distinct()
    rows = tree.join(inner, [key, "node_id"], "left").join(touched, [key, "node_id"]).where("depth > 0")
    have = set(nodes.columns)
    said = [F.concat(F.lit(f"{k}="), quote(F.col(c))) for c, k in (("elem_id", "ID"), ("alt", "Alt"), ("actual_text", "ActualText"), ("lang", "Lang"), ("title", "T")) if c in have]
    said += [F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for c, k in (("scope", "Scope"), ("col_span", "ColSpan"), ("row_span", "RowSpan")) if c in have]
    said += [F.concat(F.lit("Headers="), quote(F.array_join("headers", " ")))] if "headers" in have else []
    said += [F.concat(F.lit(f"{k}="), quote(F.col(c))) for c, k in (("contents", "Contents"), ("href", "href")) if c in have]
    said += [F.concat(F.lit("field="), "field", F.lit(" name="), F.coalesce(quote(F.col("field_name")), F.lit("(none)")))] if {"field", "field_name"} <= have else []
    pad = F.repeat(F.lit("  "), F.col("depth") - 1)
    head = F.concat(pad, F.concat_ws(" ", "type", *said))
    own = F.col("text").isNotNull() & (F.col("text") != "")
    alone = F.col("__inner").isNull()
    lines = F.when(alone & own, F.array(F.concat(head, F.lit(" "), quote(F.col("text"))))).when(own, F.array(head, F.concat(pad, F.lit("  "), quote(F.col("text"))))).otherwise(F.array(head))
    flat = rows.select(key, "page", "path", F.posexplode(lines).alias("__at", "line"))
    order = F.row_number().over(Window.partitionBy(key, "page").orderBy("path", "__at")) - 1
    return flat.select(key, "page", order.alias("line_ord"), "line")


def outline_text(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def headings_before(headings: DataFrame, pages: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """(key, page, headings): the last ``most`` headings that begin before each page, in order. headings: (node_id, type, text, page)."""
    h = headings.where(F.col("type").rlike("^H[1-6]?$")).groupBy(key, "node_id").agg(F.first("type").alias("type"), F.first("text").alias("text"), F.min("page").alias("__first"))
    said = F.concat("type", F.lit(" "), quote(F.col("text")))
    per = h.groupBy(key, "__first").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", said.alias("s")))), lambda x: x["s"]).alias("__s"))
    every = pages.select(key, "page").join(per.withColumnRenamed("__first", "page"), [key, "page"], "full")
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    said = F.flatten(F.collect_list(F.coalesce("__s", F.array().cast("array<string>"))).over(before))
    last = F.when(F.size(said) > most, F.slice(said, -most, most)).otherwise(said)
    return every.withColumn("headings", last).select(key, "page", "headings").join(pages.select(key, "page").distinct(), [key, "page"], "left_semi")


def capped(tree: DataFrame, key: str = "doc_id", elements: int = 2000, most_bytes: int = 400_000) -> DataFrame:
    """The first elements depth first, as JSON, up to both caps; the last column says whether something was left out."""
    w = Window.partitionBy(key).orderBy("path")
    fields = [c for c in ("type", "page", "text", "alt", "lang", "href", "field") if c in tree.columns]
    out = tree.withColumn("json", F.to_json(F.struct(*fields))).withColumns({"__n": F.row_number().over(w), "__b": F.sum(F.octet_length("json")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    keep = (F.col("__n") <= elements) & (F.col("__b") <= most_bytes)
    out = out.withColumn("truncated", F.max((~keep).cast("int")).over(Window.partitionBy(key)) == 1)
    return out.where(keep).drop("__n", "__b")


def content_ids(nodes: DataFrame, *keys: str) -> DataFrame:
    """Marked-content ids: numbered from 0 on each page, in reading order."""
    return nodes.withColumn("mcid", F.row_number().over(Window.partitionBy(*keys).orderBy("node_id")) - 1)


def marked_text(chars: DataFrame, *keys: str) -> DataFrame:
    """Text by marked-content id: characters in order, a space where the line changes."""
    w = Window.partitionBy(*keys, "mcid").orderBy("char_ord")
    piece = F.concat(F.when(F.lag("line").over(w) != F.col("line"), " ").otherwise(""), "c")
    out = chars.where("mcid is not null").withColumn("__p", piece)
    return out.groupBy(*keys, "mcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_ord", "__p"))), lambda x: x["__p"]), "").alias("text"))


def balanced(ops: DataFrame, begin: str, end: str, *keys: str) -> DataFrame:
    """(keys, balanced): whether the operators nest: running sums never fall below zero and end at zero."""
    step = F.when(F.col("op") == begin, 1).when(F.col("op") == end, -1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("op_ord").rowsBetween(Window.unboundedPreceding, 0)
    run = ops.withColumn("__d", F.sum(step).over(w))
    return run.groupBy(*keys).agg(((F.min("__d") >= 0) & (F.max_by("__d", "op_ord") == 0)).alias("balanced"))


def any_flag(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def needs_tags(subtype: Column, flags: Column) -> Column:
    """Annotations to be tagged: no popups, none hidden or not viewed."""
    return (subtype != "Popup") & ~any_flag(F.coalesce(flags, F.lit(0)), 2 | 32)


def may_claim(report: DataFrame, conditions: list[str], *keys: str) -> DataFrame:
    """A standard is claimed only if every condition holds on every row."""
    each = F.lit(True)
    for c in conditions:
        each = each & F.coalesce(F.col(c), F.lit(False))
    return report.groupBy(*keys).agg(F.bool_and(each).alias("claim"))
