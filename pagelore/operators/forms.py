"""Form fields: inventory, checks of values, and matching of HTML controls to widgets and page words. Values never reach a message."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory(widgets: DataFrame, *keys: str) -> DataFrame:
    """One row per field from its widgets (widget_ord, name, type, page, rect, on_states, choices, flags and lengths): the first
    widget's properties; a radio group's options are all its widgets' states, in first-seen order."""
    states = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("widget_ord", "on_states"))), lambda x: x["on_states"])))
    first = lambda c: F.min_by(c, "widget_ord")
    kind = first("type")
    options = F.when(kind == "radio", states).when(kind == "checkbox", first("on_states")).when(kind.isin("combobox", "listbox"), first("choices")).otherwise(F.array().cast("array<string>"))
    kept = [first(c).alias(c) for c in ("label", "page", "rect", "required", "readonly", "editable", "multi_select")]
    return widgets.groupBy(*keys, "name").agg(kind.alias("type"), options.alias("options"), F.when((kind == "text") & (first("maxlen") > 0), first("maxlen")).alias("maxlen"), F.min("widget_ord").alias("field_ord"), *kept)


def check_values(values: DataFrame, fields: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, level, code, detail): what is wrong with the values to set; nothing is returned for a good value.

    values: (name, value VARIANT); fields: (name, type, options, maxlen, editable, multi_select). If a document's values name
    fields that it doesn't have, that one error names them all, and its other values aren't checked.
    """
    on = [*keys, "name"]
    nowhere = values.join(fields, on, "left_anti")
    names = F.array_join(F.array_sort(F.collect_list("name")), ", ")
    missing = nowhere.groupBy(*keys).agg(names.alias("__n")).select(*keys, F.lit(None).cast("string").alias("name"), F.lit("error").alias("level"), F.lit("no_acroform_field").alias("code"), F.concat(F.lit("No form field for: "), "__n").alias("detail"))
    met = values.join(fields, on)
    met = met.join(nowhere.select(*keys).distinct(), list(keys), "left_anti") if keys else met
    kind = F.schema_of_variant("value")
    text, truth = kind == "STRING", kind == "BOOLEAN"
    many = kind.startswith("ARRAY")
    words = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    s = F.try_variant_get("value", "$", "string")
    chosen = F.when(many, F.try_variant_get("value", "$", "array<string>")).otherwise(F.array(s))
    known = F.size(F.array_except(chosen, F.col("options"))) == 0
    only = F.concat(F.lit("must be one of: "), F.array_join("options", ", "), F.lit("."))
    why = (
        F.when(F.col("type") == "text", F.when(~text, "a text field takes a string.").when(F.length(s) > F.col("maxlen"), F.concat(F.lit("longer than its limit of "), F.col("maxlen"), F.lit(" characters."))))
        .when(F.col("type") == "checkbox", F.when(~truth, "a checkbox takes true or false.").when(F.try_variant_get("value", "$", "boolean") & (F.size("options") == 0), "this checkbox has no checked appearance to show."))
        .when(F.col("type") == "radio", F.when(~text | ~known, only))
        .when(F.col("type").isin("combobox", "listbox"), F.when(many & ~F.col("multi_select"), "takes one choice, not a list.").when(~(text | words), "a choice is a string.").when(~F.col("editable") & ~known, only))
    )
    code = F.when(F.col("type") == "button", "field_not_settable").when(F.col("type") == "signature", "signature_field_skipped").when(why.isNotNull(), "bad_value")
    detail = F.when(F.col("type") == "button", F.concat(F.lit('Field "'), "name", F.lit('" is a push button.'))).when(F.col("type") == "signature", F.col("name")).otherwise(F.concat(F.lit('Field "'), "name", F.lit('": '), why))
    level = F.when(F.col("type") == "signature", "warning").otherwise("error")
    found = met.select(*keys, "name", level.alias("level"), code.alias("code"), detail.alias("detail")).where("code is not null")
    return missing.unionByName(found)


def set_counts(values: DataFrame, fields: DataFrame, widgets: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(set and skipped_read_only of each document, changed boxes by page): signatures are skipped in silence, read-only fields counted."""
    met = values.join(fields, [*keys, "name"]).where("type <> 'signature'")
    counts = met.groupBy(*keys).agg(F.count_if(~F.col("readonly")).alias("set"), F.count_if("readonly").alias("skipped_read_only"))
    boxes = met.where("not readonly").select(*keys, "name").join(widgets.select(*keys, "name", "page", "rect"), [*keys, "name"])
    return counts, boxes.select(*keys, "page", "name", "rect")


def controls_to_widgets(controls: DataFrame, widgets: DataFrame, *keys: str) -> DataFrame:
    """Each HTML control with a widget of its name: the k-th control of a name (and, for buttons, value) takes the k-th such widget.

    controls: (control_ord, name, value, type); widgets: (widget_ord, name, on_states). Without a partner widget_ord is null.
    """
    button = F.col("type").isin("radio", "checkbox") & F.col("value").isNotNull()
    mine = controls.withColumn("__v", F.when(button, F.col("value")).otherwise(""))
    mine = mine.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "name", "__v").orderBy("control_ord")))
    states = F.when(F.size("on_states") > 0, F.col("on_states")).otherwise(F.array(F.lit("")))
    theirs = widgets.select(*keys, "name", "widget_ord", F.explode(states).alias("__v"))
    theirs = theirs.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "name", "__v").orderBy("widget_ord")))
    return mine.join(theirs, [*keys, "name", "__v", "__k"], "left").drop("__v", "__k")


def taken_widgets(controls: list[dict], widgets: list[dict], elsewhere: set[str]) -> list[tuple[int, list[int], str | None]]:
    """(control_ord, widget_ords, warning) of a page's controls, in order.

    A control takes all free widgets of its name (of its value, if it has one); if there are none and the name exists at all, those of
    its next variant that has any: name-2, name-3, ... A widget is taken once. elsewhere: names of the document's other widgets.
    """
    by_name: dict[str, list[dict]] = {}
    for w in sorted(widgets, key=lambda w: w["widget_ord"]):
        by_name.setdefault(w["name"], []).append(w)
    known, used, out = elsewhere | by_name.keys(), set(), []
    for c in sorted(controls, key=lambda c: c["control_ord"]):
        mine: list[int] = []
        if c["name"]:
            clean = c["name"].replace(".", "-")
            names = chain([c["name"], clean], (f"{clean}-{k}" for k in count(2)))
            for k, name in enumerate(names):
                if k and name not in known:  # variants are tried for as long as there are any
                    break
                mine = [w["widget_ord"] for w in by_name.get(name, []) if w["widget_ord"] not in used and (not c["value"] or c["value"] in (w["on_states"] or []))]
                if mine:
                    break
        used.update(mine)
        missing = "field_without_name" if not c["name"] else "field_on_other_page" if c["name"] in known else "field_not_in_pdf"
        out.append((c["control_ord"], mine, None if mine else missing))
    return out


def match_controls(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, control_ord, widget_ords array<int>, code): a row for each control; code says why one has no widget.

    pages: one row a page with controls (control_ord, name, value), widgets (widget_ord, name, on_states) and other_names, the names
    of the document's widgets on other pages. No shuffle: a page is worked on where it is.
    """
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for k, r in enumerate(b.select(["controls", "widgets", "other_names"]).to_pylist()):
                found = taken_widgets(r["controls"] or [], r["widgets"] or [], set(r["other_names"] or []))
                rows += found
                at += [k] * len(found)
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*keys, "control_ord", "widget_ords", "code"])

    return pages.select(*keys, "controls", "widgets", "other_names").mapInArrow(run, f"{kinds}, control_ord int, widget_ords array<int>, code string")


def unique_names(fields: DataFrame, base: str, order: str, *keys: str) -> DataFrame:
    """name: in order, the first of base (dots as hyphens), base-2, base-3, ... that no field of the document had before.

    A document's fields are taken as one array and folded; they come back as rows. Fields of equal order keep a fixed one.
    """
    kept = [c for c in fields.columns if c not in keys and c != "name"]
    listed = F.array_sort(F.collect_list(F.struct(order, *(c for c in kept if c != order))))
    one = fields.groupBy(*keys).agg(listed.alias("__f")) if keys else fields.agg(listed.alias("__f"))
    clean = F.transform("__f", lambda f: F.replace(f[base], F.lit("."), F.lit("-")))
    numbered = lambda b, n: F.when(n == 1, b).otherwise(F.concat(b, F.lit("-"), n))

    def first_free(taken: Column, b: Column) -> Column:
        """One of base, base-2, ..., base-(n + 1) is free if n names are taken."""
        tried = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: numbered(b, n))
        return F.get(F.filter(tried, lambda t: ~F.array_contains(taken, t)), F.lit(0))

    names = F.aggregate(clean, F.array().cast("array<string>"), lambda taken, b: F.array_append(taken, first_free(taken, b)))
    rows = one.select(*keys, F.inline(F.zip_with("__f", names, lambda f, n: F.struct(f.alias("f"), n.alias("name")))))
    return rows.select(*keys, *(F.col(f"f.{c}").alias(c) for c in kept), "name")


def labels_on_page(labels: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label_ord, first word_ord): labels whose words stand exactly once in a row on the page, whatever their length.

    labels: (label_ord, norms array<string>); words: (word_ord, norm). A page's words meet its labels as one array; only places where
    a label's first word stands are compared.
    """
    listed = F.array_sort(F.collect_list(F.struct("word_ord", F.coalesce("norm", F.lit("")).alias("norm"))))
    page = words.groupBy(*keys).agg(listed.alias("__w")).select(*keys, F.col("__w.norm").alias("__n"), F.col("__w.word_ord").alias("__o"))
    wanted = labels.where(F.size("norms") > 0)
    near = F.filter(F.sequence(F.lit(1), F.size("__n")), lambda i: (F.element_at("__n", i) == F.col("norms")[0]) & (i + F.size("norms") - 1 <= F.size("__n")))
    places = F.filter(near, lambda i: F.slice("__n", i, F.size("norms")) == F.col("norms"))
    met = wanted.join(page, keys).withColumn("__at", places).where(F.size("__at") == 1)
    return met.select(*keys, "label_ord", F.element_at("__o", F.col("__at")[0]).alias("word_ord"))


def label_nearby(words: DataFrame, label_box: Column, *keys: str) -> Column:
    """Whether one of the three matched words on either side is within six line heights of the label."""
    near = Window.partitionBy(*keys).orderBy("word_ord").rowsBetween(-3, 3)
    high = label_box["y1"] - label_box["y0"]
    return F.max((F.col("matched") & (F.abs(F.col("box.y0") - label_box["y0"]) <= high * 6)).cast("int")).over(near) == 1
