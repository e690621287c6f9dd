"""Reports: page counters and warnings to one nested document report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structure import GROUPS, INLINE, TYPES

VERSION = "0.1.0"
#: The structure types that pages are built of.
STRUCTURE_TYPES = frozenset(TYPES.values()) | INLINE | GROUPS | {"Note"}


def ordered_list(*columns: str):
    """The columns as an array of structs, sorted by the first ones."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def document_report(pages: DataFrame, warnings: DataFrame, type_counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, report): pages in order, elements by type with the total, warnings in order of page and code.

    pages: (page, counters); warnings: (page, code, detail); type_counts: (type, elements). A document without warnings has none.
    """
    columns = ["page", *(c for c in pages.columns if c not in (key, "page"))]
    p = pages.groupBy(key).agg(ordered_list(*columns).alias("pages"))
    w = warnings.groupBy(key).agg(ordered_list("page", "code", "detail").alias("warnings"))
    counts = type_counts.where("type is not null")
    t = counts.groupBy(key).agg(F.sum("elements").alias("elements"), F.map_from_entries(ordered_list("type", "elements")).alias("by_type"))
    out = p.join(t, key, "left").join(w, key, "left")
    structure = F.struct(F.coalesce("elements", F.lit(0)).alias("elements"), "by_type")
    listed = F.coalesce("warnings", F.array().cast(warnings.select(F.array(F.struct("page", "code", "detail")).alias("a")).schema["a"].dataType))
    return out.select(key, F.struct(F.lit(VERSION).alias("version"), "pages", structure.alias("structure"), listed.alias("warnings")).alias("report"))


def reports_of(built: DataFrame, counters: list[str], key: str = "doc_id") -> DataFrame:
    """(key, report) like ``document_report``, from the structure of pages (key, page, nodes, words, warnings, images) in one pass.

    counters: array columns (counted) or numbers of each page. Elements are summed by type before the exchange; a document's pages, of
    which there are few, become one row.
    """
    count = lambda c: (F.size(c) if built.schema[c].dataType.typeName() == "array" else F.col(c)).alias(c)
    sums = {t: F.sum(F.size(F.filter("nodes", lambda n: n["type"] == t))) for t in sorted(STRUCTURE_TYPES)}  # noqa: B023
    every = [
        F.array_sort(F.collect_list(F.struct("page", *map(count, counters)))).alias("pages"),
        F.sum(F.size("nodes")).alias("elements"),
        F.array(*(F.struct(F.lit(t).alias("key"), n.alias("value")) for t, n in sums.items())).alias("__types"),
        F.array_sort(F.flatten(F.collect_list(F.transform("warnings", lambda w: F.struct(F.col("page").alias("page"), w["code"].alias("code"), w["detail"].alias("detail")))))).alias("warnings"),
    ]
    out = built.groupBy(key).agg(*every)
    by_type = F.map_from_entries(F.filter("__types", lambda e: e["value"] > 0))
    return out.select(key, F.struct(F.lit(VERSION).alias("version"), "pages", F.struct("elements", by_type.alias("by_type")).alias("structure"), "warnings").alias("report"))


def with_fallback(first: DataFrame, second: DataFrame, codes: list[str], key: str = "doc_id") -> DataFrame:
    """A document's row from ``first``, unless its error code is one of ``codes``: then the one from ``second``, if there is one."""
    failed = first.where(F.col("error").isin(codes)).select(key).join(second.select(key), key, "left_semi")
    return first.join(failed, key, "left_anti").unionByName(second.join(failed, key, "left_semi"))
