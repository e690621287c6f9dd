"""SimHash near-duplicates: the operator over ``fingerprints`` (segment popcounts, grid range join, exact distances).

By itself the operator links texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Texts within ``distance``
bits come from the grid. A pair at a similarity of 0.8 differs in 10 of 64 bits on average and in 17 at times, which no grid over
64 bits reaches without comparing a text with a fixed share of all others; candidates beyond ``distance`` bits come from MinHash
bands (``jaccard``). With ``share=None`` the distance alone links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .fingerprints import fingerprints, links
from .graph import components
from .runs import read, spread_join
from .store import written


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, groups: int = 7, share: float | None = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    fp: the fingerprint of ``size``-word shingles. component_id: the smallest id reachable over links, the row's own included. Texts
    link at a Jaccard similarity of ``share`` or more of their ``words``-word shingles; with ``share=None``, at fingerprints within
    ``distance`` bits. Null and empty texts link with each other (they have fingerprint 0, and without ``share`` link like any
    other); rows with a null id get a component, but never name one (null if no row of the component has an id). Repeated rows stay;
    other columns are ignored; an empty table gives none.
    """
    if share is None:
        marked, root = written(fingerprints(docs, id_col, text_col, size)), "fp"
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        marked, root = written(jaccard.near_duplicates(rows, size=words, share=share, fingerprint_size=size, distance=distance, groups=groups).select("doc_id", "fp", "__group")), "__group"
    reps = written(marked.groupBy(root).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    if share is None:
        found = components(links(reps, distance, groups))
        of = written(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n"))
    else:
        of = reps.withColumnRenamed("rep", "component_id")
    return spread_join(marked, of, root).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same links by whole rows, for tables whose ids are null or shared: ``docs`` with fp, __set (one for equal texts) and __group (one for linked ones)."""
    return jaccard.near_duplicates(docs, text_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of the texts so linked one stays: that with the smallest id. Rows with a null id all stay."""
    return jaccard.representatives(docs, id_col, text_col)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), share=None)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
