"""Readers and writers. A bad row or page becomes an error row; it never fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_PAGES = 25
PAGES_SCHEMA = "lang string, title string, pages array<struct<sourcePage:double,html:string>>"


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table. ``spread``: one that comes in fewer splits than there are cores (a small file is often one row group) is dealt over
    all of them; a table of many splits is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, lang, title, page_ord, source_page, html) of files that each hold one document's pages."""
    docs = spark.read.schema(PAGES_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return exploded_pages(docs.withColumn("path", F.col("_metadata.file_path")))


def exploded_pages(docs: DataFrame) -> DataFrame:
    keys = [c for c in docs.columns if c != "pages"]
    return docs.select(*keys, F.posexplode_outer("pages").alias("page_ord", "p")).select(*keys, "page_ord", F.col("p.sourcePage").alias("source_page"), F.col("p.html").alias("html"))


def checked_pages(pages: DataFrame, page_count: Column, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(good pages, errors): page numbers are whole, from 1 to the document's page count, with HTML, and not given twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "source_page"))
    whole = (F.col("source_page") == F.floor("source_page")) & F.col("source_page").between(1, page_count)
    why = F.when(F.col("source_page").isNull() | ~whole, "page_out_of_range").when(F.col("html").isNull(), "page_without_html").when(n > 1, "page_given_twice")
    marked = pages.withColumn("code", why)
    good = marked.where("code is null").drop("code").withColumn("source_page", F.col("source_page").cast("int"))
    return good, marked.where("code is not null").select(*keys, "source_page", "code")


def too_many_pages(pages: DataFrame, *keys: str, most: int = MOST_PAGES) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > most).withColumn("code", F.lit("too_many_pages"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): whole files; what isn't read by a later step is not loaded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def pages_without_html(meta: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Source pages that have no HTML: left as they are; a warning unless they are blank. meta: (page, blank)."""
    left = meta.join(pages.select(*keys, F.col("source_page").alias("page")), [*keys, "page"], "left_anti")
    return left.withColumn("code", F.when(~F.col("blank"), "page_without_html"))


def as_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One column, ``value``: the columns' text with tabs between; nulls are empty."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON document per row."""
    reports.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.text(path)
