"""Pages as a stream: the page functions have no state, so the same ones run; counters by document keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.structure import exploded, page_structure


def read_pages(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    return exploded(page_structure(pages, html), "nodes")


def running_type_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Elements by type so far."""
    return stream_nodes(pages, html).groupBy("type").agg(F.count(F.lit(1)).alias("elements"))


def write_reports(pages: DataFrame, path: str, checkpoint: str, html: str = "html") -> StreamingQuery:
    """Nodes of all pages that are there now, exactly once, as Parquet."""
    return stream_nodes(pages, html).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
