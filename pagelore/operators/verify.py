"""Checks that nothing was lost: multisets of words and characters, and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_words(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``before``, as often as they come, that ``after`` lacks."""
    return before.select(*columns).exceptAll(after.select(*columns))


def text_failures(before: DataFrame, after: DataFrame, added: DataFrame, *keys: str) -> DataFrame:
    """(keys, missing, overlay_missing): pages that lost words or characters.

    before, after: (keys, word); added: (keys, text), what was put on the page besides. missing: words of ``before`` that ``after``
    lacks, as a multiset. overlay_missing: characters of the added text that ``after``'s other words lack; those are compared by
    character, since words without a space between them run together.
    """
    signed = before.select(*keys, "word", F.lit(1).alias("n")).union(after.select(*keys, "word", F.lit(-1).alias("n")))
    both = signed.groupBy(*keys, "word").agg(F.sum("n").alias("n")).where("n <> 0")  # one exchange, of what is left after sums on either side of it
    lost = both.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("missing"))
    spare = both.where("n < 0").select(*keys, F.explode(F.split("word", "")).alias("c"), (-F.col("n")).alias("n")).groupBy(*keys, "c").agg(F.sum("n").alias("spare"))
    want = added.select(*keys, F.explode(F.split(F.regexp_replace("text", r"\s", ""), "")).alias("c")).where("c <> ''").groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("want"))
    short = want.join(spare, [*keys, "c"], "left").withColumn("spare", F.coalesce("spare", F.lit(0))).where("want > spare")
    gone = short.groupBy(*keys).agg(F.sum(F.col("want") - F.col("spare")).cast("long").alias("overlay_missing"))
    return lost.join(gone, list(keys), "full").na.fill(0)


def compare_pixels(pairs: DataFrame, *keys: str, pad: int = 2) -> DataFrame:
    """(keys, differing, x0, y0, x1, y1) from (w, h, before, after, changed): gray rasters that differ outside the changed boxes.

    changed: array of boxes in pixels; each is widened by ``pad``. Rasters of different size differ everywhere.
    """
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows = len(keys), []
            for r in batch.select(["w", "h", "before", "after", "changed"]).to_pylist():
                w, h = r["w"], r["h"]
                if len(r["before"]) != len(r["after"]) or len(r["before"]) != w * h:
                    rows.append((w * h, 0, 0, w, h))
                    continue
                differ = np.frombuffer(r["before"], np.uint8).reshape(h, w) != np.frombuffer(r["after"], np.uint8).reshape(h, w)
                for b in r["changed"] or []:
                    differ[max(0, int(np.floor(b["y0"])) - pad) : int(np.ceil(b["y1"])) + pad, max(0, int(np.floor(b["x0"])) - pad) : int(np.ceil(b["x1"])) + pad] = False
                y, x = np.nonzero(differ)
                rows.append((len(x), int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else (0, None, None, None, None))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *(pa.array(c, pa.int32()) for c in zip(*rows))], names=[*keys, "differing", "x0", "y0", "x1", "y1"])

    return pairs.select(*keys, "w", "h", "before", "after", "changed").mapInArrow(run, f"{kinds}, differing int, x0 int, y0 int, x1 int, y1 int")
