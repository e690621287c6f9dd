"""Review replies: findings, costs, message shapes, and a runner with an injected sender."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of findings.
KINDS = ["missing_content", "reading_order", "structure", "table", "alt_text", "link", "form", "language", "other"]
TOOL = "report_findings"


def reported(reply: Column, tool: str = TOOL) -> Column:
    """A whole reply with a list of findings; one that was cut off doesn't count."""
    calls = F.filter(F.try_variant_get(reply, "$.content", "array<variant>"), lambda c: (F.try_variant_get(c, "$.type", "string") == "tool_use") & (F.try_variant_get(c, "$.name", "string") == tool))
    listed = F.try_variant_get(F.get(calls, F.lit(0)), "$.input.findings", "array<variant>")
    return F.when(F.coalesce(F.try_variant_get(reply, "$.stop_reason", "string"), F.lit("")) != "max_tokens", listed)


def findings(replies: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(findings, failures) of (keys, reply VARIANT): (keys, ord, kind, severity, element, detail); (keys, error).

    An unknown kind is ``other``; a severity is ``error`` only if it says exactly that, else ``warning``.
    """
    listed = replies.withColumn("__f", reported(F.col("reply")))
    each = listed.select(*keys, F.posexplode("__f").alias("ord", "f"))
    get = lambda k: F.try_variant_get("f", f"$.{k}", "string")
    kind = F.when(get("kind").isin(KINDS), get("kind")).otherwise("other")
    severity = F.when(get("severity") == "error", "error").otherwise("warning")
    found = each.select(*keys, "ord", kind.alias("kind"), severity.alias("severity"), F.coalesce(get("element"), F.lit("")).alias("element"), F.coalesce(get("detail"), F.lit("")).alias("detail"))
    stop = F.coalesce(F.try_variant_get("reply", "$.stop_reason", "string"), F.lit("unknown"))
    failed = listed.where("__f is null").select(*keys, F.concat(F.lit("No findings were reported (stop reason: "), stop, F.lit(").")).alias("error"))
    return found, failed


def usage(replies: DataFrame, *keys: str) -> DataFrame:
    get = lambda k: F.sum(F.coalesce(F.try_variant_get("reply", f"$.usage.{k}", "bigint"), F.lit(0)))
    return replies.groupBy(*keys).agg(get("input_tokens").alias("input_tokens"), get("output_tokens").alias("output_tokens"))


def to_converse(body: Column) -> Column:
    """A request (VARIANT) in the other provider's message shape, as JSON."""
    get = lambda v, p, t="string": F.try_variant_get(v, p, t)

    def block(b: Column) -> Column:
        image = F.named_struct(F.lit("format"), F.lit("png"), F.lit("source"), F.named_struct(F.lit("bytes"), get(b, "$.source.data")))
        return F.when(get(b, "$.type") == "image", F.struct(image.alias("image"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit(None).cast(_IMAGE).alias("image"), F.coalesce(get(b, "$.text"), F.lit("")).alias("text")))

    def message(m: Column) -> Column:
        blocks = F.coalesce(F.transform(get(m, "$.content", "array<variant>"), block), F.array(F.struct(F.lit(None).cast(_IMAGE).alias("image"), get(m, "$.content").alias("text"))))
        return F.struct(get(m, "$.role").alias("role"), blocks.alias("content"))

    tool = lambda t: F.struct(F.struct(get(t, "$.name").alias("name"), get(t, "$.description").alias("description"), F.struct(F.try_variant_get(t, "$.input_schema", "variant").alias("json")).alias("inputSchema")).alias("toolSpec"))
    return F.to_json(F.struct(
        get(body, "$.model").alias("modelId"),
        F.array(F.struct(get(body, "$.system").alias("text"))).alias("system"),
        F.transform(get(body, "$.messages", "array<variant>"), message).alias("messages"),
        F.struct(F.transform(get(body, "$.tools", "array<variant>"), tool).alias("tools")).alias("toolConfig"),
        F.struct(get(body, "$.max_tokens", "bigint").alias("maxTokens")).alias("inferenceConfig"),
    ))


_IMAGE = "struct<format:string,source:struct<bytes:string>>"


def from_converse(reply: Column) -> Column:
    """That shape's reply (VARIANT) as JSON of the first shape: content, stop_reason, usage."""
    get = lambda v, p, t="string": F.try_variant_get(v, p, t)
    used = lambda c: F.struct(F.lit("tool_use").alias("type"), get(c, "$.toolUse.name").alias("name"), F.try_variant_get(c, "$.toolUse.input", "variant").alias("input"), F.lit(None).cast("string").alias("text"))
    said = lambda c: F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"), get(c, "$.text").alias("text"))
    kept = F.filter(F.coalesce(get(reply, "$.output.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda c: get(c, "$.toolUse.name").isNotNull() | get(c, "$.text").isNotNull())
    content = F.transform(kept, lambda c: F.when(get(c, "$.toolUse.name").isNotNull(), used(c)).otherwise(said(c)))
    count = lambda p: F.coalesce(get(reply, p, "bigint"), F.lit(0))
    return F.to_json(F.struct(content.alias("content"), get(reply, "$.stopReason").alias("stop_reason"), F.struct(count("$.usage.inputTokens").alias("input_tokens"), count("$.usage.outputTokens").alias("output_tokens")).alias("usage")))


def run_requests(requests: DataFrame, send: Callable[[str], str], *keys: str, attempts: int = 2, pause: float = 0.0) -> DataFrame:
    """(keys, reply, error, attempts): ``send`` is called for each request (JSON text) where it lies; an error is kept as a row."""
    kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for request in frame["request"]:
                reply = error = None
                for n in range(1, attempts + 1):
                    try:
                        reply, error = send(request), None
                        break
                    except Exception as e:  # noqa: BLE001  the sender's own; it becomes a row
                        error = str(e)
                        time.sleep(pause)
                rows.append((reply, error, n))
            yield pd.concat([frame[list(keys)].reset_index(drop=True), pd.DataFrame(rows, columns=["reply", "error", "attempts"])], axis=1)

    return requests.select(*keys, "request").mapInPandas(run, f"{kinds}, reply string, error string, attempts int")
