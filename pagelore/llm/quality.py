"""Quality classification by hierarchical empirical Bayes.

Evidence: a logistic regression over features of the text, fitted on a bounded sample of labelled documents, gives each document a
probability. Sites: a host's posterior is a beta posterior around the global prior, a path's one around its host's. The strength of
each prior is estimated by the method of moments from all labelled rates one level down, so sparse hosts and paths shrink towards
the level above. Documents without a label count in their site with their probability at the weight ``soft``. Last, a document's
log-odds are moved by what its path's posterior, without the document's own label or probability, differs from the global rate.

Sites are aggregated by grouped sums with partial aggregation and joined back by key, the rows of a large site dealt over tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import read, spread_join, with_columns
from .store import written

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"?!()-]|_")
_MARKS = re.compile(r"[!?]{2,}")
_DIGITS = re.compile(r"[0-9]+")
FEATURES = 14


def features(text: str) -> list[float]:
    """Shape and repetition of a text; each between 0 and about 1."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = [w.strip(".,;:!?*#$%&|\"'()") for w in words]
    same = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    return [
        1.0,
        min(1.0, np.log1p(len(words)) / 10),
        letters / chars,
        len(_SYMBOLS.findall(text)) / chars,
        sum(map(str.isupper, bare)) / n,
        len(_MARKS.findall(text)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        same / n,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(map(len, words)) / n / 20),
        words.count("|") / n,
        sum(w[-1:] in ".!?" for w in words) / n,
        sum(map(len, _DIGITS.findall(text))) / chars,
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _strength(groups: DataFrame, rate: str, parent: str) -> float:
    """Prior observations by moments over (n, y): how little do the groups' rates differ from their parent's beyond chance? 1 to 1000."""
    spread = F.pow(F.col("y") / F.col("n") - F.col(parent), 2)
    chance = F.col(parent) * (1 - F.col(parent))
    row = groups.where("n > 0").agg(F.sum(F.col("n") * spread), F.sum(chance), F.sum((F.col("n") - 1) * chance)).first()
    if row[0] is None or not row[2]:
        return 10.0
    rho = (row[0] - row[1]) / row[2]  # the correlation of two documents of one group
    return float(np.clip(1 / max(rho, 1e-9) - 1, 1, 1000))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, soft: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep) of every row of ``docs``.

    evidence: the text classifier's probability; host_posterior, path_posterior: of the whole sites; quality: evidence with what the
    path's other documents say; keep: quality >= threshold, ties kept. Null and empty texts have the features of an empty text; null
    hosts and paths are groups of their own, named ''. A document with several labels counts once, with their mean; labels of unknown
    documents, and null ones, don't count. Rows that repeat an id each have its label; a null id has none. Other columns are ignored.
    Without labels all is 0.5 and kept; an empty table gives no rows. Texts are read whole.
    """
    here = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))

    def make():
        return lambda batch: [[features(t or "") for t in batch]]

    table = with_columns(here, "text", make, "x array<double>", ["doc_id", "host", "path"])
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("__y")).where("doc_id is not null and __y is not null").groupBy("doc_id").agg(F.avg("__y").alias("y"))
    # a null id meets no label, so such rows are dealt over tasks
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    table = written(table.withColumn("__spread", spread).join(known.withColumn("__spread", F.lit(0).cast("long")), ["doc_id", "__spread"], "left").drop("__spread"))
    labelled = table.where("y is not null")
    n, positive = labelled.agg(F.count(F.lit(1)), F.sum("y")).first()
    if n:
        share = min(1.0, sample / n)
        rows = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)).select("x", "y").collect()  # about ``sample`` rows at most
        x = np.array([r[0] for r in rows]).reshape(-1, FEATURES)
        w = logistic(x, np.array([r[1] for r in rows]))
        base = float(np.clip((positive + 1) / (n + 2), 0.01, 0.99))
    else:
        w, base = np.zeros(FEATURES), 0.5
    odds = sum((F.col("x")[k] * float(v) for k, v in enumerate(w)), F.lit(0.0))
    table = table.withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))))
    unlabelled = F.col("y").isNull()
    sums = [F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("good"), F.sum(unlabelled.cast("long")).alias("rest"), F.coalesce(F.sum(F.when(unlabelled, F.col("evidence"))), F.lit(0.0)).alias("likely")]
    table = table.withColumn("site", F.struct("host", "path"))
    paths = written(table.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = paths.groupBy(F.col("site.host").alias("host")).agg(*(F.sum(k).alias(k) for k in ("labelled", "good", "rest", "likely"))).withColumn("base", F.lit(base))
    of_host = _strength(hosts.select(F.col("labelled").alias("n"), F.col("good").alias("y"), "base"), "y", "base")

    def posterior(at: str, mean: Column, strength: float, without: bool = False) -> Column:
        """Of the site ``at``, all of it or without the row's own share."""
        good, likely, n, m = (F.col(f"{at}.{k}") for k in ("good", "likely", "labelled", "rest"))
        if without:
            good, n = good - F.coalesce("y", F.lit(0.0)), n - F.col("y").isNotNull().cast("int")
            likely, m = likely - F.when(unlabelled, F.col("evidence")).otherwise(0.0), m - unlabelled.cast("int")
        return (good + soft * likely + mean * strength) / (n + soft * m + strength)

    kept = ("labelled", "good", "rest", "likely")
    both = paths.withColumn("host", F.col("site.host")).join(hosts.select("host", F.struct(*kept).alias("of_host")), "host")
    both = written(both.select("site", "n", F.struct(*kept).alias("of_path"), "of_host").withColumn("host_posterior", posterior("of_host", F.lit(base), of_host)))
    of_path = _strength(both.select(F.col("of_path.labelled").alias("n"), F.col("of_path.good").alias("y"), "host_posterior"), "y", "host_posterior")
    both = both.withColumn("path_posterior", posterior("of_path", F.col("host_posterior"), of_path))
    logit = lambda p: F.ln(p / (1 - p))
    others = posterior("of_path", posterior("of_host", F.lit(base), of_host, True), of_path, True)
    inside = F.least(F.lit(0.999), F.greatest(F.lit(0.001), others))
    moved = logit(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("evidence")))) + logit(inside) - float(np.log(base / (1 - base)))
    out = spread_join(table, both, "site").withColumn("quality", 1 / (1 + F.exp(-moved)))
    return out.withColumn("keep", F.col("quality") >= threshold).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", "keep")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """A document's host is its source. Documents have no URL here; their language within the source stands for the path."""
    docs = read(spark, sf_dir, "documents")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
