"""Functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import math_speech, structure
from ..operators.align import edit_distance
from ..operators.html_tree import parse
from . import text


@F.pandas_udf(T.StringType())
def normalize_word(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else structure.norm(x))


@F.pandas_udf(T.StringType())
def list_label(kind: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([structure.list_label(k, int(v)) for k, v in zip(kind, n)], dtype=object)


def _math(html: str | None):
    return next((e for e in parse(html or "").elements() if e.tag == "math"), None)


@F.pandas_udf(T.StringType())
def speak_math(html: pd.Series) -> pd.Series:
    return html.map(lambda x: (e := _math(x)) and math_speech.speak(e))


@F.pandas_udf(T.StringType())
def math_xml(html: pd.Series) -> pd.Series:
    return html.map(lambda x: (e := _math(x)) and math_speech.xml(e))


@F.pandas_udf(T.IntegerType())
def bounded_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y, int(m)) for x, y, m in zip(a, b, most)])


class HtmlNodes:
    """Elements and texts of a fragment as adjacency rows, in order."""

    def eval(self, html: str):
        todo, n = [(parse(html or ""), 0, 0, 0)], 0
        while todo:
            e, parent, order, depth = todo.pop()
            n += 1
            if isinstance(e, str):
                yield n, parent, order, depth, "text", None, None, e
            else:
                yield n, parent, order, depth, "element", e.tag, e.attrs, None
                todo.extend((k, n, i, depth + 1) for i, k in reversed(list(enumerate(e.kids))))


def register(spark: SparkSession) -> None:
    """nfkd, nfkc, normalize_word, list_label, speak_math, math_xml, bounded_distance, and the table function html_nodes."""
    for f in (text.nfkd, text.nfkc, normalize_word, list_label, speak_math, math_xml, bounded_distance):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType="node_id int, parent_id int, ord int, depth int, kind string, tag string, attrs map<string,string>, text string"))
