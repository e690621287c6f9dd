"""Word and text functions as column expressions. Only Unicode normalisation needs Python; Spark has no built-in for it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, the same in every function: also the no-break and other Unicode spaces. For use inside a character class.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Characters that are words of their own.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
QUOTES = dict(zip("‘’ʼ“”‐‑‒–—", "'''\"\"-----"))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkd_all(words: pd.Series) -> pd.Series:
    """Compatibility decomposition of each word of an array."""
    return words.map(lambda ws: ws if ws is None else [w if w is None or w.isascii() else unicodedata.normalize("NFKD", w) for w in ws])


def fold(c: Column) -> Column:
    """Typographic quotes and dashes as plain ones."""
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


def is_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def clean(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def normalize(c: Column, ascii_only: bool = False) -> Column:
    """The form that words are compared in: NFKD without marks, lower case, plain quotes and dashes, no punctuation at the ends.

    ``ascii_only`` says that there is nothing to decompose, and keeps the expression out of Python.
    """
    plain = c if ascii_only else F.regexp_replace(nfkd(c), r"\p{M}", "")
    return F.regexp_replace(fold(F.lower(plain)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def normalize_all(words: Column) -> Column:
    """``normalize`` of each word of an array; the array stays where it is, so nothing is exploded or shuffled."""
    return F.transform(nfkd_all(words), lambda w: F.regexp_replace(fold(F.lower(F.regexp_replace(w, r"\p{M}", ""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def word_array(c: Column) -> Column:
    """array<string>: the words of ``split_words`` without their spacing."""
    apart = F.regexp_replace(F.regexp_replace(c, "\u00ad", ""), f"([{CJK}])", " $1 ")
    return F.filter(F.split(apart, f"[{SPACE}]+"), lambda w: w != "")


def split_words(c: Column) -> Column:
    """array<struct<text, space>>: words between white space, each CJK character by itself; space: white space follows. No soft hyphens."""
    parts = F.regexp_extract_all(F.regexp_replace(c, "\u00ad", ""), F.lit(f"(?:[{CJK}]|[^{SPACE}{CJK}]+)[{SPACE}]*"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_replace(x, f"[{SPACE}]+$", "").alias("text"), x.rlike(f"[{SPACE}]$").alias("space")))


def same_text(a: Column, b: Column) -> Column:
    return fold(nfkc(a)) == fold(nfkc(b))


def core(c: Column) -> Column:
    """Without apostrophes and hyphens."""
    return F.regexp_replace(c, "['-]", "")


def marks(c: Column) -> Column:
    """What is no letter or digit."""
    return F.regexp_replace(fold(nfkc(c)), r"[\p{L}\p{N}]", "")


def slug(c: Column) -> Column:
    """A name part: decomposed, lower case, other runs as one hyphen, 40 characters at most."""
    bare = F.regexp_replace(F.lower(nfkd(c)), r"\p{M}", "")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40), "-$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which limits on shown text are stated."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def similar(a: Column, b: Column) -> Column:
    """Both of 4 characters or more, and an edit distance of at most a quarter of the longer one; never over 63 characters unless equal."""
    la, lb = F.length(a), F.length(b)
    most = F.floor(F.greatest(la, lb) / 4).cast("int")
    near = F.levenshtein(a, b) <= most
    return (F.least(la, lb) >= 4) & (F.abs(la - lb) <= most) & F.when(lb < 64, near).otherwise(a == b)


def cut(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if some are cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def word_list(words: Column, listed: int = 50, most: int = 40) -> Column:
    """struct<count, words>: how many, and the first ones cut to length."""
    return F.struct(F.size(words).alias("count"), F.transform(F.slice(words, 1, listed), lambda w: cut(w, most)).alias("words"))


def plain(c: Column) -> Column:
    """Control characters as spaces."""
    return F.regexp_replace(c, r"[\x{0000}-\x{001F}\x{007F}-\x{009F}]", " ")


def quote(c: Column, most: int = 2000) -> Column:
    """A JSON string of the first characters, with the number of those left out."""
    head = F.to_json(F.struct(F.substring(c, 1, most).alias("s")))
    text = F.substring(head, F.lit(6), F.length(head) - 6)  # without {"s": and }
    return F.concat(text, F.when(F.length(c) > most, F.concat(F.lit(" ["), (F.length(c) - most).cast("string"), F.lit(" more characters not shown]"))).otherwise(""))


def escape_xml(c: Column) -> Column:
    """Markup characters as entities; characters that XML 1.0 doesn't allow are dropped."""
    out = F.regexp_replace(c, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rounded(c: Column, digits: int = 1) -> Column:
    """Half up, also below zero: floor(x + 0.5) at the given digit."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale
