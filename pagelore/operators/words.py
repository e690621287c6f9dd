"""Words as they stand on pages: reading them from characters or TSV, hyphens, furniture, lost words, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, is_cjk, normalize

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box_union(c: str = "box") -> Column:
    return F.struct(F.min(f"{c}.x0").alias("x0"), F.min(f"{c}.y0").alias("y0"), F.max(f"{c}.x1").alias("x1"), F.max(f"{c}.y1").alias("y1"))


def words_from_chars(chars: DataFrame, *keys: str) -> DataFrame:
    """(keys, word_ord, text, box, baseline, size) from (char_ord, c, line, size, baseline, box): words end at white space, at a line,
    around each CJK character, and where the size changes by over 0.5 (but not at a prime)."""
    w = Window.partitionBy(*keys).orderBy("char_ord")
    before = lambda c: F.lag(c).over(w)
    blank = F.col("c").rlike(f"[{SPACE}]")
    prime = F.col("c").rlike(r"[\x{2032}-\x{2037}\x{2057}']")
    starts = before("c").isNull() | before("c").rlike(f"[{SPACE}]") | (before("line") != F.col("line")) | is_cjk(F.col("c")) | is_cjk(before("c")) | ((F.abs(before("size") - F.col("size")) > 0.5) & ~prime)
    marked = chars.withColumn("__new", (starts & ~blank).cast("int")).withColumn("__w", F.sum("__new").over(w)).where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_ord", "c"))), lambda x: x["c"]), "")
    return marked.groupBy(*keys, (F.col("__w") - 1).alias("word_ord")).agg(text.alias("text"), box_union().alias("box"), F.min_by("baseline", "char_ord").alias("baseline"), F.min_by("size", "char_ord").alias("size"))


def words_from_tsv(tsv: DataFrame, text: str, scale: float, *keys: str) -> DataFrame:
    """Recognised words from TSV text: rows of level 5 with some text, pixels times scale; baseline is the bottom, size the height."""
    rows = tsv.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "row")).where("pos > 0")
    cells = F.split("row", "\t")
    at = lambda k: F.get(cells, F.lit(k)).try_cast("double") * scale
    word = F.get(cells, F.lit(11))
    kept = rows.where((F.get(cells, F.lit(0)) == "5") & word.rlike(f"[^{SPACE}]"))
    box = F.struct(at(6).alias("x0"), at(7).alias("y0"), (at(6) + at(8)).alias("x1"), (at(7) + at(9)).alias("y1"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return kept.select(*keys, order.alias("word_ord"), word.alias("text"), box.alias("box"), box["y1"].alias("baseline"), at(9).alias("size"))


def join_hyphenated(words: DataFrame, *keys: str, ascii_only: bool = False) -> DataFrame:
    """(keys, tok_ord, norm, word_ords): a word that ends in a letter and a hyphen, and a lower-case word on a lower line, are one token.

    A word that was joined doesn't start another join: in a chain, every second link counts.
    """
    w = Window.partitionBy(*keys).orderBy("word_ord")
    after = lambda c: F.lead(c).over(w)
    can = F.coalesce((after("box.y0") > (F.col("box.y0") + F.col("box.y1")) / 2) & F.col("text").rlike(r"\p{L}-$") & after("text").rlike(r"^\p{Ll}"), F.lit(False))
    marked = words.withColumns({"__can": can, "__next": after("text"), "__n": F.row_number().over(w)})
    chain = marked.withColumn("__last", F.max(F.when(~F.col("__can"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("__can") & ((F.col("__n") - F.coalesce("__last", F.lit(0))) % 2 == 1)
    joined = chain.withColumn("__first", first).withColumn("__second", F.coalesce(F.lag("__first").over(w), F.lit(False))).where("not __second")
    text = F.when(F.col("__first"), F.concat(F.expr("substring(text, 1, length(text) - 1)"), "__next")).otherwise(F.col("text"))
    ords = F.when(F.col("__first"), F.array(F.col("word_ord"), F.col("word_ord") + 1)).otherwise(F.array("word_ord"))
    return joined.select(*keys, (F.row_number().over(w) - 1).alias("tok_ord"), normalize(text, ascii_only).alias("norm"), ords.alias("word_ords"))


def at_edge(box: Column, height: Column) -> Column:
    return (box["y1"] <= height * 0.1) | (box["y0"] >= height * 0.9)


def is_furniture(norm: Column, box: Column, height: Column, page: Column) -> Column:
    """Punctuation, the page's number, or anything at the top or bottom edge."""
    return (norm == "") | (norm == page.cast("string")) | at_edge(box, height)


def is_page_number(norm: Column, box: Column, height: Column, page: Column) -> Column:
    return (norm == page.cast("string")) & at_edge(box, height)


def lost_runs(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, run, after_block, words): what was neither matched nor furniture, in runs that only a matched word ends.

    words: (word_ord, text, matched, furniture, block of the match). after_block: the last matched block before the run, or null.
    """
    w = Window.partitionBy(*keys).orderBy("word_ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = words.withColumns({"run": F.sum(F.col("matched").cast("int")).over(w), "after_block": F.last(F.when(F.col("matched"), F.col("block")), ignorenulls=True).over(w)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", "text"))), lambda x: x["text"]), " ")
    return placed.where(~F.col("matched") & ~F.col("furniture")).groupBy(*keys, "run", "after_block").agg(text.alias("words"), F.count(F.lit(1)).alias("n"))


def page_report(html_words: DataFrame, page_words: DataFrame, *keys: str) -> DataFrame:
    """Counters of each page: words, matched, added_from_html, furniture, lost, unmapped.

    html_words: (norm, matched); page_words: (text, matched, furniture). A page on one side only has zeros for the other.
    """
    left = html_words.groupBy(*keys).agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched") & (F.col("norm") != "")).alias("added_from_html"))
    right = page_words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("words"),
        F.count_if(~F.col("matched") & F.col("furniture")).alias("furniture"),
        F.count_if(~F.col("matched") & ~F.col("furniture")).alias("lost"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("unmapped"),
    )
    return left.join(right, list(keys), "full").na.fill(0)


def too_many_words(words: DataFrame, *keys: str, most: int = 4000) -> DataFrame:
    """Pages with more words than are aligned, as error rows."""
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most).withColumn("code", F.lit("too_many_words"))


def laid_out(texts: DataFrame, text: str, *keys: str, width: int = 60, lines: int = 50, height: float = 792.0) -> DataFrame:
    """Words of plain text set in fixed type: (keys, page, word_ord, text, box), by arithmetic that SQL can repeat.

    A word stands at the running sum of the lengths (and a space each) before it; ``width`` characters a line, ``lines`` a page.
    """
    words = texts.select(*keys, F.posexplode(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")).alias("n", "text"))
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    line = F.floor(F.col("at") / width)
    row, step = line % lines, height / lines
    box = F.struct((F.col("at") % width * 6.0).alias("x0"), (row * step).alias("y0"), ((F.col("at") % width + F.length("text")) * 6.0).alias("x1"), (row * step + step * 0.8).alias("y1"))
    return placed.select(*keys, (F.floor(line / lines) + 1).cast("int").alias("page"), F.col("n").alias("word_ord"), "text", box.alias("box"))


def without_edge_words(words: DataFrame, fields: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Words that aren't inside a field's box (by ``share`` of their area): a left anti join by page."""
    from .geometry import overlaps

    w, f = words.alias("w"), fields.select(*keys, F.col("box").alias("__field")).alias("f")
    on = [F.col(f"w.{k}") == F.col(f"f.{k}") for k in keys]
    inside = overlaps(F.col("f.__field"), F.col("w.box"), share)
    cond = inside
    for c in on:
        cond = c & cond
    return w.join(f, cond, "left_anti")


