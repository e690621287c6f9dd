"""Further queries: operators over generated tables, with SQL that works the answer out from the same rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, content, forms, geometry, placement, report, review, structure, tagtree, words
from ..sources.readers import read_table
from .queries import SPACE, WORDS, _from, _values, _word_rows, _words, query

BOXES = ("x0", "y0", "x1", "y1")


def _box(*corners):
    return F.struct(*(F.expr(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for n, c in zip(BOXES, corners)))


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


# Text


@query(f"SELECT conv_id, turn, len(l) AS words, CAST(list_sum([length(x) for x in l]) AS BIGINT) AS letters, NOT regexp_matches(text, '[{SPACE}]$') AS ends FROM (SELECT *, {WORDS.replace('text', 'coalesce(text)')} AS l FROM conversations) WHERE len(l) > 0")
def split_words(spark, sf_dir):
    """Words of each turn with their spacing: how many, their characters, and that white space follows all but the last."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.split_words(F.trim("text")).alias("l"), "text").where("size(l) > 0")
    letters = F.aggregate("l", F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w["text"]))
    spaced = F.forall(F.slice("l", F.lit(1), F.size("l") - 1), lambda w: w["space"]) & ~F.element_at("l", -1)["space"]
    return turns.select("conv_id", "turn", F.size("l").cast("bigint").alias("words"), letters.alias("letters"), (spaced & ~F.col("text").rlike(f"[{text.SPACE}]$")).alias("ends"))


@query(f"""
    SELECT text, trim(left(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') AS slug, regexp_replace(text, '[''-]', '', 'g') AS core
    FROM (SELECT DISTINCT text FROM {_word_rows("doc_id", "documents")})""")
def slugs(spark, sf_dir):
    """Every word as a name part, and without apostrophes and hyphens."""
    w = _words(read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), "doc_id").select("text").distinct()
    return w.select("text", text.slug(F.col("text")).alias("slug"), text.core(F.col("text")).alias("core"))


@query("SELECT o_orderkey, floor(o_totalprice * 10e0 + 0.5) / 10e0 AS tenth, floor(-o_totalprice * 1e0 + 0.5) / 1e0 AS whole FROM orders")
def rounded_numbers(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders", spread=True)
    return orders.select("o_orderkey", text.rounded(F.col("o_totalprice")).alias("tenth"), text.rounded(-F.col("o_totalprice"), 0).alias("whole"))


# Places on pages

LINES = f"(SELECT item_id, n, text, 20e0 + n % 10 * 50 AS x0, 100e0 + n // 10 * 15 AS y0, 60e0 + n % 10 * 50 AS x1, 110e0 + n // 10 * 15 AS y1 FROM {_word_rows('item_id', 'benchmark')})"


def _lines(spark, sf_dir):
    """Words of the items, ten a line."""
    n = F.col("n")
    w = _words(read_table(spark, sf_dir, "benchmark"), "item_id")
    return w.select("item_id", n.alias("word_ord"), "text", _box(n % 10 * 50 + 20, F.floor(n / 10) * 15 + 100, n % 10 * 50 + 60, F.floor(n / 10) * 15 + 110).alias("box"))


REGIONS = ("(0, 0, 90, 200, 130), (1, 115, 105, 300, 112), (2, 500, 0, 600, 50), (3, 75, 112, 125, 128)", "k, a0, b0, a1, b1")
_COVERED = "least(x1, a1) > greatest(x0, a0) AND least(y1, b1) > greatest(y0, b0) AND (least(x1, a1) - greatest(x0, a0)) * (least(y1, b1) - greatest(y0, b0)) >= {0} * (x1 - x0) * (y1 - y0)"


@query(f"SELECT item_id, k, string_agg(text, ' ' ORDER BY n) AS text FROM {LINES} JOIN {_from(REGIONS)} ON {_COVERED.format('3e-1')} GROUP BY item_id, k")
def words_in_boxes(spark, sf_dir):
    """What lies under four boxes of each page."""
    lines = _lines(spark, sf_dir)
    boxes = _values(spark, REGIONS).select("k", _box("a0", "b0", "a1", "b1").alias("box"))
    pages = lines.select("item_id").distinct().withColumn("one", F.lit(1)).join(boxes.withColumn("one", F.lit(1)), "one").drop("one")
    return geometry.words_under(pages, lines, ["item_id"], "k")


@query(f"SELECT item_id, n AS word_ord FROM {LINES} AS w WHERE NOT EXISTS (SELECT 1 FROM {_from(REGIONS)} WHERE k < 3 AND {_COVERED.format('5e-1')})")
def words_outside_fields(spark, sf_dir):
    """Words that are in none of three form fields."""
    lines = _lines(spark, sf_dir)
    fields = _values(spark, REGIONS).where("k < 3").select(F.lit(1).alias("one"), _box("a0", "b0", "a1", "b1").alias("box"))
    pages = lines.select("item_id").distinct().withColumn("one", F.lit(1)).join(fields, "one").drop("one")
    return words.without_edge_words(lines, pages, ["item_id"]).select("item_id", F.col("word_ord").cast("bigint").alias("word_ord"))


@query(f"""
    SELECT item_id, count(*) FILTER (WHERE x0 BETWEEN 60 AND 300 AND y0 BETWEEN 100 AND 120) AS inside,
        count(*) FILTER (WHERE near) AS near FROM
        (SELECT *, bool_or(n % 5 = 0 AND abs(y0 - 130) <= 60) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {LINES}) GROUP BY item_id""")
def label_neighbours(spark, sf_dir):
    """Words that begin in a box, and words with a matched one (every fifth) within three places and 60 points of a label."""
    lines = _lines(spark, sf_dir).withColumn("matched", F.col("word_ord") % 5 == 0)
    box = _box(F.lit(60), F.lit(100), F.lit(300), F.lit(120))
    near = forms.label_nearby(lines, _box(F.lit(0), F.lit(130), F.lit(50), F.lit(140)), "item_id")
    marked = lines.select("item_id", geometry.inside(F.col("box.x0"), F.col("box.y0"), box).alias("i"), near.alias("n"))
    return marked.groupBy("item_id").agg(F.count_if("i").alias("inside"), F.count_if("n").alias("near"))


@query("""
    WITH f AS (SELECT page, k FROM range(1, 31) AS p(page), range(0, 5) AS t(k) WHERE k < page % 5), i AS (SELECT page, k FROM range(1, 31) AS p(page), range(0, 5) AS t(k) WHERE k < page % 3)
    SELECT page, f.k AS image, page * 10 + f.k AS op FROM f JOIN i USING (page, k) WHERE page % 5 = page % 3""")
def figure_images(spark, sf_dir):
    """Figures with the page image of their number, where a page has as many of both."""
    every = spark.range(1, 31).withColumnRenamed("id", "page").withColumn("image", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    figures = every.where("image < page % 5").withColumn("images", F.col("page") % 5)
    images = every.where("image < page % 3").withColumn("op", F.col("page") * 10 + F.col("image"))
    return geometry.figures_to_images(figures, images, ["page"]).select("page", "image", "op")


# Structure

FORM = """<fieldset><legend>Group {0}</legend><label><input type="radio" name="r{0}" value="a"> Yes</label><label><input type="radio" name="r{0}" value="b"> No</label></fieldset><label for="t{0}">Name {0}</label><input id="t{0}" name="n{0}"><p>Which way? <label><input type="checkbox" name="c{0}" value="x"> Left {0}</label></p><input name="u{0}" aria-label="Said {0}"><select name="s{0}"><option value="1">One<option>Two</select><textarea name="m{0}"></textarea><input type="hidden" name="h{0}">"""


@query("""
    SELECT page_id, ord, name || page_id AS name, label || CASE WHEN numbered THEN ' ' || page_id ELSE '' END AS label, CASE grp WHEN 'G' THEN 'Group ' || page_id END AS grp, type, value, options
    FROM pages, (VALUES (0, 'r', 'Yes', false, 'G', 'radio', 'a', 0), (1, 'r', 'No', false, 'G', 'radio', 'b', 0), (2, 'n', 'Name', true, NULL, 'text', NULL, 0), (3, 'c', 'Left', true, NULL, 'checkbox', 'x', 0), (4, 'u', 'Said', true, NULL, 'text', NULL, 0), (5, 's', '', false, NULL, 'combobox', NULL, 2), (6, 'm', '', false, NULL, 'multiline', NULL, 0)) AS t(ord, name, label, numbered, grp, type, value, options)""")
def form_controls(spark, sf_dir):
    """A form on each page: its controls with label, group, type and choices."""
    parts = FORM.split("{0}")
    html = F.concat(*(x for p in parts[:-1] for x in (F.lit(p), F.col("page_id"))), F.lit(parts[-1]))
    pages = read_table(spark, sf_dir, "pages", spread=True).select("page_id", html.alias("html"))
    nodes = structure.exploded(structure.page_structure(pages), "nodes").where("form is not null").select("page_id", "node_id", "form.*")
    order = F.row_number().over(_by("page_id", "node_id")) - 1
    return nodes.select("page_id", order.alias("ord"), "name", "label", "grp", "type", "value", F.coalesce(F.size("options"), F.lit(0)).alias("options")).withColumn("options", F.greatest(F.lit(0), "options"))


@query("""
    SELECT page_id, 'L' AS list, k AS item, CASE WHEN page_id % 3 = 0 THEN (page_id % 50 + k) || '.' WHEN page_id % 3 = 1 THEN '•' ELSE 'term' || k END AS label, 'body' || k AS body
    FROM pages, range(0, 3) AS t(k)""")
def list_items(spark, sf_dir):
    """A list on each page, numbered from some number, of bullets, or of definitions: the labels and bodies of its items."""
    page = F.col("page_id")
    ol = F.concat(F.lit("<ol start="), page % 50, F.lit("><li>body0<li>body1<li>body2</ol>"))
    html = F.when(page % 3 == 0, ol).when(page % 3 == 1, "<ul><li>body0</li><li>body1</li><li>body2</li></ul>").otherwise("<dl><dt>term0<dd>body0<dt>term1<dd>body1<dt>term2<dd>body2</dl>")
    built = structure.page_structure(read_table(spark, sf_dir, "pages", spread=True).select("page_id", html.alias("html")))
    said = structure.element_text(structure.exploded(built, "words"), "page_id")
    nodes = structure.exploded(built, "nodes").select("page_id", "node_id", "parent_id", "ord", "type")
    parts = nodes.where("type in ('Lbl', 'LBody')").join(said, ["page_id", "node_id"])
    own = nodes.where("type = 'LI'").select("page_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("item"))
    return parts.join(own, ["page_id", "parent_id"]).groupBy("page_id", F.lit("L").alias("list"), F.col("item").cast("bigint").alias("item")).agg(F.max(F.when(F.col("type") == "Lbl", F.col("text"))).alias("label"), F.max(F.when(F.col("type") == "LBody", F.col("text"))).alias("body"))


@query("""
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Note' ELSE 'P' END AS target, CASE WHEN page_id % 4 < 2 THEN 'Reference' ELSE 'P' END AS above, CASE WHEN page_id % 4 < 2 THEN '#t' ELSE 'https://x.example/' || page_id END AS href
    FROM pages""")
def link_targets(spark, sf_dir):
    """A link on each page, out of it, to a heading, or to a paragraph, which becomes a note."""
    page = F.col("page_id")
    href = F.when(page % 4 < 2, "#t").otherwise(F.concat(F.lit("https://x.example/"), page))
    html = F.concat(F.lit("<p>go <a href='"), href, F.lit("'>there</a></p>"), F.when(page % 4 == 1, "<h2 id=t>there</h2><p>end</p>").otherwise("<p id=t>end</p>"))
    nodes = structure.exploded(structure.page_structure(read_table(spark, sf_dir, "pages", spread=True).select("page_id", html.alias("html"))), "nodes")
    links = nodes.where("type = 'Link'").select("page_id", F.col("parent_id").alias("node_id"), "href")
    above = links.join(nodes.select("page_id", "node_id", F.col("type").alias("above")), ["page_id", "node_id"])
    last = nodes.where("parent_id = 0").groupBy("page_id").agg(F.max_by("type", "node_id").alias("target"))
    return above.join(last, "page_id").select("page_id", "target", "above", "href")


@query("SELECT page_id, k - 1 AS mcid FROM pages, range(1, 4) AS t(k) WHERE k <= 1 + page_id % 3")
def content_numbers(spark, sf_dir):
    """Marked-content numbers of a page's paragraphs."""
    pages = read_table(spark, sf_dir, "pages", spread=True).select("page_id", F.repeat(F.lit("<p>x</p>"), (1 + F.col("page_id") % 3).cast("int")).alias("html"))
    nodes = structure.exploded(structure.page_structure(pages), "nodes")
    return tagtree.content_ids(nodes, "page_id").select("page_id", F.col("mcid").cast("bigint").alias("mcid"))


# Checks and reviews

OPERATORS = (", ".join(f"({p}, {k}, '{o}')" for p, s in enumerate(("BT ET", "BT BT ET", "ET BT", "BT Tj ET BT ET", "q", "BT q ET Q BT"), 1) for k, o in enumerate(s.split())), "page, op_ord, op")


@query(f"""
    SELECT page, min(d) >= 0 AND arg_max(d, op_ord) = 0 AS balanced FROM (SELECT *, sum(CASE op WHEN 'BT' THEN 1 WHEN 'ET' THEN -1 ELSE 0 END) OVER (PARTITION BY page ORDER BY op_ord) AS d FROM {_from(OPERATORS)}) GROUP BY page""")
def balanced_text(spark, sf_dir):
    return tagtree.balanced(_values(spark, OPERATORS), "BT", "ET", "page")


ANNOTATIONS = (", ".join(f"({k}, '{s}', {f})" for k, (s, f) in enumerate((s, f) for s in ("Link", "Popup", "Widget") for f in ("NULL", 0, 1, 2, 4, 32, 34, 6))), "k, subtype, flags")


@query(f"SELECT k, subtype <> 'Popup' AND coalesce(flags, 0) & 34 = 0 AS tagged FROM {_from(ANNOTATIONS)}")
def annotations_to_tag(spark, sf_dir):
    return _values(spark, ANNOTATIONS).select("k", tagtree.needs_tags(F.col("subtype"), F.col("flags").cast("int")).alias("tagged"))


CLAIMS = ("(1, true, true), (1, true, true), (2, true, false), (2, true, true), (3, NULL, true), (4, false, false)", "doc, fonts, tags")


@query(f"SELECT doc, bool_and(coalesce(fonts, false) AND coalesce(tags, false)) AS claim FROM {_from(CLAIMS)} GROUP BY doc")
def standard_claims(spark, sf_dir):
    return tagtree.may_claim(_values(spark, CLAIMS), ["fonts", "tags"], "doc")


FONTS = ("(1, 'A', true, true, 'TrueType'), (1, 'B', true, false, 'Type1'), (1, 'C', true, false, 'Type3'), (2, 'B', false, false, 'Type1'), (2, 'D', true, false, 'Type0'), (2, 'D', true, false, 'Type0')", "doc, font, used, embedded, subtype")


@query(f"""
    SELECT doc, font, 'unembedded' AS what FROM {_from(FONTS)} WHERE used AND NOT embedded AND subtype <> 'Type3' GROUP BY ALL
    UNION ALL SELECT 9, font, 'new' FROM (SELECT font FROM {_from(FONTS)} WHERE doc = 2 EXCEPT SELECT font FROM {_from(FONTS)} WHERE doc = 1)""")
def font_audit(spark, sf_dir):
    """Fonts in use without a program, and fonts of the second file that the first lacks."""
    fonts = _values(spark, FONTS)
    one = lambda d: fonts.where(F.col("doc") == d).withColumn("doc", F.lit(9))
    return audit.unembedded_fonts(fonts, "doc").withColumn("what", F.lit("unembedded")).union(audit.new_fonts(one(1), one(2), "doc").withColumn("what", F.lit("new")))


@query("""
    WITH g AS (SELECT f, cid, 400 + cid * 10 + CASE WHEN f = 2 AND cid = 30 THEN 5 WHEN f = 3 THEN 1 ELSE 0 END AS advance FROM range(1, 6) AS a(f), range(0, 40) AS b(cid) WHERE f < 4 OR cid < 20),
    w AS (SELECT f, cid, CASE WHEN f = 5 AND cid >= 10 THEN 1000 ELSE 400 + cid * 10 END AS stated FROM g)
    SELECT 'F' || f AS font FROM g JOIN w USING (f, cid) WHERE abs(stated - advance) > 1 GROUP BY f""")
def font_widths(spark, sf_dir):
    """Fonts with a glyph whose stated width isn't its advance: one is off by five, one by no more than a unit, one states too few."""
    g = spark.range(1, 6).select(F.col("id").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("cid")).where("f < 4 or cid < 20")
    advance = 400 + F.col("cid") * 10 + F.when((F.col("f") == 2) & (F.col("cid") == 30), 5).when(F.col("f") == 3, 1).otherwise(0)
    font = F.concat(F.lit("F"), "f").alias("font")
    glyphs = g.select(F.lit(1).alias("doc"), font, "cid", advance.cast("double").alias("advance"), F.lit(None).cast("double").alias("default_width"))
    widths = g.where("f < 5 or cid < 10").select(F.lit(1).alias("doc"), font, F.col("cid").alias("first"), F.col("cid").alias("last"), (400 + F.col("cid") * 10).cast("double").alias("width"))
    return audit.width_mismatches(glyphs, widths, "doc").select("font")


LAYERS = ("(1, true), (1, false), (2, false), (3, NULL), (3, false)", "doc, auto_state")


@query(f"SELECT doc, bool_or(auto_state) AS layers_switch FROM {_from(LAYERS)} GROUP BY doc")
def layer_states(spark, sf_dir):
    return audit.layers_switch_themselves(_values(spark, LAYERS), "doc")


@query("""
    WITH d AS (SELECT DISTINCT doc_id FROM documents), p AS (SELECT doc_id, k AS page, (doc_id * k) % 7 AS differing FROM d, range(1, 4) AS t(k)), t AS (SELECT doc_id, 1 + doc_id % 3 AS page FROM d WHERE doc_id % 5 = 0)
    SELECT doc_id, CASE WHEN coalesce(sum(differing), 0) > 0 THEN 'failed' ELSE 'identical-outside-fields' END AS pixels, CAST(coalesce(sum(differing), 0) AS BIGINT) AS differing_pixels, doc_id % 5 <> 0 AS text_preserved,
        CASE WHEN sum(differing) > 0 THEN 'pixels_changed' WHEN doc_id % 5 = 0 THEN 'text_lost' END AS error FROM p GROUP BY doc_id""")
def verification_report(spark, sf_dir):
    """Both checks of each document rolled up."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id").distinct()
    pixels = docs.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("differing", F.col("doc_id") * F.col("page") % 7)
    texts = docs.where("doc_id % 5 = 0").select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("page"), F.lit(1).alias("missing"), F.lit(0).alias("overlay_missing"))
    return audit.verification(pixels, texts, docs)


@query("SELECT user_id % 20 AS doc, CAST(sum(event_id % 900) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN event_id % 4 > 0 THEN event_id % 70 ELSE 0 END) AS BIGINT) AS output_tokens FROM events GROUP BY 1")
def review_usage(spark, sf_dir):
    """Tokens of replies, written as JSON, some without a count, added up."""
    k = F.col("event_id")
    out = F.when(k % 4 > 0, F.concat(F.lit(',"output_tokens":'), k % 70)).otherwise("")
    replies = read_table(spark, sf_dir, "events", spread=True).select((F.col("user_id") % 20).alias("doc"), F.parse_json(F.concat(F.lit('{"usage":{"input_tokens":'), k % 900, out, F.lit("}}"))).alias("reply"))
    return review.usage(replies, "doc")


@query("""
    WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad_pages' WHEN doc_id % 7 = 0 THEN 'timeout' END AS error FROM documents), b AS (SELECT doc_id FROM a WHERE doc_id % 2 = 0)
    SELECT doc_id, CASE WHEN error = 'bad_pages' AND doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS source, CASE WHEN error = 'bad_pages' AND doc_id % 2 = 0 THEN NULL ELSE error END AS error FROM a""")
def fallback_reports(spark, sf_dir):
    """A document's first report, or, if it failed in one way and there is one, the second."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    first = docs.select("doc_id", F.lit("first").alias("source"), F.when(F.col("doc_id") % 3 == 0, "bad_pages").when(F.col("doc_id") % 7 == 0, "timeout").alias("error"))
    second = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("second").alias("source"), F.lit(None).cast("string").alias("error"))
    return report.with_fallback(first, second, ["bad_pages"])


@query("""
    WITH f AS (SELECT o_orderkey AS doc, k, 'f' || k AS name, CASE k % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'signature' ELSE 'checkbox' END AS type, (o_orderkey + k) % 4 = 0 AS readonly FROM orders, range(0, 5) AS t(k))
    SELECT doc, count(*) FILTER (WHERE NOT readonly) AS set, count(*) FILTER (WHERE readonly) AS skipped_read_only FROM f WHERE type <> 'signature' AND k < 4 GROUP BY doc""")
def fields_set(spark, sf_dir):
    """Values set in each form, signatures left out, read-only fields counted apart."""
    k = F.col("k")
    every = read_table(spark, sf_dir, "orders", spread=True).select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    fields = every.select("doc", F.concat(F.lit("f"), k).alias("name"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "signature").otherwise("checkbox").alias("type"), ((F.col("doc") + k) % 4 == 0).alias("readonly"))
    values = every.where("k < 4").select("doc", F.concat(F.lit("f"), k).alias("name"))
    widgets = every.select("doc", F.concat(F.lit("f"), k).alias("name"), F.lit(1).alias("page"), _box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("rect"))
    return forms.set_counts(values, fields, widgets, "doc")[0]


@query("""
    WITH n AS (SELECT conv_id, turn AS k, 'P' AS type, left(text, 20) AS text FROM conversations)
    SELECT conv_id, least(count(*), 3) AS kept, count(*) > 3 AS truncated FROM n GROUP BY conv_id""")
def capped_trees(spark, sf_dir):
    """At most three elements of each conversation's tree, and whether some were left out."""
    turns = read_table(spark, sf_dir, "conversations")
    tree = turns.select("conv_id", F.lit("P").alias("type"), F.substring("text", 1, 20).alias("text"), F.array(F.col("turn")).alias("path"))
    return tagtree.capped(tree, "conv_id", elements=3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"), F.bool_or("truncated").alias("truncated"))


# Content streams and places

_CMAP = "1 beginbfrange <{0}> <{1}> <0041> endbfrange"


@query(f"SELECT item_id, n // 3 AS mcid, string_agg(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '' ORDER BY n) AS text FROM {_word_rows('item_id', 'benchmark')} GROUP BY item_id, n // 3")
def marked_content(spark, sf_dir):
    """Each item as a stream of marked content, three words a sequence, in codes of two bytes that a character map reads: the texts again."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    w = _words(read_table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "n", letters.alias("l"))
    w = w.withColumn("last", F.lead("n").over(_by("item_id", "n")).isNull())
    shift = F.array_join(F.transform(F.filter(F.split("l", ""), lambda c: c != ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c) - 65 + 4660), 4, "0"))), "")
    begin = F.when(F.col("n") % 3 == 0, F.concat(F.lit("/P <</MCID "), F.floor(F.col("n") / 3), F.lit(">> BDC BT /F1 9 Tf "))).otherwise("")
    op = F.concat(begin, F.lit("<"), shift, F.lit("> Tj"))
    end = F.when((F.col("n") % 3 == 2) | F.col("last"), " ET EMC").otherwise("")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(op, end).alias("s")))), lambda x: x["s"]), "\n")
    streams = w.groupBy("item_id").agg(F.encode(lines, "UTF-8").alias("content"))
    fonts = F.array(F.struct(F.lit("F1").alias("name"), F.lit(_CMAP.format("1234", "124d")).alias("cmap"), F.lit(2).alias("width")))
    found = content.marked_texts(streams.withColumn("fonts", fonts), "item_id")
    every = w.select("item_id", F.floor(F.col("n") / 3).cast("int").alias("mcid")).distinct()
    return every.join(found, ["item_id", "mcid"], "left").select("item_id", F.col("mcid").cast("bigint").alias("mcid"), F.coalesce("text", F.lit("")).alias("text"))


@query("""
    SELECT page, k AS image, 10e0 + page + 5 * k AS x0, 20e0 * k AS y0, 10e0 + page + 5 * k + 30 AS x1, 20e0 * k + 15 AS y1, k <> 1 AS own_mark FROM range(0, 40) AS p(page), range(0, 3) AS t(k)""")
def drawn_images(spark, sf_dir):
    """Three images of each page, drawn through nested transformations, the second inside marked content."""
    one = lambda k, a="", z="": F.concat(F.lit(f"q 1 0 0 1 {5 * k} {20 * k} cm {a} q 30 0 0 15 0 0 cm /Im{k} Do Q {z} Q\n"))
    body = F.concat(F.lit("q 1 0 0 1 10 0 cm 1 0 0 1 "), F.col("page"), F.lit(" 0 cm\n"), one(0), one(1, "/P <</MCID 1>> BDC", "EMC"), one(2), F.lit("/Fm0 Do Q"))
    streams = spark.range(40).withColumnRenamed("id", "page").select("page", F.encode(body, "UTF-8").alias("content"), F.array(*map(F.lit, ("Im0", "Im1", "Im2"))).alias("images"), F.lit(None).cast("array<double>").alias("transform"))
    found = content.drawn_images(streams, "page")
    return found.select("page", (F.row_number().over(_by("page", "op_ord")) - 1).cast("bigint").alias("image"), *(F.col(f"box.{c}").alias(c) for c in BOXES), "own_mark")


@query(f"""
    SELECT item_id, string_agg(CASE n % 3 WHEN 0 THEN 'q' WHEN 1 THEN '/OC /x BDC' ELSE 'EMC' END, ' ' ORDER BY n) AS content
    FROM (SELECT item_id, unnest(range(0, 3 * (1 + len(l) // 20))) AS n FROM (SELECT item_id, {WORDS} AS l FROM benchmark)) GROUP BY item_id""")
def unmarked_content(spark, sf_dir):
    """Streams with marks of two kinds: those that a structure owns go, optional content stays."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", (1 + F.floor(F.size(F.filter(F.split("text", f"[{text.SPACE}]+"), lambda x: x != "")) / 20)).cast("int").alias("k"))
    body = F.repeat(F.lit("/P <</MCID 3>> BDC q EMC /T MP /OC /x BDC EMC\n"), F.col("k"))
    out = content.without_marks(items.select("item_id", F.encode(body, "UTF-8").alias("content")), "item_id")
    return out.select("item_id", F.trim(F.regexp_replace(F.decode("content", "UTF-8"), r"\s+", " ")).alias("content"))


@query("""
    SELECT k, 0 AS arg, CASE k % 4 WHEN 0 THEN 'a' || k || '(b)' WHEN 1 THEN chr(65 + CAST(k AS INT) % 20) || '~' WHEN 2 THEN 'x' || chr(10) || 'y' ELSE chr(40) || chr(65) END AS s FROM range(0, 40) AS t(k)""")
def string_operands(spark, sf_dir):
    """Strings of a stream as bytes: nested brackets, hexadecimal of odd length, line ends, escapes."""
    k = F.col("k")
    literal = F.concat(F.lit("(a"), k, F.lit("(b))"))
    hexa = F.concat(F.lit("< "), F.hex(65 + k % 20), F.lit(" 7 E>"))
    op = F.when(k % 4 == 0, literal).when(k % 4 == 1, hexa).when(k % 4 == 2, F.lit("(x\r\ny)")).otherwise(F.lit("(\\(\\101)"))
    streams = spark.range(40).withColumnRenamed("id", "k").select("k", F.encode(F.concat(op, F.lit(" Tj")), "UTF-8").alias("content"))
    return content.decoded_strings(streams, "k").select("k", "arg", F.decode("bytes", "ISO-8859-1").alias("s"))


@query(f"""
    WITH w AS (SELECT item_id, n, length(text) AS c FROM {_word_rows("item_id", "benchmark")}),
    a AS (SELECT *, sum(c * 5e0 + 5) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
    SELECT item_id, n AS word_ord, 10 + coalesce(before, 0) AS x0, 10 + coalesce(before, 0) + c * 5e0 AS x1, 20e0 AS baseline FROM a""")
def flowing_words(spark, sf_dir):
    """Words without a place on a very wide page: one after the other, five points a character and five a space."""
    w = _words(read_table(spark, sf_dir, "benchmark"), "item_id")
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    word = F.struct("n", "text", F.lit(True).alias("space"), F.lit(False).alias("new_line"), none.alias("box"), F.lit(None).cast("double").alias("baseline"), F.lit(None).cast("double").alias("size"))
    pages = w.groupBy("item_id").agg(F.array_sort(F.collect_list(word)).alias("words")).withColumns({"width": F.lit(1e6), "height": F.lit(792.0)})
    out = placement.flow_words(pages, "item_id")
    return out.select("item_id", F.col("word_ord").cast("bigint").alias("word_ord"), F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"), "baseline")


@query(f"""
    WITH w AS (SELECT item_id, n, text, lead(text) OVER (PARTITION BY item_id ORDER BY n) AS after FROM {_word_rows("item_id", "benchmark")})
    SELECT item_id, n AS token, k AS word_ord, CASE k WHEN 0 THEN 0 ELSE length(text) + 1 END AS first, CASE k WHEN 0 THEN length(text) ELSE length(text) + 1 + length(after) END AS "end" FROM w, range(0, 2) AS t(k) WHERE n % 2 = 0 AND after IS NOT NULL""")
def shared_tokens(spark, sf_dir):
    """Two words drawn as one, with a dash between them: each one's characters of it."""
    w = _words(read_table(spark, sf_dir, "benchmark"), "item_id")
    both = w.withColumn("after", F.lead("text").over(_by("item_id", "n"))).where("n % 2 = 0 and after is not null")
    words_ = F.array(F.struct(F.lit(0).alias("word_ord"), "text"), F.struct(F.lit(1).alias("word_ord"), F.col("after").alias("text")))
    tokens = both.select("item_id", F.col("n").alias("token"), F.concat("text", F.lit("—"), "after").alias("drawn"), words_.alias("words"), F.lit(0).alias("low"), F.lit(1).alias("high"))
    return placement.drawn_parts(tokens, "item_id", "token")


@query("""
    SELECT page, c AS code, CASE WHEN page % 3 = 0 THEN 1 + (c - 1) // 4 WHEN c <= 8 THEN 1 ELSE 2 END AS segment FROM range(1, 25) AS p(page), range(1, 13) AS t(c) WHERE page % 3 < 2 AND (c - 1) % 4 < 3 OR page % 3 = 1 AND c = 4""")
def code_owners(spark, sf_dir):
    """Codes of three words of a page, three each with a blank after them: words that own theirs alone, words of two runs, words that all claim one code."""
    rows = []
    for page in range(1, 25):
        codes = {w: [4 * w + c for c in (1, 2, 3)] + ([12] if page % 3 == 2 else []) for w in range(3)}
        inked = [c for c in range(1, 13) if (c - 1) % 4 < 3] + [8]
        rows.append((page, [[0, 1], [2]], codes, [0, 1, 2] if page % 3 == 0 else [], [0] * 12, [c for c in inked if c != 8] if page % 3 else inked))
    pages = spark.createDataFrame(rows, "page long, runs array<array<int>>, codes map<int,array<int>>, alone array<int>, objects array<int>, inked array<int>")
    return placement.code_segments(pages, "page").select("page", F.col("code").cast("bigint").alias("code"), F.col("segment").cast("bigint").alias("segment"))
