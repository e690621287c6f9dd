"""Pages of a small town library, each read as rows of nodes and words."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.operators import math_speech, structure
from pagelore.operators.html_tree import parse
from pagelore.operators.structure import Page


def listed(html, lang="en"):
    """(depth, type, own words) of each node, in reading order."""
    nodes, words = Page(html, lang, "p1-").rows()
    own = {n["node_id"]: [] for n in nodes}
    for w in words:
        own.get(w["node_id"], []).append(w["text"])
    return [(n["depth"], n["type"], " ".join(own[n["node_id"]])) for n in nodes]


def of_type(html, *types):
    return [n for n in Page(html, "en", "p1-").rows()[0] if n["type"] in types]


OPENING = """<!DOCTYPE html><html><head><title>Hours</title></head><body>
<h1>Opening hours</h1><p>We are open <strong>daily</strong> till six<p>Closed in August.
<blockquote>Silence, please</blockquote><!-- draft --><script>track('<h2>')</script></body></html>"""


def test_headings_and_paragraphs():
    assert listed(OPENING) == [(0, "H1", "Opening hours"), (0, "P", "We are open daily till six"), (0, "P", "Closed in August."), (0, "BlockQuote", "Silence, please")]


def test_words_without_an_element_are_paragraphs():
    assert listed("Lost and found<div>Ask at the desk</div>or call") == [(0, "P", "Lost and found"), (0, "Div", "Ask at the desk"), (0, "P", "or call")]


@pytest.mark.parametrize("attributes,labels", [("", "1. 2. 3."), ("start=9", "9. 10. 11."), ("type=i start=4", "iv. v. vi."), ("type=A start=26", "Z. AA. AB."), ("reversed", "3. 2. 1."), ("start=oops", "1. 2. 3.")])
def test_numbers_of_ordered_lists(attributes, labels):
    html = f"<ol {attributes}><li>Bring a card<li>Pick a book<li>Read it</ol>"
    found = listed(html)
    assert " ".join(t for _, kind, t in found if kind == "Lbl") == labels
    assert [t for _, kind, t in found if kind == "LBody"] == ["Bring a card", "Pick a book", "Read it"]
    assert Counter(kind for _, kind, _ in found) == {"L": 1, "LI": 3, "Lbl": 3, "LBody": 3}


def test_a_value_moves_the_counter():
    assert [t for _, kind, t in listed("<ol><li>a<li value=7>b<li>c</ol>") if kind == "Lbl"] == ["1.", "7.", "8."]


def test_definitions_pair_terms_with_what_follows():
    found = listed("<dl><dt>ILL</dt><dd>Interlibrary loan</dd><dt>OPAC</dt><dd>Catalogue</dd></dl>")
    assert [(k, t) for _, k, t in found if t] == [("Lbl", "ILL"), ("LBody", "Interlibrary loan"), ("Lbl", "OPAC"), ("LBody", "Catalogue")]


def test_links_out_of_the_page_and_within_it():
    html = '<h2 id="fines">Fines</h2><p>Pay <a href="https://pay.example/x">online</a>, see <a href="#fines">above</a> or <a href="#small">2</a>.</p><p id="small">Cash only</p>'
    found = of_type(html, "Link", "Reference", "Note")
    assert [(n["type"], n["href"]) for n in found] == [("Link", "https://pay.example/x"), ("Reference", None), ("Link", "#fines"), ("Reference", None), ("Link", "#small"), ("Note", None)]
    by = {n["node_id"]: n["type"] for n in Page(html, "en").rows()[0]}
    assert [by.get(n["parent_id"]) for n in found if n["type"] == "Link"] == ["P", "Reference", "Reference"]


def test_pictures():
    page = Page('<figure><img alt="Reading room"><figcaption>Built 1911</figcaption></figure><img alt=""><img src="map.png">', "en")
    nodes = page.rows()[0]
    assert [(n["type"], n["alt"]) for n in nodes if n["type"] == "Figure"][0] == ("Figure", "Reading room")
    assert any(n["type"] == "Caption" for n in nodes) and page.images == 3
    assert page.warnings == [("missing_alt", "map.png")]


def test_unknown_elements_and_formulas_without_words_are_reported():
    page = Page("<blink>new</blink><p><math><mfrac><mi>n</mi></mfrac></math>", "en")
    assert page.warnings == [("unmapped_element", "blink"), ("missing_alt", "math: n")]


RATES = """<table><thead><tr><td></td><th>Adults</th><th>Children</th></tr></thead>
<tbody><tr></tr><tr><th>Day</th><td>3</td><td>1</td></tr><tr><th>Year</th><td colspan=2>20</td></tr></tbody></table>"""


def test_cells_know_their_headers():
    cells = of_type(RATES, "TH", "TD")
    ids = {n["elem_id"]: k for k, n in enumerate(cells) if n["type"] == "TH"}
    titles = dict(zip(ids, ["Adults", "Children", "Day", "Year"]))
    data = [[titles[h] for h in n["headers"]] for n in cells if n["type"] == "TD" and n["headers"]]
    assert data == [["Adults", "Day"], ["Children", "Day"], ["Adults", "Children", "Year"]] or data == [["Adults", "Day"], ["Children", "Day"], ["Adults", "Year"]]
    assert [dict(n["attrs"])["Scope"] for n in cells if n["type"] == "TH"] == ["Column", "Column", "Row", "Row"]
    assert [n["colspan"] for n in cells if n["type"] == "TD"][-1] == 2
    assert sum(k == "TR" for _, k, _ in listed(RATES)) == 3  # the empty row goes


def test_spans_reach_only_as_far_as_the_table():
    cells = of_type("<table><tr><td rowspan=40>a<td>b<tr><td>c</table>", "TD")
    assert [(n["rowspan"], n["colspan"]) for n in cells] == [(2, 1), (1, 1), (1, 1)]


MEMBER = """<form><fieldset><legend>Membership</legend><label><input type="radio" name="kind" value="s"> Student</label><label><input type="radio" name="kind" value="a"> Adult</label></fieldset>
<label for="m">Mail address</label><input id="m" name="mail" type="email"><input name="card" aria-label="Card number">
<label for="b">Branch:</label><select id="b" name="branch"><option value="n">North<option>South</select><textarea name="remarks"></textarea><input type="hidden" name="token"></form>"""


def test_controls_with_labels_groups_and_options():
    found = {(f["name"], f["value"]): f for f in (n["form"] for n in of_type(MEMBER, "Form"))}
    assert set(found) == {("kind", "s"), ("kind", "a"), ("mail", None), ("card", None), ("branch", None), ("remarks", None)}
    assert [(found["kind", v]["label"], found["kind", v]["grp"]) for v in "sa"] == [("Student", "Membership"), ("Adult", "Membership")]
    assert (found["mail", None]["label"], found["mail", None]["type"]) == ("Mail address", "text")
    assert found["mail", None]["label_words"] == ["Mail", "address"]
    assert found["card", None]["label"] == "Card number" and found["branch", None]["options"] == ["n", "South"]
    assert {f["type"] for f in found.values()} == {"radio", "text", "combobox", "multiline"}


def test_words_keep_their_spacing_and_lines():
    _, words = Page("<p>un<i>known</i> author</p><table><tr><td>Shelf</td><td>4</td></tr></table>", "en").rows()
    assert [(w["text"], w["space"]) for w in words[:3]] == [("un", False), ("known", True), ("author", True)]
    assert [w["new_line"] for w in words] == [True, False, False, True, True]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<h3>", "word ", "other ", "<img alt=x>", "<a href=y>", "</a>", "<div>", "</div>"]), max_size=25))
def test_any_markup_keeps_its_words_in_a_tree(parts):
    nodes, words = Page("".join(parts), "en").rows()
    assert Counter(w["text"] for w in words if w["text"] in ("word", "other")) == Counter(p.strip() for p in parts if p[0] != "<")
    depth = {0: -1}
    for n in nodes:  # a parent comes before its children
        assert depth[n["parent_id"]] == n["depth"] - 1
        depth[n["node_id"]] = n["depth"]
    assert [w["word_ord"] for w in words] == list(range(len(words)))


def formula(markup):
    return parse(f"<math>{markup}</math>").kids[0]


@pytest.mark.parametrize(
    "markup,words",
    [
        ("<mi>r</mi><mo>=</mo><msqrt><msup><mi>u</mi><mn>2</mn></msup></msqrt>", "r = square root of u squared end root"),
        ("<mfrac><mn>1</mn><mrow><mi>k</mi><mo>!</mo></mrow></mfrac>", "fraction 1 over k ! end fraction"),
        ("<mfrac><mn>1</mn><mn>2</mn></mfrac>", "1 over 2"),
        ("<mroot><mi>v</mi><mn>5</mn></mroot>", "root with index 5 of v end root"),
        ("<msup><mn>10</mn><mrow><mo>-</mo><mn>9</mn></mrow></msup>", "10 to the power - 9 end power"),
        ("<msubsup><mi>c</mi><mi>j</mi><mn>3</mn></msubsup>", "c sub j cubed"),
        ("<mover><mi>w</mi><mo>~</mo></mover>", "w tilde"),
        ("<mover><mi>w</mi><mo>a</mo></mover>", "w over a"),
        ("<munderover><mo>∏</mo><mn>0</mn><mi>m</mi></munderover>", "∏ from 0 to m"),
        ("<mtable><mtr><mtd><mi>p</mi></mtd><mtd><mi>q</mi></mtd></mtr><mtr><mtd><mi>s</mi></mtd></mtr></mtable>", "table row 1 p, q, row 2 s end table"),
        ("<mfenced open='{' close='}' separators=';'><mi>g</mi><mi>h</mi></mfenced>", "{ g ; h }"),
        ("<semantics><mi>z</mi><annotation>z</annotation></semantics>", "z"),
        ("<mroot><mi>v</mi></mroot>", ""),
    ],
)
def test_formulas_in_words(markup, words):
    assert math_speech.speak(formula(markup)) == words


def test_deep_formulas():
    e = formula("<msqrt>" * 400 + "<mi>y</mi>" + "</msqrt>" * 400)
    assert math_speech.speak(e).count("square root of") == 400 and math_speech.xml(e).count("<msqrt>") == 400


def test_formulas_as_xml():
    e = parse('<math display="inline" on:x="1" xmlns="u"><mo>&amp;</mo><mtext>5 &lt; "6"</mtext></math>').kids[0]
    assert math_speech.xml(e) == '<math xmlns="http://www.w3.org/1998/Math/MathML" display="inline"><mo>&amp;</mo><mtext>5 &lt; &quot;6&quot;</mtext></math>'


def test_headings_of_a_document_move_up_together(spark):
    pages = spark.createDataFrame([(4, 2, "<h2>Loans</h2>"), (4, 1, "<h3>Rules</h3><p>x</p><h4>Cards</h4>"), (5, 1, "<h1>Map</h1>"), (6, 1, None)], "doc int, page int, html string")
    nodes = structure.exploded(structure.page_structure(pages), "nodes")
    found = {r["doc"]: r for r in structure.heading_shift(nodes, "doc", "page").collect()}
    assert {d: (r.first_level, r["shift"]) for d, r in found.items()} == {4: (3, 2), 5: (1, 0)} and found[5].detail is None
    assert found[4].detail == "The first heading is h3; every heading is tagged 2 levels higher, so the first is H1. Headings above h3 are all tagged H1."
    moved = structure.page_structure(pages.withColumn("up", F.lit(2)), shift="up")
    levels = structure.exploded(moved, "nodes").where("type rlike '^H[1-6]$'").orderBy("doc", "page", "node_id")
    assert [r.type for r in levels.collect()] == ["H1", "H2", "H1", "H1"]


def test_counts_and_texts_of_nodes(spark):
    built = structure.page_structure(spark.createDataFrame([(1, "<p>Quiet <b>room</b></p><p>Loud room</p>")], "k int, html string"))
    counts = {r.type: r.elements for r in structure.type_counts(structure.exploded(built, "nodes"), "k").collect()}
    assert counts == {"P": 2, None: 2}
    assert sorted(r.text for r in structure.element_text(structure.exploded(built, "words"), "k").collect()) == ["Loud room", "Quiet room"]


def test_language_comes_from_the_nearest_node_above(spark):
    html = '<section lang="it"><p>uno</p><p lang="pt">dois <a href="t">três</a></p></section><p>four</p>'
    built = structure.page_structure(spark.createDataFrame([(1, html)], "k int, html string"))
    found = structure.nearest_language(structure.exploded(built, "nodes"), "en", "k").orderBy("node_id").collect()
    assert [(r.type, r.language) for r in found] == [("Sect", "it"), ("P", "it"), ("P", "pt"), ("Link", "pt"), ("P", "en")]


def test_elements_that_end_others_in_a_table_stay_before_it():
    for parts in ("<p>a <p>word ", "<li>a <li>word ", "<a href=x>a <a href=y>word ", "<h3>a <h3>word ", "<p>a <div>word ", "<button>a <button>word "):
        for inside in ("", "<tr>", "<tbody>", "<tr><td>x</td>"):
            _, words = Page(f"<table>{inside}{parts}", "en").rows()
            assert [w["text"] for w in words if w["text"] != "x"] == ["a", "word"], (inside, parts)


def test_a_table_in_a_row_ends_the_one_before():
    nodes, words = Page("<table><tr><td>one</td><table><tr><td>two</td></table> after <table><td><table><td>inner</table>outer</table>", "en").rows()
    assert [w["text"] for w in words] == ["one", "two", "after", "inner", "outer"]
    depths = [n["depth"] for n in nodes if n["type"] == "Table"]
    assert len(depths) == 4 and depths[:3] == [depths[0]] * 3 < [depths[3]] * 3
    for start in ("<table><tr><table><p>", "<table><tr><table><ul><table>"):
        assert [w["text"] for w in Page(f"{start}word ", "en").rows()[1]] == ["word"]
