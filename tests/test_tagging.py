"""A page's HTML on its drawn words."""

import random

from pagelore.operators import forms, tagging


def drawn(text, per_line=8, top=100.0):
    return [{"text": t, "box": {"x0": 20.0 + k % per_line * 60, "y0": top + k // per_line * 15, "x1": 70.0 + k % per_line * 60, "y1": top + 10 + k // per_line * 15}, "baseline": top + 8 + k // per_line * 15, "size": 10.0} for k, t in enumerate(text.split())]


def tagged(html, words, number=3, fields=()):
    return tagging.tag_page(html, number, tagging.Drawn(words, number, 612.0, 792.0, list(fields)))


def test_counters_add_up_on_random_pages():
    r = random.Random(5)
    vocabulary = [a + b for a in ("lor", "mag", "tes", "qui") for b in ("an", "ero", "ibu", "os", "ult")]
    for _ in range(40):
        page = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        html = [w for w in page if r.random() > 0.2] + [r.choice(vocabulary) for _ in range(r.randint(0, 5))]
        words = drawn(" ".join(page))
        got = tagged(f"<h2>{' '.join(html[:5])}</h2><p>{' '.join(html[5:])}</p>", words)
        report = got["report"]
        on = [p["tok_ord"] for p in got["placed"] if p["tok_ord"] is not None]
        assert report["words"] == len(page) == len(set(on)) + report["lost"] + report["furniture"]
        assert report["matched"] == len(on) and report["added_from_html"] == len(html) - len(on)
        assert sum(len(x["words"]) for x in got["lost"]) == report["lost"]
        assert len(got["placed"]) == len(html) and all(p["box"]["x1"] >= p["box"]["x0"] for p in got["placed"])
        for p in got["placed"]:
            if p["tok_ord"] is not None:
                assert p["box"]["y0"] == words[p["tok_ord"]]["box"]["y0"]


def test_hyphens_shared_words_furniture_and_fields():
    words = drawn("The per- mit costs fifty dollars.Apply today", per_line=2)
    words.append({"text": "3", "box": {"x0": 300.0, "y0": 770.0, "x1": 306.0, "y1": 780.0}, "baseline": 778.0, "size": 9.0})
    words.append({"text": "typed", "box": {"x0": 400.0, "y0": 300.0, "x1": 440.0, "y1": 310.0}, "baseline": 308.0, "size": 9.0})
    got = tagged("<p>The permit costs fifty dollars. Apply today</p><p>3</p>", words, fields=[{"x0": 390.0, "y0": 295.0, "x1": 450.0, "y1": 315.0}])
    by = {p["text"]: p for p in got["placed"]}
    assert by["permit"]["tok_ord"] == 1 or by["permit"]["tok_ord"] is None  # "per-" ends the first line, "mit" begins the second
    assert by["dollars."]["tok_ord"] == by["Apply"]["tok_ord"] and by["dollars."]["box"]["x1"] == by["Apply"]["box"]["x0"]
    assert by["dollars."]["part"] == [0, 8] and by["Apply"]["part"] == [8, 13]
    assert by["3"]["tok_ord"] is None and got["report"]["furniture"] == 1 and got["report"]["words"] == 8


def test_lost_words_follow_their_block():
    got = tagged("<h1>Annual fees</h1><p>Dogs pay ten</p>", drawn("Draft Annual fees old text here Dogs pay ten final"))
    assert [(x["after_block"], " ".join(x["words"])) for x in got["lost"]] == [(-1, "Draft"), (0, "old text here"), (1, "final")]
    assert [w["detail"] for w in got["warnings"]] == ["Draft", "old text here", "final"]


def test_pages_without_words_and_with_too_many():
    got = tagged("<p>only in the HTML</p><p>second</p>", [])
    assert got["report"]["text_source"] == "approximate" and [w["code"] for w in got["warnings"]] == ["no_text_positions"]
    tops = [p["box"]["y0"] for p in got["placed"]]
    assert tops[:4] == [tops[0]] * 4 and tops[4] > tops[0]
    got = tagged("<p>x</p>", drawn("w " * 4001))
    assert [w["code"] for w in got["warnings"]] == ["too_many_words"] and not got["report"]["complete"]


def test_frames(spark):
    words = "array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,baseline:double,size:double>>"
    rows = [("a", 1, "<p>one two</p>", 612.0, 792.0, drawn("one two three"), "x"), ("a", 2, None, 612.0, 792.0, None, "y"), (None, 1, "<p>z</p>", 612.0, 792.0, [], None)]
    out = tagging.tag_pages(spark.createDataFrame(rows, f"doc string, page int, html string, width double, height double, words {words}, report string"), "doc").collect()
    assert [(r.doc, r.page, r.report.words, r.report.matched, r.report.lost) for r in out] == [("a", 1, 3, 2, 1), ("a", 2, 0, 0, 0), (None, 1, 0, 0, 0)]


def test_controls_take_widgets_once():
    controls = [{"control_ord": k, "name": n, "value": v} for k, (n, v) in enumerate([("a", None), ("a", None), ("b.c", None), ("pick", "x"), ("pick", "z"), ("", None), ("far", None), ("gone", None)])]
    widgets = [{"widget_ord": k, "name": n, "on_states": s} for k, (n, s) in enumerate([("a", []), ("a", []), ("a-2", []), ("b-c", []), ("pick", ["x"]), ("pick", ["y"])])]
    found = forms.taken_widgets(controls, widgets, {"far"})
    assert [x[1] for x in found] == [[0, 1], [2], [3], [4], [], [], [], []]
    assert [x[2] for x in found] == [None, None, None, None, "field_on_other_page", "field_without_name", "field_on_other_page", "field_not_in_pdf"]


def test_elements_and_their_parents(spark):
    words = "array<struct<text:string,box:struct<x0:double,y0:double,x1:double,y1:double>,baseline:double,size:double>>"
    html = "<h1>Fees</h1><ul><li>cat five</li><li>dog ten</li></ul><p id=end>end</p>"
    page = drawn("Fees stray words • cat five • dog ten end last")
    out = tagging.tag_pages(spark.createDataFrame([(1, 1, html, 612.0, 792.0, page)], f"doc int, page int, html string, width double, height double, words {words}"), "doc")
    rows = tagging.elements(out, "doc").orderBy("element").collect()
    assert [(r.element, r.parent, r.type, r.lost) for r in rows] == [(1, 0, "H1", 0), (2, 0, "P", 1), (3, 0, "L", 0), (4, 3, "LI", 0), (5, 4, "Lbl", 0), (6, 4, "LBody", 0), (7, 3, "LI", 0), (8, 7, "Lbl", 0), (9, 7, "LBody", 0), (10, 0, "P", 0), (11, 0, "P", 1)]
    drawn_by = {r.element: (r.mcid, r.text) for r in tagging.marked_content(out, "doc").collect()}
    assert drawn_by[2] == (1, "stray words") and drawn_by[9][1] == "dog ten" and drawn_by[11][1] == "last" and sorted(m for m, _ in drawn_by.values()) == list(range(len(drawn_by)))
    assert tagging.id_tree(out, "doc").count() == 0  # nothing links to an id
