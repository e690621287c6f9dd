import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.functions.register import register
from pagelore.operators import content as C
from pagelore.operators import forms, geometry, raster, report, review, tagtree, verify
from pagelore.sources import readers
from pagelore.streaming import pages as stream

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_content_operators():
    s = "q % note (\n1 0 0 1 5 6 cm BT /F1 12 Tf (a(b)\\) c) Tj [(x) -3 <414>] TJ ET BI /W 1 ID \x00 EI\x01 EI Q << /MCID 3 >> true"
    ops = C.operators(s)
    assert [o.op for o in ops] == ["q", "cm", "BT", "Tf", "Tj", "TJ", "ET", "BI", "Q"]
    assert ops[4].args == ["(a(b)\\) c)"] and ops[5].args == ["[", "(x)", "-3", "<414>", "]"] and s[ops[1].start : ops[1].end] == "1 0 0 1 5 6 cm"
    assert C.operators("(never closed Tj") == [] and C.operators("") == []
    marked = "/P <</MCID 0>> BDC (a) Tj EMC /OC /x BDC q /A BMC Q EMC EMC /B MP"
    assert C.unmarked(marked).split() == "(a) Tj /OC /x BDC q Q EMC".split()
    assert C.without_strings("(BT) q % BT\nQ \nID x\x00 EI q") == " q \nQ \n  q" and C.without_strings("(open") == "(open"
    assert [C.string_bytes(x) for x in ("(a\\)\\101\\n\\\r\nz\r\n)", "<4a4B4>", "<zz>", "(a", "name")] == ["a)A\nz\n", "JK@", None, None, None]


def test_maps_and_marked_text():
    cmap = "2 beginbfchar <01> <00480069> <02> <D800> endbfchar 1 beginbfrange <10> <12> <0041> <20> <220> <0041> endbfrange"
    got = C.character_map(cmap)
    assert got == {1: "Hi", 2: "", 16: "A", 17: "B", 18: "C"}
    s = "/F Tf /P <</MCID 4>> BDC (\x01\x10) Tj EMC (\x11) Tj /P <</MCID 5>> BDC /F 1 Tf <12> Tj EMC"
    assert C.marked_strings(s.replace("/F Tf", "/F 1 Tf"), {"F": got}, {}) == {4: "HiA", 5: "C"}
    assert C.image_boxes("q 10 0 0 20 5 5 cm /I Do Q BT /I Do ET /X Do", {"I"}) == [(2, (5.0, 5.0, 15.0, 25.0), True), (5, (0.0, 0.0, 1.0, 1.0), False)]


def test_content_frames(spark):
    df = spark.createDataFrame([(1, bytearray(b"q (/MCID 7) Tj Q")), (2, bytearray(b"/P << /MCID 7 >> BDC EMC")), (3, None)], "page int, content binary")
    assert [r.op for r in C.operator_rows(df, "content", "page").where("page = 1").orderBy("op_ord").collect()] == ["q", "Tj", "Q"]
    assert [r.page for r in C.leftover_ids(df, "content", "page").collect()] == [2]
    ops = spark.createDataFrame([(1, 0, "q"), (1, 1, "Q"), (2, 0, "Q"), (2, 1, "q"), (3, 0, "q")], "page int, op_ord int, op string")
    assert {r.page: r.balanced for r in tagtree.balanced(ops, "q", "Q", "page").collect()} == {1: True, 2: False, 3: False}


def page(w=300, h=200):
    return np.full((h, w), 255, np.uint8)


def ink(pixels):
    return raster.Ink(pixels.tobytes(), pixels.shape[1], pixels.shape[0])


def test_raster_finders():
    p = page()
    p[60, 80:220] = 0  # an underline right of the label
    label = (10, 44, 70, 60)
    box = raster.text_blank(ink(p), label, [label])
    assert box and box[0] >= 70 and box[2] == 219 and box[3] == 59
    p = page()
    p[40:70, [80, 200]] = 0
    p[[40, 69], 80:201] = 0  # a box right of the label
    box = raster.text_blank(ink(p), (10, 46, 70, 62), [(10, 46, 70, 62)])
    assert box and 80 < box[0] < box[2] < 200 and 40 < box[1] < box[3] < 69
    assert raster.text_blank(ink(page()), label, [label]) is None
    p = page()
    p[[44, 58], 50:65] = 0
    p[44:59, [50, 64]] = 0  # a check box left of the label
    assert raster.mark_blank(ink(p), (75, 43, 130, 60), []) == (50, 44, 64, 58)
    p[44:59, 50:65] = 0  # filled
    assert raster.mark_blank(ink(p), (75, 43, 130, 60), []) is None
    p = page()
    p[[10, 60, 110], 20:121] = 0
    p[10:111, [20, 120]] = 0
    p[85, 22:119] = 200  # a faint line in the lower cell
    i = ink(p)
    assert raster.enclosure(i, 60, 90) == (20, 60, 120, 110) and raster.enclosure(i, 200, 90) is None
    assert raster.cell_under(i, 60, 30) == (20, 60, 120, 110)
    assert raster.cell_rows(i, (20, 60, 120, 110), 15) == [(20, 60, 120, 85), (20, 85, 120, 110)]
    assert raster.cell_blank((20, 60, 120, 110), 15, []) and raster.cell_blank((20, 60, 120, 110), 15, [(50, 70, 60, 80)]) is None


def test_place_fields(spark):
    p = page()
    p[60, 80:220] = 0
    rows = [(1, 300, 200, bytearray(p.tobytes()), [], [(0, "text", (10.0, 44.0, 70.0, 60.0)), (1, "text", (10.0, 44.0, 70.0, 60.0))])]
    df = spark.createDataFrame(rows, f"page int, w int, h int, gray binary, words array<{BOX}>, controls array<struct<control_ord:int,type:string,label:{BOX}>>")
    got = raster.place_fields(df, "page").orderBy("control_ord").collect()
    assert got[0].x0 is not None and got[1].x0 is None


def test_geometry_frames(spark):
    a = spark.createDataFrame([(1, 0, "u", [(0.0, 0.0, 10.0, 10.0)]), (1, 1, "v", []), (1, 2, "u", [])], f"page int, link_ord long, href string, boxes array<{BOX}>")
    b = spark.createDataFrame([(1, 7, "u", (50.0, 0.0, 60.0, 10.0)), (1, 8, "x", (0.0, 0.0, 9.0, 10.0))], f"page int, annot_ord long, uri string, box {BOX}")
    assert [r.annot_ord for r in geometry.links_to_annotations(a, b, ["page"]).orderBy("link_ord").collect()] == [8, None, 7]
    w = spark.createDataFrame([(1, 5, 0, "ab", (0.0, 0.0, 10.0, 1.0)), (1, 5, 1, "abc", (0.0, 0.0, 10.0, 1.0))], f"page int, tok int, word_ord int, text string, box {BOX}")
    assert [(r.box.x0, r.box.x1) for r in geometry.shares(w, "page", "tok").orderBy("word_ord").collect()] == [(0.0, 4.0), (4.0, 10.0)]
    clamped = w.select(geometry.within_page(F.col("box"), F.lit(7.0)).alias("b")).first().b
    assert clamped.x1 == 7.0
    under = geometry.words_under(b.withColumnRenamed("annot_ord", "k"), w, ["page"], "k")
    assert {r.k: r.text for r in under.collect()} == {8: "ab abc"}
    f = spark.createDataFrame([(1, 0, 2), (2, 0, 1)], "page int, image int, images int")
    i = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "page int, image int, ops string")
    assert [r.ops for r in geometry.figures_to_images(f, i, ["page"]).collect()] == ["a"]


def test_forms_frames(spark):
    c = spark.createDataFrame([(1, 0, "own", "y", "radio"), (1, 1, "own", "n", "radio"), (1, 2, "name", None, "text"), (1, 3, "gone", None, "text")], "doc int, control_ord int, name string, value string, type string")
    w = spark.createDataFrame([(1, 10, "own", ["n"]), (1, 11, "own", ["y"]), (1, 12, "name", [])], "doc int, widget_ord int, name string, on_states array<string>")
    assert {r.control_ord: r.widget_ord for r in forms.controls_to_widgets(c, w, "doc").collect()} == {0: 11, 1: 10, 2: 12, 3: None}
    named = forms.unique_names(spark.createDataFrame([(1, k, b) for k, b in enumerate(["a.b", "x", "a-b", "x", "x"])], "doc int, o int, base string"), "base", "o", "doc")
    assert [r.name for r in named.orderBy("o").collect()] == ["a-b", "x", "a-b-2", "x-2", "x-3"]
    fields = spark.createDataFrame([(1, "a", "text", True), (1, "b", "text", False), (1, "s", "signature", False)], "doc int, name string, type string, readonly boolean")
    values = spark.sql("SELECT 1 AS doc, name, parse_json('\"SECRET\"') AS value FROM VALUES ('a'), ('b'), ('s') AS t(name)")
    boxes = spark.createDataFrame([(1, "b", 1, "r1"), (1, "b", 2, "r2"), (1, "a", 1, "r3")], "doc int, name string, page int, rect string")
    counts, changed = forms.set_counts(values, fields, boxes, "doc")
    assert [(r["set"], r.skipped_read_only) for r in counts.collect()] == [(1, 1)] and {r.rect for r in changed.collect()} == {"r1", "r2"}
    checked = forms.check_values(values, fields.withColumns({"options": F.array().cast("array<string>"), "maxlen": F.lit(3), "editable": F.lit(False), "multi_select": F.lit(False)}), "doc")
    assert checked.count() == 3 and not any("SECRET" in str(r) for r in checked.collect())


def test_tag_tree(spark):
    nodes = spark.createDataFrame([("d", 1, None, 0, "Document"), ("d", 2, 1, 0, "H1"), ("d", 3, 2, 0, "P"), ("d", 9, 8, 0, "X"), ("d", 8, 9, 0, "Y")] + [("e", k, k - 1 if k else None, 0, "N") for k in range(90)], "doc_id string, node_id int, parent_id int, ord int, type string")
    tree = tagtree.walk(nodes)
    assert {r.node_id for r in tree.where("doc_id = 'd'").collect()} == {1, 2, 3} and tree.where("doc_id = 'e'").count() == 65
    heads = spark.createDataFrame([("d", k, "H2", f"h{k}", 1 + k // 3) for k in range(12)] + [("d", 99, "P", "p", 1)], "doc_id string, node_id int, type string, text string, page int")
    before = {r.page: r.headings for r in tagtree.headings_before(heads, spark.createDataFrame([("d", p) for p in range(1, 6)], "doc_id string, page int"), most=4).collect()}
    assert before[1] == [] and before[2] == ['H2 "h0"', 'H2 "h1"', 'H2 "h2"'] and before[5] == [f'H2 "h{k}"' for k in (8, 9, 10, 11)]
    few = tagtree.capped(tree.where("doc_id = 'd'"), elements=2).orderBy("path").collect()
    assert [r.type for r in few] == ["Document", "H1"] and all(r.truncated for r in few)
    chars = spark.createDataFrame([(1, 0, 0, "a", 1), (1, 0, 1, "b", 1), (1, 0, 2, "c", 2), (1, 1, 3, "d", 2)], "page int, mcid int, char_ord int, c string, line int")
    assert {r.mcid: r.text for r in tagtree.marked_text(chars, "page").collect()} == {0: "ab c", 1: "d"}
    assert [r.mcid for r in tagtree.content_ids(tree.where("doc_id = 'd'"), "doc_id").orderBy("node_id").collect()] == [0, 1, 2]
    notes = spark.createDataFrame([("Link", 0), ("Popup", 0), ("Widget", 2), ("Text", None)], "s string, f int")
    assert [r.n for r in notes.select(tagtree.needs_tags(F.col("s"), F.col("f")).alias("n")).collect()] == [True, False, False, True]
    claims = spark.createDataFrame([(1, True, True), (1, True, None), (2, True, True)], "d int, a boolean, b boolean")
    assert {r.d: r.claim for r in tagtree.may_claim(claims, ["a", "b"], "d").collect()} == {1: False, 2: True}


def test_text_failures(spark):
    b = spark.createDataFrame([(1, w) for w in "a a b c".split()], "page int, word string")
    a = spark.createDataFrame([(1, w) for w in "a b newtext d".split()], "page int, word string")
    added = spark.createDataFrame([(1, "new text z")], "page int, text string")
    got = verify.text_failures(b, a, added, "page").collect()
    assert [(r.missing, r.overlay_missing) for r in got] == [(2, 1)]
    assert verify.missing_words(b, a, "page", "word").count() == 2


def test_review(spark):
    requests = spark.createDataFrame([(1, "ok"), (2, "bad")], "page int, request string")

    def send(r):
        if r == "bad":
            raise ValueError("no")
        return r.upper()

    got = {r.page: (r.reply, r.error, r.attempts) for r in review.run_requests(requests, send, "page").collect()}
    assert got == {1: ("OK", None, 1), 2: (None, "no", 2)}
    body = '{"model":"m","system":"s","max_tokens":9,"messages":[{"role":"user","content":"hi"},{"role":"user","content":[{"type":"image","source":{"data":"QQ"}},{"type":"text","text":"t"}]}],"tools":[{"name":"n","description":"d","input_schema":{"type":"object"}}]}'
    made = spark.createDataFrame([(body,)], "b string").select(review.to_converse(F.parse_json("b")).alias("j")).select(F.get_json_object("j", "$.modelId").alias("m"), F.get_json_object("j", "$.messages[0].content[0].text").alias("t"), F.get_json_object("j", "$.messages[1].content[0].image.source.bytes").alias("i"), F.get_json_object("j", "$.toolConfig.tools[0].toolSpec.inputSchema.json.type").alias("s")).first()
    assert tuple(made) == ("m", "hi", "QQ", "object")
    reply = '{"output":{"message":{"content":[{"text":"x"},{"toolUse":{"name":"report_findings","input":{"findings":[{"kind":"link"}]}}},{"odd":1}]}},"stopReason":"tool_use","usage":{"inputTokens":5}}'
    back = spark.createDataFrame([(1, reply)], "page int, r string").select("page", F.parse_json(review.from_converse(F.parse_json("r"))).alias("reply"))
    found, failed = review.findings(back, "page")
    assert [(r.kind, r.severity) for r in found.collect()] == [("link", "warning")] and failed.count() == 0
    assert [tuple(r) for r in review.usage(back, "page").collect()] == [(1, 5, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pages.json").write_text('{"lang":"en","title":"t","pages":[{"sourcePage":1,"html":"<p>x</p>"},{"sourcePage":1,"html":"y"},{"sourcePage":2.5,"html":"z"},{"sourcePage":2,"html":"<h1>k</h1>"},{"sourcePage":3}]}')
    pages = readers.read_pages_json(spark, str(tmp_path / "*.json"))
    good, bad = readers.checked_pages(pages, F.lit(3), "path")
    assert [r.source_page for r in good.collect()] == [2] and sorted(r.code for r in bad.collect()) == ["page_given_twice"] * 2 + ["page_out_of_range", "page_without_html"]
    assert readers.too_many_pages(pages, "path", most=4).count() == 1 and readers.read_binary(spark, str(tmp_path)).count() == 1
    meta = spark.createDataFrame([(1, False), (2, False), (9, True)], "page int, blank boolean")
    assert {r.page: r.code for r in readers.pages_without_html(meta, good, []).collect()} == {1: "page_without_html", 9: None}
    assert [r.value for r in readers.as_lines(meta.where("page = 9"), "page", "blank").collect()] == ["9\ttrue"]


def test_report_and_fallback(spark, tmp_path):
    p = spark.createDataFrame([("d", 2, 5), ("d", 1, 4)], "doc_id string, page int, words int")
    w = spark.createDataFrame([("d", 1, "missing_alt", "x")], "doc_id string, page int, code string, detail string")
    t = spark.createDataFrame([("d", "P", 3), ("d", "H1", 1), ("d", None, 4)], "doc_id string, type string, elements int")
    out = report.document_report(p, w, t)
    r = out.first().report
    assert [x.page for x in r.pages] == [1, 2] and r.structure.elements == 4 and r.structure.by_type == {"H1": 1, "P": 3} and r.warnings[0].code == "missing_alt"
    readers.write_reports(out, f"{tmp_path}/r")
    one = spark.createDataFrame([("a", "x", None), ("b", None, "in_place_failed"), ("c", None, "other")], "doc_id string, v string, error string")
    two = spark.createDataFrame([("b", "y", None), ("c", "z", None)], "doc_id string, v string, error string")
    assert {r.doc_id: r.v for r in report.with_fallback(one, two, ["in_place_failed"]).collect()} == {"a": "x", "b": "y", "c": None}


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT normalize_word('Été!') a, list_label('I', 9) b, speak_math('<math><mi>x</mi></math>') c, bounded_distance('abcd', 'abxd', 2) d, (SELECT count(*) FROM html_nodes('<p>a<b>c</b></p>')) e").first()
    assert tuple(got) == ("ete", "IX", "x", 1, 5)


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (2, "<p>c</p>")], "page_id int, html string").write.parquet(src)
    frame = stream.read_pages(spark, src, "page_id int, html string")
    stream.write_reports(frame, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    q = stream.running_type_counts(frame).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.type: r.elements for r in spark.table("counts").collect()} == {"H1": 1, "P": 2}


@pytest.mark.parametrize("name", ["page_structure_summary", "doc_tokens", "table_headers", "outline", "review_cost", "form_value_checks"])
def test_queries_against_sql(spark, name):
    import duckdb

    from pagelore.plans.queries import QUERIES, SQL

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
