from pyspark.sql import functions as F

from pagelore.operators import audit, tagtree


def test_metadata_packet(spark):
    old = '<x><rdf:RDF><rdf:Description pdfuaid:part="1"><dc:title><rdf:li>old</rdf:li></dc:title><pdfuaid:part>1</pdfuaid:part></rdf:Description></rdf:RDF></x>'
    rows = spark.createDataFrame([(old, 'A & "B"', True), (old, None, False), ("broken", "T", False)], "old string, title string, claim boolean")
    a, b, c = [r.x for r in rows.select(audit.metadata_packet(F.col("old"), F.col("title"), F.col("claim")).alias("x")).collect()]
    assert a.count("<dc:title>") == 1 and "A &#38; &#34;B&#34;" in a and a.count("pdfuaid:part") == 2 and "old" not in a
    assert "old" in b and "pdfuaid:part" not in b
    assert c.startswith("<?xpacket") and ">T<" in c


def test_safe_content(spark):
    cases = {1: ["q", "BT", "ET", "Q"], 2: ["Q", "q"], 3: ["BT", "BT", "ET", "ET"], 4: ["q", "BDC", "Q"], 5: ["q"], 6: ["scn"]}
    ops = spark.createDataFrame([(p, k, o, ["/P1"] if o == "scn" else []) for p, os in cases.items() for k, o in enumerate(os)], "page int, op_ord int, op string, args array<string>")
    assert {r.page: r.safe for r in audit.safe_content(ops, "page").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_fonts(spark):
    f = lambda *names: spark.createDataFrame([(1, n) for n in names], "doc int, font string")
    assert [r.font for r in audit.new_fonts(f("A", "B"), f("B", "C"), "doc").collect()] == ["C"]
    fonts = spark.createDataFrame([(1, "A", True, False, "TrueType"), (1, "B", True, True, "TrueType"), (1, "C", False, False, "TrueType"), (1, "D", True, False, "Type3")], "doc int, font string, used boolean, embedded boolean, subtype string")
    assert [r.font for r in audit.unembedded_fonts(fonts, "doc").collect()] == ["A"]
    glyphs = spark.createDataFrame([(1, "A", 5, 500.4, None), (1, "A", 9, 1000.0, None), (1, "B", 5, 600.0, 700.0)], "doc int, font string, cid int, advance double, default_width double")
    widths = spark.createDataFrame([(1, "A", 3, 6, 500.0)], "doc int, font string, first int, last int, width double")
    assert [r.font for r in audit.width_mismatches(glyphs, widths, "doc").collect()] == ["B"]


def test_verification_and_trees(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    pixels = spark.createDataFrame([("a", 1, 0), ("b", 2, 7)], "doc_id string, page int, differing int")
    texts = spark.createDataFrame([("c", 1, 2, 0)], "doc_id string, page int, missing int, overlay_missing int")
    got = {r.doc_id: (r.pixels, r.differing_pixels, r.text_preserved, r.error) for r in audit.verification(pixels, texts, docs).collect()}
    assert got == {"a": ("identical-outside-fields", 0, True, None), "b": ("failed", 7, True, "pixels_changed"), "c": ("identical-outside-fields", 0, False, "text_lost")}
    nodes = spark.createDataFrame([("d", 1, None, 0, "Document"), ("d", 2, 1, 0, "P"), ("d", 3, 2, 0, "Figure"), ("d", 4, 1, 1, "P")], "doc_id string, node_id int, parent_id int, ord int, type string")
    assert {r.node_id for r in audit.subtree_has(tagtree.walk(nodes), "Figure").collect()} == {1, 2, 3}
    layers = spark.createDataFrame([(1, False), (1, True), (2, False)], "doc int, auto_state boolean")
    assert {r.doc: r.layers_switch for r in audit.layers_switch_themselves(layers, "doc").collect()} == {1: True, 2: False}
