import random

import pytest
from pyspark.sql import functions as F

from pagelore.functions import attributes, text
from pagelore.operators import align as A
from pagelore.operators import placement, structure, words


def test_normalize_in_both_forms(spark):
    cases = {"Résumé,": "resume", "ﬁle": "file", "“Verkamp’s”": "verkamp's", "1‐2–3": "1-2-3", "...": "", "Ⅳ)": "iv", "": "", "(x": "x"}
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w in cases], "w string").select("w", text.normalize(F.col("w")).alias("n")).collect()}
    assert got == cases == {w: structure.norm(w) for w in cases}


def test_text_functions(spark):
    row = spark.createDataFrame([("a  b­c 日本x ", "x" * 2003 + '"')], "s string, t string")
    got = row.select(text.split_words(F.col("s")).alias("w"), text.clean(F.col("s")).alias("c"), text.quote(F.col("t")).alias("q"), text.slug(F.lit("  Nom & Prénom (2) ")).alias("g"), text.cut(F.lit("abcdef"), 4).alias("k"), text.rounded(F.lit(-2.25), 1).alias("r"), text.utf16_length(F.lit("a😀")).alias("u"), text.plain(F.lit("a\x1bb")).alias("p"), text.escape_xml(F.lit('<a&"\x01>')).alias("e"), text.core(F.lit("it's-a")).alias("o"), text.marks(F.lit("a“b”-1")).alias("m"), text.same_text(F.lit("ﬁ’"), F.lit("fi'")).alias("same")).first()
    assert [(w.text, w.space) for w in got.w] == [("a", True), ("bc", True), ("日", False), ("本", False), ("x", True)]
    assert got.q == '"' + "x" * 2000 + '" [4 more characters not shown]'
    assert (got.c, got.g, got.k, got.r, got.u, got.p, got.e, got.o, got.m, got.same) == ("a b­c 日本x", "nom-prenom-2", "abc…", -2.2, 3, "a b", "&lt;a&amp;&quot;&gt;", "itsa", '""-', True)


def test_list_labels_agree(spark):
    cases = [(k, n) for k in "aAiI1" for n in (-3, 0, 1, 27, 52, 703, 1994, 3999, 4000, 99999)]
    got = spark.createDataFrame(cases, "k string, n int").select("k", "n", attributes.list_label(F.col("k"), F.col("n")).alias("s")).collect()
    assert all(r.s == structure.list_label(r.k, r.n) for r in got)


def slow_align(left, right, budget):
    """The same by plain loops over cells."""
    match, claimed, todo = [-1] * len(left), [not w for w in right], [(0, len(left))]
    score = lambda a, b: 3 if a == b else 1 if A.similar(a, b) else -3
    while todo:
        a, b = todo.pop()
        hs, ps = [i for i in range(a, b) if left[i]], [j for j in range(len(right)) if not claimed[j]]
        if not hs or not ps:
            continue
        budget -= len(hs) * len(ps)
        if budget < 0:
            return match, False
        t = [[0] * (len(ps) + 1) for _ in range(len(hs) + 1)]
        best, at = 0, (0, 0)
        for i in range(1, len(hs) + 1):
            for j in range(1, len(ps) + 1):
                t[i][j] = max(0, t[i - 1][j - 1] + score(left[hs[i - 1]], right[ps[j - 1]]), t[i - 1][j] - 1, t[i][j - 1] - 1)
                if t[i][j] > best:
                    best, at = t[i][j], (i, j)
        (i, j), pairs = at, []
        while i and j and t[i][j] > 0:
            s = score(left[hs[i - 1]], right[ps[j - 1]])
            if t[i][j] == t[i - 1][j - 1] + s:
                pairs = [(i - 1, j - 1), *pairs] if s > 0 else pairs
                i, j = i - 1, j - 1
            elif t[i][j] == t[i - 1][j] - 1:
                i -= 1
            else:
                j -= 1
        if best < min(6, 3 * len(hs)) or not pairs:
            continue
        for x, y in pairs:
            match[hs[x]], claimed[ps[y]] = ps[y], True
        hit = [hs[x] for x, _ in pairs]
        todo += [(a, hit[0]), (hit[-1] + 1, b)] + [(p + 1, q) for p, q in zip(hit, hit[1:]) if q > p + 1]
    return match, True


def test_align_against_loops():
    r = random.Random(5)
    vocabulary = ["apple", "apples", "pear", "plum", "a", "the", "window", "windows", ""]
    for _ in range(150):
        left, right = ([r.choice(vocabulary) for _ in range(r.randint(0, 14))] for _ in range(2))
        budget = r.choice([10**6, 60, 150])
        assert A.align(left, right, budget) == slow_align(left, right, budget)


def test_align_cases():
    words8 = [f"w{i}word" for i in range(8)]
    assert A.align(words8, words8, 63) == ([-1] * 8, False) and A.align(words8, words8, 64)[0] == list(range(8))
    assert A.align(["a", "b", "c", "d", "e", "f"], ["d", "e", "f", "a", "b", "c"])[0] == [3, 4, 5, 0, 1, 2]
    assert A.match_runs(["see", "2", "x", "now"], ["see", "2x", "now"], [0, -1, -1, 2]) == [0, 1, 1, 2]
    assert A.match_runs(["b", "2", "x", "a"], ["a", "2x", "b"], [2, -1, -1, 0]) == [2, -1, -1, 0]
    assert A.match_marks(["a", "+", "b"], ["a", "+", "b"], [0, -1, 2]) == [0, 1, 2]
    assert A.match_marks(["a", "+", "b"], ["a", "b"], [0, -1, 1]) == [0, -1, 1]
    many = [f"word{i}" for i in range(800)]
    assert A.align(many, many)[0] == list(range(800))


def test_align_frames(spark):
    left = spark.createDataFrame([(1, k, w, w) for k, w in enumerate("the stone house by river".split())] + [(2, 0, "x", "x")], "page int, word_ord int, norm string, text string")
    right = spark.createDataFrame([(1, 10 + k, w, w) for k, w in enumerate("by river the stone house".split())], "page int, word_ord int, norm string, text string")
    got = {(r.page, r.word_ord): r.tok_ord for r in A.align_words(left, right, ["page"]).collect()}
    assert got == {(1, 0): 12, (1, 1): 13, (1, 2): 14, (1, 3): 10, (1, 4): 11, (2, 0): -1}


def test_page_report_and_edge_words(spark):
    html = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "", False)], "page int, norm string, matched boolean")
    drawn = spark.createDataFrame([(1, "a", True, False), (1, "x��", False, False), (1, "3", False, True), (2, "y", False, False)], "page int, text string, matched boolean, furniture boolean")
    got = {r.page: r.asDict() for r in words.page_report(html, drawn, "page").collect()}
    assert got[1] == {"page": 1, "matched": 1, "added_from_html": 1, "words": 3, "furniture": 1, "lost": 1, "unmapped": 2} and got[2]["lost"] == 1
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    w = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, (50.0, 0.0, 60.0, 10.0))], f"page int, word_ord int, box {box}")
    f = spark.createDataFrame([(1, (0.0, 0.0, 6.0, 10.0))], f"page int, box {box}")
    assert [r.word_ord for r in words.without_edge_words(w, f, ["page"]).collect()] == [1]


@pytest.mark.parametrize(
    "drawn,texts,low,high,want",
    [
        ("website.1", {0: "website", 1: ".", 2: "1"}, 0, 0, [(0, 0, 7), (1, 7, 8), (2, 8, 9)]),
        ("2x", {3: "2", 4: "x"}, 4, 4, None),
        ("(word)", {0: "word"}, 0, 0, [(0, 1, 5)]),
        ("abc", {0: "ab"}, 0, 0, None),
        ("ab", {0: "a", 2: "b"}, 0, 1, None),
    ],
)
def test_spread(drawn, texts, low, high, want):
    assert placement.spread(list(drawn), texts, low, high) == want


def test_flow_and_segments():
    page, width = (0.0, 0.0, 100.0, 100.0), lambda s: 0.5 * len(s)
    out = placement.flow([{"text": "aaaa", "space": True}, {"text": "b" * 15, "space": False}, {"text": "c", "space": False}], page, width, {2})
    assert [w["box"] for w in out] == [(10.0, 10.0, 30.0, 20.0), (1.0, 22.0, 76.0, 32.0), (10.0, 34.0, 15.0, 44.0)]
    seg, kept = placement.segments([[1, 2], [3]], {1: [1, 2], 2: [4], 3: [5]}, set(), [0] * 5, set())
    assert seg == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2} and kept == {1, 2, 3}
    seg, kept = placement.segments([[1], [2]], {1: [1, 2], 2: [2, 3]}, set(), [0] * 3, set())
    assert seg == {} and kept == set()


def test_words_that_read_the_same(spark):
    rows = [("it’s", "it's", True, True), ("a–b", "a-b", True, True), ("“x”", '"x"', True, True), ("ﬁn", "fin", True, True), ("Fin", "fin", False, True), ("a-b", "ab", False, False), ("ⅳ", "iv", True, True)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean, marks boolean")
    got = got.select("same", "marks", text.same_text(F.col("a"), F.col("b")).alias("s"), (text.marks(F.col("a")) == text.marks(F.col("b"))).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [(r.same, r.marks) for r in got]
