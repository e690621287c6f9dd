"""Structure of HTML pages: one Python function per page emits its elements, words and warnings; the rest is DataFrame work.

``page_structure`` gives (keys, nodes, words, warnings), arrays of structs that ``nodes``, ``words`` and ``warnings`` explode.
Nodes are numbered in reading order; parent 0 is the page. A word names its node and top-level block.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import math_speech
from .html_tree import Element, parse
from .math_speech import WHITE

#: The structure type of each HTML element.
TYPES = {
    "h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P",
    "ul": "L", "ol": "L", "dl": "L", "li": "LI", "dt": "Lbl", "dd": "LBody",
    "table": "Table", "caption": "Caption", "thead": "THead", "tbody": "TBody", "tfoot": "TFoot", "tr": "TR", "th": "TH", "td": "TD",
    "figure": "Div", "figcaption": "Caption", "img": "Figure", "a": "Link", "blockquote": "BlockQuote", "code": "Code", "pre": "Code",
    "input": "Form", "select": "Form", "textarea": "Form", "nav": "Sect", "aside": "Sect", "section": "Sect", "fieldset": "Sect",
    "legend": "P", "article": "Art", "div": "Div", "header": "Div", "footer": "Div", "main": "Div",
}
#: Elements without structure of their own, and elements that are no content.
TRANSPARENT = frozenset(("#root", "form", "label", "span", "strong", "em", "b", "i", "u", "s", "small", "mark", "abbr", "time", "cite", "q", "sub", "sup", "br", "wbr", "bdi", "bdo", "data", "var", "kbd", "samp", "ins", "del"))
NO_CONTENT = frozenset(("hr", "script", "style", "template", "head", "title", "meta", "link", "option", "optgroup"))
INLINE = frozenset(("Link", "Reference", "Code", "Lbl", "LBody", "Formula"))
GROUPS = frozenset(("THead", "TBody", "TFoot"))
TEXT_INPUTS = frozenset(("", "text", "email", "tel", "number", "date", "url", "search", "password", "time", "month", "week", "datetime-local"))
NUMBERING = {"a": "LowerAlpha", "A": "UpperAlpha", "i": "LowerRoman", "I": "UpperRoman"}
SCOPES = {"row": "Row", "rowgroup": "Row", "col": "Column", "colgroup": "Column"}

_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD = re.compile(rf"([{_CJK}]|[^{WHITE}{_CJK}]+)([{WHITE}]*)")
_SPACES = re.compile(f"[{WHITE}]+")
_INT = re.compile(rf"[{WHITE}]*[+-]?[0-9]+[{WHITE}]*\Z")
_FOLD = str.maketrans("‘’ʼ“”‐‑‒–—", "'''\"\"-----")

NODE = (
    "node_id int, parent_id int, ord int, depth int, block int, type string, alt string, mathml string, title string, lang string, elem_id string, href string, "
    "attrs map<string,string>, headers array<string>, colspan int, rowspan int, image int, "
    "form struct<name:string,id:string,value:string,label:string,grp:string,type:string,options:array<string>,label_words:array<string>>"
)
WORD = "word_ord int, node_id int, block int, text string, norm string, space boolean, new_line boolean"
WARNING = "code string, detail string"


def tidy(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


def norm(word: str) -> str:
    """The form of a word that is compared; the column function ``normalize`` gives the same."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c)[0] != "M")
    word = word.lower().translate(_FOLD)
    a, b = 0, len(word)
    while a < b and unicodedata.category(word[a])[0] not in "LN":
        a += 1
    while b > a and unicodedata.category(word[b - 1])[0] not in "LN":
        b -= 1
    return word[a:b]


def integer(v: str | None) -> int | None:
    if v and _INT.match(v):
        n = int(_SPACES.sub("", v)) if len(v) < 400 else 1 << 60
        return n if abs(n) < 1 << 53 else None
    return None


def list_label(kind: str | None, n: int) -> str:
    """Letters from 1 (27 is aa), roman numerals from 1 to 3999, else decimal."""
    shown = ""
    if kind in ("a", "A") and n > 0:
        while n > 0:
            n, k = divmod(n - 1, 26)
            shown = chr(97 + k) + shown
    elif kind in ("i", "I") and 0 < n < 4000:
        for place, (one, five, ten) in zip((1000, 100, 10, 1), ("m  ", "cdm", "xlc", "ivx")):
            d = n // place % 10
            shown += one + ten if d == 9 else one + five if d == 4 else five * (d > 4) + one * (d % 5)
    else:
        return str(n)
    return shown.upper() if kind in ("A", "I") else shown


@dataclass(eq=False)
class Word:
    text: str
    space: bool = False


@dataclass(eq=False)
class Node:
    type: str
    kids: list[Node | list[Word]] = field(default_factory=list)
    alt: str | None = None
    mathml: str | None = None
    title: str | None = None
    lang: str | None = None
    elem_id: str | None = None
    href: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    headers: list[str] | None = None
    span: list[int] | None = None
    image: int | None = None
    form: dict | None = None

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def last_word(self) -> Word | None:
        at: Node | list[Word] = self
        while isinstance(at, Node):
            if not at.kids:
                return None
            at = at.kids[-1]
        return at[-1] if at else None

    def text(self) -> str:
        return " ".join(" ".join(w.text for w in k) if isinstance(k, list) else k.text() for k in self.kids)


@dataclass
class Around:
    """What an element's surroundings say: language, enclosing label and legend, label word lists that its text belongs to."""

    lang: str
    label: str | None = None
    legend: str | None = None
    wrapped: list[Word] | None = None
    collecting: tuple[list[Word], ...] = ()

    def but(self, **changes) -> Around:
        return Around(**(self.__dict__ | changes))


class Page:
    """Builds one page. ``shift``: levels that headings move up."""

    def __init__(self, html: str, lang: str, prefix: str = "", shift: int = 0):
        self.prefix, self.shift, self.warnings = prefix, shift, []
        self.images = self.header_cells = 0
        tree = parse(html)
        self.label_texts = {e.attrs["for"]: tidy(e.text()) for e in tree.elements() if e.tag == "label" and e.attrs.get("for")}
        self.targets = {e.attrs["href"][1:] for e in tree.elements() if e.tag == "a" and e.attrs.get("href", "").startswith("#")}
        self.label_words: dict[str, list[Word]] = {}
        self.questions: dict[str, str] = {}
        self.top = Node("#root")
        self.all(tree, self.top, Around(lang))
        self.top.kids = [Node("P", [k]) if isinstance(k, list) else k for k in self.top.kids]
        self._space_after(self.top)

    def all(self, e: Element, into: Node, around: Around) -> None:
        for k in e.kids:
            self.one(k, into, around)

    def one(self, e: Element | str, into: Node, around: Around) -> None:
        if isinstance(e, str):
            return self.text(into, e, around.collecting)
        if e.tag in NO_CONTENT:
            return
        if e.tag == "label":
            target = e.attrs.get("for")
            words = self.label_words.setdefault(target, []) if target else []
            return self.all(e, into, around.but(label=tidy(e.text()), collecting=(*around.collecting, words), wrapped=around.wrapped if target else words))
        if e.tag in TRANSPARENT or e.tag == "a" and not e.attrs.get("href"):
            return self.all(e, into, around)
        getattr(self, f"_{HANDLERS.get(e.tag, 'plain')}")(e, into, around, around.but(lang=e.attrs["lang"]) if e.attrs.get("lang") else around)

    def add(self, e: Element, kind: str, into: Node, around: Around) -> Node:
        n = Node(kind)
        if e.attrs.get("lang") and e.attrs["lang"] != around.lang:
            n.lang = e.attrs["lang"]
        if e.attrs.get("id") in self.targets and e.attrs.get("id"):
            self._target(n, e.attrs["id"])
        into.kids.append(n)
        return n

    def _target(self, n: Node, name: str) -> None:
        n.elem_id = self.prefix + name
        n.type = "Note" if n.type == "P" else n.type

    def text(self, into: Node, text: str, collecting: tuple[list[Word], ...] = ()) -> None:
        words = [Word(a, bool(b)) for a, b in _WORD.findall(text.replace("\u00ad", ""))]
        for held in collecting:
            held += words
        if _SPACES.match(text) and (w := into.last_word()):
            w.space = True
        if words:
            if into.kids and isinstance(into.kids[-1], list):
                into.kids[-1] += words
            else:
                into.kids.append(words)

    def _space_after(self, n: Node) -> None:
        for k in n.nodes():
            self._space_after(k)
        if n.type not in INLINE and (w := n.last_word()):
            w.space = True

    def _plain(self, e, into, around, inner):
        kind = TYPES.get(e.tag)
        if kind is None:
            self.warnings.append(("unmapped_element", e.tag))
        if kind == "LBody" and (w := into.last_word()):
            w.space = True
        self.all(e, self.add(e, kind or "P", into, around), inner)

    def _heading(self, e, into, around, inner):
        self.all(e, self.add(e, f"H{max(1, int(e.tag[1]) - self.shift)}", into, around), inner)

    def _list(self, e, into, around, inner):
        made, kind = self.add(e, "L", into, around), e.attrs.get("type")
        made.attrs = {"O": "List", "ListNumbering": NUMBERING.get(kind, "Decimal") if e.tag == "ol" else "Disc"}
        step = -1 if "reversed" in e.attrs else 1
        n = integer(e.attrs.get("start"))
        if n is None:
            n = sum(not isinstance(k, str) and k.tag == "li" for k in e.kids) if step < 0 else 1
        for k in e.kids:
            if isinstance(k, str) or k.tag != "li":
                self.one(k, made, inner)
                continue
            own = integer(k.attrs.get("value"))
            n = n if own is None else own
            self._item(k, made, inner, inner, f"{list_label(kind, n)}." if e.tag == "ol" else "•")
            n += step

    def _item(self, e, into, around, inner, label=""):
        item, body = Node("LI"), Node("LBody")
        into.kids.append(item)
        item.kids = [Node("Lbl", [[Word(label)]]), body] if label else [body]
        if e.attrs.get("id") and e.attrs["id"] in self.targets:
            body.kids.append(note := Node("P"))
            self._target(note, e.attrs["id"])
            body = note
        self.all(e, body, around)

    def _definitions(self, e, into, around, inner):
        made, item = self.add(e, "L", into, around), None
        for k in e.kids:
            if not isinstance(k, str):
                if k.tag == "dt" or item is None:
                    made.kids.append(item := Node("LI"))
                self.one(k, item, inner)

    def _image(self, e, into, around, inner):
        alt, self.images = e.attrs.get("alt"), self.images + 1
        if alt is None:
            self.warnings.append(("missing_alt", e.attrs.get("src", "img")))
        elif alt:
            made = self.add(e, "Figure", into, around)
            made.alt, made.image = alt, self.images - 1

    def _math(self, e, into, around, inner):
        said, shown, given = math_speech.speak(e), " ".join(math_speech.tokens(e)), tidy(e.attrs.get("alttext", ""))
        alt = said or given or shown
        if not alt:
            return
        if not said and not given:
            self.warnings.append(("missing_alt", f"math: {shown}"))
        made = self.add(e, "Formula", into, around)
        made.alt, made.mathml = alt, math_speech.xml(e)
        if said and not inner.lang.startswith("en"):
            made.lang = "en"
        self.text(made, shown or alt, around.collecting)

    def _link(self, e, into, around, inner):
        href = e.attrs["href"]
        made = link = self.add(e, "Reference" if href.startswith("#") else "Link", into, around)
        if href.startswith("#"):
            made.kids.append(link := Node("Link"))
        link.href = href
        self.all(e, link, inner)

    def _control(self, e, into, around, inner):
        kind, name, own = e.attrs.get("type", "").lower(), e.attrs.get("name", ""), e.attrs.get("id")
        if kind == "hidden":
            return
        label = (own and self.label_texts.get(own)) or around.label or e.attrs.get("aria-label") or e.attrs.get("title") or ""
        words = self.label_words.setdefault(own, []) if own and own in self.label_texts else [] if around.wrapped is None else around.wrapped
        holds = {"select": "combobox", "textarea": "multiline"}.get(e.tag) or (kind if kind in ("checkbox", "radio") else "text" if kind in TEXT_INPUTS else None)
        question = around.legend
        if kind == "radio" and not around.legend and name:
            if name not in self.questions:
                self.questions[name] = tidy(into.text())
            question = self.questions[name] or None
        made = self.add(e, "Form", into, around)
        options = [o.attrs.get("value", tidy(o.text())) for o in e.kids if not isinstance(o, str) and o.tag == "option"] if e.tag == "select" else None
        made.form = {"name": name, "id": own, "value": e.attrs.get("value") if kind in ("radio", "checkbox") else None, "label": label, "grp": question, "type": holds, "options": options, "label_words": words}
        made.alt = label or None

    def _fieldset(self, e, into, around, inner):
        made = self.add(e, "Sect", into, around)
        legend = next((k for k in e.kids if not isinstance(k, str) and k.tag == "legend"), None)
        made.title = tidy(legend.text()) if legend else None
        self.all(e, made, inner.but(legend=made.title))

    def _section(self, e, into, around, inner):
        made = self.add(e, "Sect", into, around)
        made.title = e.attrs.get("aria-label") or None
        self.all(e, made, inner)

    def _cell(self, e, into, around, inner):
        made = self.add(e, TYPES[e.tag], into, around)
        made.span = [_count(e.attrs.get("colspan")), _count(e.attrs.get("rowspan"))]
        if e.tag == "th" and e.attrs.get("scope"):
            made.attrs = {"O": "Table", "Scope": SCOPES.get(e.attrs["scope"].lower(), "Both")}
        self.all(e, made, inner)

    def _table(self, e, into, around, inner):
        made = self.add(e, "Table", into, around)
        self.all(e, made, inner)
        self._drop_empty(made, [0, -1])
        self._grid(made)

    def _drop_empty(self, n: Node, at: list[int]) -> None:
        """Rows without cells go, unless a cell reaches into them from above; so do row groups left empty. at: row, last row reached."""
        kept: list[Node | list[Word]] = []
        for k in n.kids:
            if isinstance(k, Node) and k.type == "TR":
                row, at[0] = at[0], at[0] + 1
                cells = [c for c in k.nodes() if c.span]
                at[1] = max([at[1], *(row + c.span[1] - 1 for c in cells)])
                if not (cells or at[1] >= row or any(isinstance(c, list) and c for c in k.kids)):
                    continue
            elif isinstance(k, Node) and k.type in GROUPS:
                at[1] = -1
                self._drop_empty(k, at)
                at[1] = -1
                if not k.kids:
                    continue
            kept.append(k)
        n.kids = kept

    def _grid(self, table: Node) -> None:
        """Column places, header ids and scopes, fill-up cells for short rows, and the header cells of each data cell."""
        rows: list[tuple[Node, bool, int]] = []  # row, is it in a head, its group

        def collect(n: Node, head: bool, group: list[int]) -> None:
            own = group[0]
            for k in n.nodes():
                if k.type == "TR":
                    rows.append((k, head, own))
                elif k.type in GROUPS:
                    group[0] += 1
                    collect(k, k.type == "THead", group)
                    group[0] += 1
                    own = group[0]

        collect(table, False, [0])
        ends: dict[int, int] = {}
        for r, (_, _, group) in enumerate(rows):
            ends[group] = r + 1
        place: dict[tuple[int, int], Node] = {}
        for r, (row, head, group) in enumerate(rows):
            c = 0
            for cell in [k for k in row.nodes() if k.span]:
                while (r, c) in place:
                    c += 1
                cell.span[1] = min(cell.span[1], ends[group] - r)
                wide, high = cell.span
                place |= {(r + i, c + j): cell for i in range(high) for j in range(wide)}
                if cell.type == "TH":
                    self.header_cells += 1
                    cell.elem_id = f"{self.prefix}th{self.header_cells}"
                    cell.attrs = cell.attrs or {"O": "Table", "Scope": "Column" if head or r == 0 else "Row"}
                spans = ({"ColSpan": str(wide)} if wide > 1 else {}) | ({"RowSpan": str(high)} if high > 1 else {})
                if spans:
                    cell.attrs = {"O": "Table"} | cell.attrs | spans
                c += wide
        width = [0] * len(rows)
        for r, _ in place:
            width[r] += 1
        for r, (row, _, _) in enumerate(rows):
            if (gap := max(width) - width[r]) > 0:
                row.kids.append(Node("TD", span=[gap, 1], headers=[], attrs={"O": "Table", "ColSpan": str(gap)} if gap > 1 else {}))
        above: dict[int, list[Node]] = {}
        beside: dict[int, list[Node]] = {}
        for r, c in sorted(place):
            cell = place[r, c]
            if cell.type == "TD" and cell.headers is None:
                cell.headers = list(dict.fromkeys(h.elem_id for h in (*above.get(c, ()), *beside.get(r, ()))))
            if cell.type == "TH" and cell.attrs["Scope"] != "Row":
                above.setdefault(c, []).append(cell)
            if cell.type == "TH" and cell.attrs["Scope"] != "Column":
                beside.setdefault(r, []).append(cell)

    def rows(self) -> tuple[list[dict], list[dict]]:
        """The page's nodes and words, in reading order."""
        nodes, words, new_line = [], [], True

        def visit(n: Node, parent: int, order: int, depth: int, block: int) -> None:
            nonlocal new_line
            own = len(nodes) + 1
            form = n.form and n.form | {"label_words": [w.text for w in n.form["label_words"]]}
            nodes.append({"node_id": own, "parent_id": parent, "ord": order, "depth": depth, "block": block, "attrs": list(n.attrs.items()), "headers": n.headers, "colspan": n.span and n.span[0], "rowspan": n.span and n.span[1], "form": form, **{k: getattr(n, k) for k in ("type", "alt", "mathml", "title", "lang", "elem_id", "href", "image")}})
            new_line = new_line or n.type not in INLINE
            for k, kid in enumerate(n.kids):
                if isinstance(kid, Node):
                    visit(kid, own, k, depth + 1, block)
                    continue
                for w in kid:
                    words.append({"word_ord": len(words), "node_id": own, "block": block, "text": w.text, "norm": norm(w.text), "space": w.space, "new_line": new_line})
                    new_line = False
            new_line = new_line or n.type not in INLINE

        for k, kid in enumerate(self.top.kids):
            visit(kid, 0, k, 0, k)
        return nodes, words


def _count(v: str | None) -> int:
    try:
        return max(1, min(int(float(v)), 1000)) if v else 1
    except (ValueError, OverflowError):
        return 1


HANDLERS = {"ul": "list", "ol": "list", "li": "item", "dl": "definitions", "img": "image", "math": "math", "a": "link", "input": "control", "select": "control", "textarea": "control", "fieldset": "fieldset", "nav": "section", "aside": "section", "section": "section", "table": "table", "th": "cell", "td": "cell"} | {f"h{k}": "heading" for k in range(1, 7)}


def page_structure(pages: DataFrame, html: str = "html", lang: str | None = None, shift: str | None = None, prefix: str | None = None) -> DataFrame:
    """``pages`` without the HTML, with nodes, words, warnings and images (how many <img> the page has).

    lang, shift, prefix: columns with the document's language (en if none), heading shift and id prefix. A null page has no nodes.
    """
    keys = [f for f in pages.schema if f.name not in (html, "nodes", "words", "warnings", "images")]
    made = [T.ArrayType(T.StructType.fromDDL(ddl)) for ddl in (NODE, WORD, WARNING)]
    schema = T.StructType([*keys, *map(T.StructField, ("nodes", "words", "warnings"), made), T.StructField("images", T.IntegerType())])
    kinds = [to_arrow_type(t) for t in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            n = len(keys)
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                built: list[list] = [[], [], [], []]
                for text, language, levels, mark in zip(*(part.column(n + k).to_pylist() for k in range(4))):
                    page = Page(text or "", language or "en", mark or "", levels or 0)
                    nodes, words = page.rows()
                    for column, value in zip(built, (nodes, words, [{"code": c, "detail": d} for c, d in page.warnings], page.images)):
                        column.append(value)
                arrays = [pa.array(x, t) for x, t in zip(built, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), *arrays, pa.array(built[3], pa.int32())], names=schema.names)

    extra = [F.col(html).alias("__html"), (F.col(lang) if lang else F.lit("en")).alias("__lang"), (F.col(shift).cast("int") if shift else F.lit(0)).alias("__shift"), (F.col(prefix) if prefix else F.lit("")).alias("__prefix")]
    return pages.select(*(f.name for f in keys), *extra).mapInArrow(run, schema)


def exploded(structure: DataFrame, what: str) -> DataFrame:
    """``nodes``, ``words`` or ``warnings`` as rows, with the page's keys."""
    keys = [c for c in structure.columns if c not in ("nodes", "words", "warnings", "images")]
    return structure.select(*keys, F.inline(what))


def type_counts(nodes: DataFrame, *keys: str) -> DataFrame:
    """Elements by structure type; with the total as a row of null type."""
    return nodes.rollup(*keys, "type").agg(F.count(F.lit(1)).alias("elements")).where(F.col(keys[-1]).isNotNull() if keys else F.lit(True))


def heading_shift(nodes: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, first_level, shift, detail): how far a document's headings move up, so that its first one is of level 1."""
    levels = nodes.where(F.col("type").rlike("^H[1-6]$")).withColumn("level", F.substring("type", 2, 1).cast("int"))
    out = levels.groupBy(doc).agg(F.min_by("level", F.struct(page, "node_id")).alias("first_level"), F.min("level").alias("least"))
    shift = F.col("first_level") - 1
    above = F.when(F.col("least") < F.col("first_level"), F.concat(F.lit(" Headings above h"), "first_level", F.lit(" are all tagged H1."))).otherwise("")
    said = F.concat(F.lit("The first heading is h"), "first_level", F.lit("; every heading is tagged "), shift, F.when(shift > 1, " levels").otherwise(" level"), F.lit(" higher, so the first is H1."), above)
    return out.select(doc, "first_level", shift.alias("shift"), F.when(shift > 0, said).alias("detail"))


def shifted_level(level: Column, shift: Column) -> Column:
    return F.greatest(F.lit(1), level - shift)


def element_text(words: DataFrame, *keys: str) -> DataFrame:
    """Each node's own words, joined as they are spaced."""
    piece = F.concat("text", F.when(F.col("space"), " ").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("word_ord", piece.alias("piece"))))
    return words.groupBy(*keys, "node_id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")).alias("text"))


def nearest_language(nodes: DataFrame, default: str, *keys: str) -> DataFrame:
    """Each node's language: its own, or that of the nearest node above that has one. Nodes are in reading order, so a node's
    ancestors are, at each lower depth, the last node before it."""
    w = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("depth", "node_id", "lang")).over(w)
    last = F.aggregate(seen, F.array().cast("array<struct<depth:int,node_id:int,lang:string>>"), lambda acc, x: F.array_append(F.filter(acc, lambda y: y["depth"] < x["depth"]), x))
    found = F.filter(last, lambda x: x["lang"].isNotNull())
    return nodes.withColumn("language", F.coalesce(F.get(F.reverse(found), F.lit(0))["lang"], F.lit(default)))
