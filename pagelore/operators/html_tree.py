"""HTML fragments to element trees, by the tree-construction rules that documents rely on.

Covered: implied end tags, void elements, tbody insertion, rows and cells that close each other, text inside tables moved before
them, raw text elements, comments dropped, html/head/body tags dropped with their content kept. Not covered: the adoption agency
for misnested formatting elements (an end tag closes up to its element), and foreign-content rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset("address applet area article aside base blockquote body button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe img input li link listing main marquee menu meta nav noscript object ol p param plaintext pre script section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
DROPPED = frozenset(("html", "head", "body", "frameset", "frame"))


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Element | str] = field(default_factory=list)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.kids))
        return "".join(out)

    def elements(self):
        """This element and those below it, in order."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(k for k in reversed(e.kids) if not isinstance(k, str))


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ("textarea", "title")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]

    def _in_scope(self, tags, stop=SCOPE) -> int:
        """Place of the innermost open element of the tags, or 0 if a scope boundary comes first."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return 0
        return 0

    def _close(self, at: int) -> None:
        if at:
            del self.open[at:]

    def _table_context(self, tag: str) -> bool:
        """Bring the stack to where a table part belongs; False if there is no table for it."""
        table = self._in_scope(("table", "template"), stop=())
        if not table or self.open[table].tag != "table":
            return False
        floor = table
        if tag in ("td", "th"):
            row = self._in_scope(("tr",), stop=("table",))
            if not row:
                self._start("tr", {})
                row = self._in_scope(("tr",), stop=("table",))
            floor = row
        elif tag == "tr":
            group = self._in_scope(ROW_GROUPS, stop=("table",))
            if not group:
                del self.open[table + 1 :]
                self._push("tbody", {})
                group = len(self.open) - 1
            floor = group
        del self.open[floor + 1 :]
        return True

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        e = Element(tag, attrs)
        self._home(None).append(e)
        self.open.append(e)

    def _home(self, text: str | None) -> list:
        """Where a child goes: what strays into a table's own structure goes before the table."""
        top = self.open[-1]
        if top.tag in ("table", "tr", *ROW_GROUPS) and (text is None and self._stray or text is not None and text.strip()):
            table = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == "table") if any(e.tag == "table" for e in self.open) else 0
            if table:
                kids = self.open[table - 1].kids
                at = next((k for k, x in enumerate(kids) if x is self.open[table]), len(kids))
                before = kids[:at]
                tail = kids[at:]
                return _Before(kids, before, tail)
        return top.kids

    _stray = False

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in DROPPED:
            return
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
            if not self._table_context(tag):
                return  # ignored outside a table
            self._push(tag, attrs)
            if tag == "col":
                self.open.pop()
            return
        if tag == "table":  # outside a cell or caption it ends the table that is open
            self._close(self._in_scope(("table",), stop=("td", "th", "caption", "template")))
        if tag in CLOSES_P:
            self._close(self._in_scope(("p",), SCOPE | {"button"}))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag == "li":
            self._close_item(("li",))
        elif tag in ("dd", "dt"):
            self._close_item(("dd", "dt"))
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag == "a":
            self._close(self._in_scope(("a",)))
        elif tag == "button":
            self._close(self._in_scope(("button",)))
        elif tag == "form" and any(e.tag == "form" for e in self.open):
            return
        if tag == "image":
            tag = "img"
        # asked once the elements that it ends are closed: a second stray p stands in the table again
        self._stray = self.open[-1].tag in ("table", "tr", *ROW_GROUPS) and tag not in ("script", "style", "template")
        self._push(tag, attrs)
        self._stray = False
        if tag in VOID:
            self.open.pop()

    def _close_item(self, tags) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                del self.open[k:]
                return
            if tag in SPECIAL and tag not in ("address", "div", "p"):
                return

    def handle_starttag(self, tag, attrs):
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        self._start(tag, kept)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and self._foreign():
            self.open.pop()

    def _foreign(self) -> bool:
        return any(e.tag in ("math", "svg") for e in self.open)

    def handle_endtag(self, tag):
        if tag in DROPPED or tag in VOID and tag != "br":
            return
        if tag == "br":
            return self._start("br", {})
        if tag == "p" and not self._in_scope(("p",), SCOPE | {"button"}):
            self._push("p", {})
        if tag in HEADINGS:
            return self._close(self._in_scope(HEADINGS))
        if tag == "li":
            return self._close(self._in_scope(("li",), SCOPE | {"ol", "ul"}))
        if tag in ("table", "tr", "td", "th", "caption", *ROW_GROUPS):
            return self._close(self._in_scope((tag,), stop=("table",) if tag != "table" else ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in SPECIAL and tag not in SPECIAL:
                return
            if self.open[k].tag in SCOPE:
                return

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag in ("pre", "textarea", "listing") and not top.kids and data.startswith("\n"):
            data = data[1:]
        if not data:
            return
        kids = self._home(data)
        last = kids[-1] if len(kids) else None
        if isinstance(last, str):
            kids[-1] = last + data
        else:
            kids.append(data)


class _Before(list):
    """Children of an element up to a table; what is added goes in front of the table."""

    def __init__(self, kids: list, before: list, tail: list):
        super().__init__(before)
        self._kids, self._tail = kids, tail

    def append(self, x) -> None:
        super().append(x)
        self._kids[:] = [*self, *self._tail]

    def __setitem__(self, k, x) -> None:
        super().__setitem__(k, x)
        self._kids[:] = [*self, *self._tail]


def parse(html: str) -> Element:
    """The tree of a fragment; its root has the tag ``#root``."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
