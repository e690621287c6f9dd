"""MathML as spoken words and as well-formed XML."""

from __future__ import annotations

import re

from .html_tree import Element

#: Elements that are not spoken, token elements, required numbers of children, accents by character.
SILENT = frozenset(("annotation", "annotation-xml", "mspace", "mphantom", "mprescripts", "none"))
TOKENS = frozenset(("mi", "mn", "mo", "mtext", "ms"))
CHILDREN = {"mfrac": 2, "mroot": 2, "msup": 2, "msub": 2, "msubsup": 3, "munder": 2, "mover": 2, "munderover": 3}
ACCENTS = {"^": "hat", "ˆ": "hat", "¯": "bar", "‾": "bar", "~": "tilde", "˜": "tilde", "˙": "dot", "→": "vector"}
POWERS = {"2": "squared", "3": "cubed", "′": "prime", "'": "prime"}
WHITE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # for a character class
_SPACES = re.compile(rf"[{WHITE}\u2061-\u2064]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z")
_ILLEGAL = re.compile(r"[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def tidy(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


def tokens(e: Element) -> list[str]:
    """Texts of the spoken tokens, in order."""
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out += [tidy(x)] if tidy(x) else []
        elif x.tag not in SILENT:
            todo.extend(reversed(x.kids))
    return out


class Said(str):
    """What a part is read as. In a phrase, ``{1:sub}`` closes a part of several tokens with "end sub"; ``power`` and ``accent`` are read by their tables first."""

    tokens: int

    def __new__(cls, words: str, tokens: int) -> Said:
        made = super().__new__(cls, words)
        made.tokens = tokens
        return made

    def __format__(self, role: str) -> str:
        named, lead, end = ROLES.get(role, ({}, "", role))
        if self in named:
            return named[self]
        return lead + self + (f" end {end}" if end and self.tokens > 1 else "")


#: By role: parts with a word of their own, what leads any other, and what it ends as.
ROLES = {"power": (POWERS, "to the power ", "power"), "accent": (ACCENTS, "over ", "over")}
#: The phrase of each element. One with other elements inside reads them between spaces.
PHRASES = {
    "msqrt": "square root of {all} end root",
    "mroot": "root with index {1} of {0} end root",
    "msup": "{0} {1:power}",
    "msub": "{0} sub {1:sub}",
    "msubsup": "{0} sub {1:sub} {2:power}",
    "munder": "{0} under {1:under}",
    "mover": "{0} {1:accent}",
    "munderover": "{0} from {1} to {2}",
    "mfrac": "{0} over {1}",
    "deep mfrac": "fraction {0} over {1} end fraction",
    "mtable": "table {rows} end table",
    "mtr": "{cells}",
    "mfenced": "{open} {fenced} {close}",
}


def _phrase(e: Element, parts: list[Said]) -> str:
    if e.tag == "semantics":
        return parts[0] if parts else ""
    deep = e.tag == "mfrac" and any(p.tokens > 1 for p in parts)
    between = e.attrs.get("separators", ",").strip()[:1]
    lists = {
        "all": " ".join(parts),
        "rows": ", ".join(f"row {k} {p}" for k, p in enumerate(parts, 1)),
        "cells": ", ".join(parts),
        "fenced": f" {between} ".join(parts),
        "open": e.attrs.get("open", "("),
        "close": e.attrs.get("close", ")"),
    }
    return PHRASES.get("deep mfrac" if deep else e.tag, "{all}").format(*parts, **lists)


def _spoken(e: Element) -> list[Element]:
    return [k for k in e.kids if isinstance(k, Element) and k.tag not in SILENT]


def speak(e: Element) -> str:
    """The spoken words; empty if an element has the wrong number of children. Depth is no limit: parts wait on a stack of their own."""
    waiting: list[tuple[Element, list[Element], list[Said]]] = [(e, [] if e.tag in TOKENS else _spoken(e), [])]
    while True:
        x, rest, parts = waiting[-1]
        if rest:
            kid = rest.pop(0)
            waiting.append((kid, [] if kid.tag in TOKENS else _spoken(kid), []))
            continue
        waiting.pop()
        if x.tag in TOKENS:
            text = "".join(tokens(x))
            said = Said(text, int(text != ""))
        elif len(parts) != CHILDREN.get(x.tag, len(parts)):
            return ""
        else:
            said = Said(_phrase(x, parts), sum(p.tokens for p in parts))
        if not waiting:
            return tidy(said)
        waiting[-1][2].append(said)


def xml(e: Element | str) -> str:
    """The element as XML in the MathML namespace; names and characters that XML doesn't allow are dropped, content is kept."""
    clean = lambda s: _ILLEGAL.sub("", s).translate(_ENTITIES)
    out: list[str] = []
    todo: list[tuple[bool, Element | str]] = [(True, e)]
    while todo:
        opens, x = todo.pop()
        if isinstance(x, str):
            out.append(clean(x) if opens else f"</{x}>")
            continue
        if named := _NAME.match(x.tag):
            given = {k: v for k, v in x.attrs.items() if _NAME.match(k) and k != "xmlns"}
            every = {"xmlns": "http://www.w3.org/1998/Math/MathML", **given} if x.tag == "math" else given
            out.append(" ".join([f"<{x.tag}", *(f'{k}="{clean(v)}"' for k, v in every.items())]) + ">")
            todo.append((False, x.tag))
        todo += [(True, k) for k in reversed(x.kids)]
    return "".join(out)
