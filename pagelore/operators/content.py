"""Content streams: operators, strings, old marks, character maps, images. Streams are binary; a byte is one Latin-1 character here."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import per_row

WHITE = "\0\t\n\f\r "
_TOKEN = re.compile(rb"[\0\t\n\f\r ]+|%[^\r\n]*|\(|<<|>>|<[^>]*>?|[\[\]{}]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|[)>]".replace(b"\\0", b"\\x00"), re.S)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\Z")
_PAREN = re.compile(r"\\.|[()]", re.S)
_ID = re.compile(rf"[{WHITE}]ID[{WHITE}]")
_EI = re.compile(rf"[{WHITE}]EI(?![^{WHITE}])")
VALUES = frozenset(("true", "false", "null"))
#: Limits of character maps: bytes of a map, codes of a range.
MAP_BYTES, RANGE_CODES = 1 << 20, 255
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


@dataclass
class Op:
    op: str
    args: list[str]
    start: int
    end: int


def _string_end(s: str, at: int) -> int:
    """Where the literal string that opens at ``at`` ends; the end of the stream if it isn't closed."""
    depth = 0
    for m in _PAREN.finditer(s, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(s)


def operators(s: str) -> list[Op]:
    """The stream's operators with their operands; an inline image is one operator up to its end."""
    out: list[Op] = []
    args, start, at, data = [], -1, 0, s.encode("latin-1")
    while m := _TOKEN.match(data, at):
        word, begin, at = m[0].decode("latin-1"), m.start(), m.end()
        if word[0] in WHITE or word[0] == "%" or word == ")" or word == ">":
            continue
        if word == "(":
            at = _string_end(s, begin)
            word = s[begin:at]
        elif word[0] not in "<>[]{}/" and not _NUMBER.match(word) and word not in VALUES:
            if word == "BI":
                opened = _ID.search(s, at)
                closed = opened and _EI.search(s, opened.end())
                at = closed.end() if closed else len(s)
            out.append(Op(word, args, begin if start < 0 else start, at))
            args, start = [], -1
            continue
        start = begin if start < 0 else start
        args.append(word)
    return out


def unmarked(s: str) -> str:
    """The stream without marked content; optional content decides what is drawn, so it stays."""
    gone, open_ = [], []
    for o in operators(s):
        if o.op in ("BMC", "BDC"):
            stays = bool(o.args) and o.args[0] == "/OC"
            open_.append(stays)
            gone += [] if stays else [o]
        elif o.op in ("MP", "DP") or o.op == "EMC" and not (open_ and open_.pop()):
            gone.append(o)
    for o in reversed(gone):
        s = f"{s[: o.start]} {s[o.end :]}"
    return s


def without_strings(s: str) -> str:
    """Without string literals, comments and inline images' data; as it was if a string or an image isn't closed."""
    out, at = [], 0
    for m in iter(lambda: re.compile(rf"\(|%[^\n\r]*|(?<=[{WHITE}])ID(?=[{WHITE}])|\AID(?=[{WHITE}])").search(s, at), None):
        out.append(s[at : m.start()])
        if m[0] == "(":
            end = _string_end(s, m.start())
            if s[end - 1 : end] != ")" or _unclosed(s, m.start(), end):
                return s
        elif m[0] == "ID":
            found = _EI.search(s, m.end() + 1)
            if not found:
                return s
            out.append(" ")
            end = found.end()
        else:
            end = m.end()
        at = end
    return "".join([*out, s[at:]])


def _unclosed(s: str, start: int, end: int) -> bool:
    depth = sum({"(": 1, ")": -1}.get(m[0], 0) for m in _PAREN.finditer(s, start, end))
    return depth != 0


def string_bytes(t: str) -> str | None:
    """A string operand's bytes, one character each; null if it is malformed."""
    if t.startswith("<"):
        digits = re.sub(f"[{WHITE}]", "", t[1:-1])
        if not t.endswith(">") or re.search("[^0-9a-fA-F]", digits):
            return None
        return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1")
    if len(t) < 2 or t[0] != "(" or t[-1] != ")":
        return None

    def plain(m: re.Match) -> str:
        x = m[0]
        if x in ("\r", "\r\n"):
            return "\n"
        x = x[1:]
        if x in ESCAPES:
            return ESCAPES[x]
        return chr(int(x, 8) & 255) if x[:1] in tuple("01234567") else "" if x in ("\n", "\r", "\r\n") else x

    return re.sub(r"\\(?:[0-7]{1,3}|\r\n|.)|\r\n?", plain, t[1:-1], flags=re.S)


def _valid(u: int) -> bool:
    return u <= 0x10FFFF and not 0xD800 <= u <= 0xDFFF


def character_map(cmap: str) -> dict[int, str]:
    """Codes to text from a map's character and range sections; over-long ranges and invalid code points are left out."""
    out: dict[int, str] = {}
    if len(cmap) > MAP_BYTES:
        return out
    hexa = lambda n: f"<([0-9a-fA-F]{{1,{n}}})>"
    for body in re.findall("beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, text in re.findall(rf"{hexa(8)}\s*{hexa(1024)}", body):
            units = [int(text[k : k + 4], 16) for k in range(0, len(text) - 3, 4)]
            out[int(code, 16)] = "".join(chr(u) for u in units if _valid(u))
    for body in re.findall("beginbfrange(.*?)endbfrange", cmap, re.S):
        for row in re.findall(rf"{hexa(8)}\s*{hexa(8)}\s*{hexa(8)}", body):
            low, high, to = (int(x, 16) for x in row)
            if high - low <= RANGE_CODES:
                out |= {c: chr(to + c - low) for c in range(low, high + 1) if _valid(to + c - low)}
    return out


def image_boxes(s: str, images: set[str], page: tuple = (1, 0, 0, 1, 0, 0)) -> list[tuple[int, tuple, bool]]:
    """(operator, box in page space, may have a mark of its own) of each image drawn. ``images``: names that are images."""
    matrix = lambda v: np.array([[v[0], v[1], 0], [v[2], v[3], 0], [v[4], v[5], 1]], float)
    now, stack, depth, out = np.eye(3), [], {"T": 0, "M": 0}, []
    for k, o in enumerate(operators(s)):
        if o.op == "q":
            stack.append(now)
        elif o.op == "Q":
            now = stack.pop() if stack else now
        elif o.op == "cm" and len(o.args) == 6:
            now = matrix([float(x) for x in o.args]) @ now
        elif o.op in ("BT", "BMC", "BDC"):
            depth["T" if o.op == "BT" else "M"] += 1
        elif o.op in ("ET", "EMC"):
            which = "T" if o.op == "ET" else "M"
            depth[which] = max(0, depth[which] - 1)
        elif o.op == "BI" or o.op == "Do" and o.args and o.args[0][1:] in images:
            corners = np.array([[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]], float) @ now @ matrix(page)
            x, y = corners[:, 0], corners[:, 1]
            out.append((k, (x.min(), y.min(), x.max(), y.max()), not any(depth.values())))
    return out


def marked_strings(s: str, maps: dict[str, dict[int, str]], widths: dict[str, int]) -> dict[int, str]:
    """Text of each marked-content id, decoded by the current font's map. widths: bytes of a code by font (1 by default)."""
    out: dict[int, list[str]] = {}
    ids: list[int | None] = []
    font, fonts = "", []
    for o in operators(s):
        if o.op == "q":
            fonts.append(font)
        elif o.op == "Q":
            font = fonts.pop() if fonts else font
        elif o.op == "Tf" and o.args:
            font = o.args[0][1:]
        elif o.op in ("BMC", "BDC"):
            named = re.search(r"/MCID\s+([0-9]+)", " ".join(o.args[1:]))
            ids.append(int(named[1]) if named else None)
        elif o.op == "EMC":
            ids[-1:] = []
        elif o.op in ("Tj", "TJ", "'", '"') and (inside := next((i for i in reversed(ids) if i is not None), None)) is not None:
            n, codes = widths.get(font, 1), maps.get(font, {})
            for t in o.args:
                data = string_bytes(t) if t[0] in "(<" else None
                for k in range(0, len(data or ""), n):
                    code = int.from_bytes(data[k : k + n].encode("latin-1"), "big")
                    out.setdefault(inside, []).append(codes.get(code, data[k : k + n] if n == 1 else ""))
    return {k: "".join(v) for k, v in out.items()}


def operator_rows(streams: DataFrame, content: str, *keys: str) -> DataFrame:
    """(keys, op_ord, op, args, start, end) of binary streams."""
    kinds = ", ".join(f"`{k}` {streams.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*r[:-1], k, o.op, o.args, o.start, o.end) for r in frame.itertuples(index=False) if r[-1] is not None for k, o in enumerate(operators(bytes(r[-1]).decode("latin-1")))]
            yield pd.DataFrame(rows, columns=[*keys, "op_ord", "op", "args", "start", "end"])

    return streams.select(*keys, content).mapInPandas(run, f"{kinds}, op_ord int, op string, args array<string>, start int, end int")


def leftover_ids(streams: DataFrame, content: str, *keys: str) -> DataFrame:
    """Keys of streams that still have marked-content ids outside strings."""
    bare = F.pandas_udf(_without_strings, "string")
    return streams.where(bare(F.decode(content, "ISO-8859-1")).rlike(r"/MCID[\x00\t\n\f\r ]+[0-9]")).select(*keys)


def _without_strings(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else without_strings(x))


def _text(content: bytes | None) -> str:
    return bytes(content or b"").decode("latin-1")


def marked_texts(streams: DataFrame, *keys: str) -> DataFrame:
    """(keys, mcid, text): what each marked-content sequence of a stream says.

    streams: content BINARY and fonts array<struct<name, cmap string, width int>>, each font's character map and bytes of a code. Joined to
    structure nodes by page and mcid it is their text. A null stream says nothing.
    """

    def texts(content, fonts):
        maps = {f["name"]: character_map(f["cmap"] or "") for f in fonts or []}
        return sorted(marked_strings(_text(content), maps, {f["name"]: f["width"] or 1 for f in fonts or []}).items())

    return per_row(streams, list(keys), ["content", "fonts"], texts, "mcid int, text string")


def drawn_images(streams: DataFrame, *keys: str) -> DataFrame:
    """(keys, op_ord, box, own_mark): where each image of a stream is drawn, and whether it may have a mark of its own.

    streams: content BINARY, images array<string> (names that are images), transform array<double> (the page's, six numbers).
    """

    def boxes(content, images, transform):
        found = image_boxes(_text(content), set(images or []), tuple(transform or (1, 0, 0, 1, 0, 0)))
        return [(k, dict(zip(("x0", "y0", "x1", "y1"), map(float, box))), bool(own)) for k, box, own in found]

    return per_row(streams, list(keys), ["content", "images", "transform"], boxes, "op_ord int, box struct<x0:double,y0:double,x1:double,y1:double>, own_mark boolean")


def without_marks(streams: DataFrame, *keys: str) -> DataFrame:
    """(keys, content): streams without marked content; what optional content decides stays."""
    return per_row(streams, list(keys), ["content"], lambda content: [(None if content is None else unmarked(_text(content)).encode("latin-1"),)], "content binary")


def decoded_strings(streams: DataFrame, *keys: str) -> DataFrame:
    """(keys, op_ord, arg, bytes): the string operands of a stream as bytes; null if one is malformed."""

    def strings(content):
        every = [(k, a, string_bytes(t)) for k, o in enumerate(operators(_text(content))) for a, t in enumerate(o.args) if t[:1] in ("(", "<") and t[:2] != "<<"]
        return [(k, a, None if s is None else s.encode("latin-1")) for k, a, s in every]

    return per_row(streams, list(keys), ["content"], strings, "op_ord int, arg int, bytes binary")
