"""Personal data by weak supervision.

Four kinds (email, ip, card, phone) have exact base patterns; their spans always stay. Further candidates come from wider
patterns: numbers written like phones or cards, spelled-out addresses and identity numbers. On every span, base or not, three
labelers vote yes, no or nothing: a format labeler (strict regular expressions and checksums), a gazetteer labeler (domains, issuer,
area and country prefixes, placeholder values) and a context labeler (words around the span). Expectation-maximisation over the
counts of vote patterns estimates, without labels, each labeler's reliability for each kind, and how many of the kind's base spans
and of its candidates are real. The posteriors then train the final span classifier, a logistic regression over the votes, the shape
and the word before the span (hashed), and it alone decides: a candidate that it accepts is added. All that it sees is a bounded
code, so both fits work on grouped counts of all spans of the corpus, whatever its size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import in_arrow, read, texts, with_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")
LABELERS = 3
WORDS = 33
#: The number of codes. A span's code: kind, a vote (0 no, 1 none, 2 yes) of each labeler, shape (three bits), word before (0: none).
CODES = len(KINDS) * 3**LABELERS * 8 * WORDS

_DIGITS = re.compile(r"[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_NUMBER = re.compile(r"\(?[0-9][0-9().\x20-]*[0-9]")
#: Within a run of numbers that is no phone or card as a whole.
_WITHIN = re.compile(r"(?<![0-9])(?:(\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4})|([0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,16}))(?![0-9])")
_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])")
_WORD = re.compile(r"(\w+)\W*$")
_BEFORE, _AFTER = 32, 12
#: Gazetteers: top-level domains, domains for examples, card issuer prefixes, country calling codes.
TLDS = frozenset("com org net edu gov mil int info biz io dev app co ai me eu uk de fr es it nl be ch at pl pt se no fi dk ie cz ru ua cn jp kr in br mx ar cl ca us au nz za tr gr ro hu".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", *map(str, range(2221, 2721)), "34", "37", "6011", "65", "35", "30", "36", "38")
IBAN_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VA XK".split())
#: Addresses that stand for none or for examples, and those of private networks.
_NO_HOST = re.compile(r"0\.|127\.|255\.255\.255\.255|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.")
_PRIVATE = re.compile(r"10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach|courriel|correo|kontakt|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr|ping|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|carte|karte|tarjeta|cvv", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|sms|dial|anruf|t[ée]l[ée]|ll[aá]m", re.I),
    "id": re.compile(r"ssn|social security|iban|passport|tax|insurance|account|konto|compte|cuenta", re.I),
}
_VERSION = re.compile(r"version|chapter|section|page|isbn|\bno\b|serial|order|item|figure|table|release", re.I)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by start, then kind. Each kind is leftmost and non-overlapping; a match that fails its check is dropped."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        at = text.find("@", at + 1)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    n, k = len(runs), 0
    while k + 3 < n:
        if all(runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] == "." for j in range(k, k + 3)):
            parts = [text[a:b].lstrip("0") for a, b in runs[k : k + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", runs[k][0], runs[k + 3][1]))
            k += 4
        else:
            k += 1
    k = 0
    while k < n:
        j = k
        while j + 1 < n and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
        count = sum(b - a for a, b in runs[k : j + 1])
        if 12 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[k : j + 1])):
            out.append(("card", runs[k][0], runs[j][1]))
        k = j + 1
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
            at = m.end() - 1
        at = text.find("+", at + 1)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Wider candidates that overlap no base span and no candidate before them."""
    found: list[tuple[str, int, int]] = []
    if re.search(r"[\[( ]at[\]) ]", text, re.I) and re.search(r"[\[(]dot[\])]| dot |[\[(]at[\])]", text, re.I):
        for m in re.finditer(r"(?:\[at\]|\(at\)| at )", text, re.I):  # from the left of each "at", so that long texts are read once
            s = _SPELLED.search(text, max(0, m.start() - 66), min(len(text), m.end() + 330))
            if s and s.start() <= m.start() < s.end():
                found.append(("email", *s.span()))
    if _DIGITS.search(text):
        found += [("id", *m.span()) for m in _ID.finditer(text)]
        for m in _NUMBER.finditer(text):
            digits = "".join(filter(str.isdigit, m[0]))
            if 7 <= len(digits) < 12 or 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("phone" if len(digits) < 12 else "card", *m.span()))
            elif len(digits) >= 12:
                found += [("phone" if x[1] else "card", *x.span()) for x in _WITHIN.finditer(text, *m.span()) if x[1] or luhn("".join(filter(str.isdigit, x[0])))]
    out: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    k, end = 0, 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0] != "id", KINDS.index(s[0]))):  # an identity number's form is the strictest
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and not (k < len(taken) and taken[k][0] < b):
            out.append((kind, a, b))
            end = b
    return out


def code(text: str, kind: str, start: int, end: int, base: bool) -> int:
    """The span's votes and shape as one number below CODES."""
    s = text[start:end]
    digits = "".join(c for c in s[:64] if c.isdigit())
    before, after = text[max(0, start - _BEFORE) : start], text[end : end + _AFTER]
    if kind == "email":
        form = 2 if base or "dot" in s.lower() else 0
        last = re.split(r"[.\s\])]+", s.rstrip("])"))[-1].lower()
        listed = 2 if last in TLDS else 0
    elif kind == "ip":
        form, listed = (2 if all(p == "0" or p[0] != "0" for p in s.split(".")) else 0), (0 if _NO_HOST.match(s) else 2 if _PRIVATE.match(s) else 1)
    elif kind == "card":
        form, listed = 2 if base or len(digits) in (13, 15, 16) else 0, (2 if digits.startswith(ISSUERS) else 1)
    elif kind == "phone":
        form = 2 if base or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s) else 0
        area = len(digits) == 10 and digits[0] > "1" and digits[3] > "1"  # an area and an exchange of the North American plan
        listed = (2 if digits.startswith(CALLING) else 1) if base else 2 if area else 1
    else:
        form, listed = (2 if re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", s) or _iban(s) else 0), 1
        if s[0].isalpha():
            listed = 2 if s[:2] in IBAN_COUNTRIES else 0
    context = 2 if CONTEXT[kind].search(before) else 0 if _VERSION.search(before) else 1
    clean = not (before[-1:].isalnum() or after[:1].isalnum())
    shape = base + 2 * clean + 4 * (len(set(digits)) > 2 if kind != "email" else "." in s)
    word = _WORD.search(before)
    word = 1 + zlib.crc32(word[1].lower().encode("utf-8", "surrogatepass")) % (WORDS - 1) if word else 0
    return ((((KINDS.index(kind) * 3 + form) * 3 + listed) * 3 + context) * 8 + shape) * WORDS + word


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _parts(c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Kinds, votes of the format, gazetteer and context labelers, shapes, words."""
    rest = c // WORDS // 8
    return rest // 3**LABELERS, [rest // 3**k % 3 for k in reversed(range(LABELERS))], c // WORDS % 8, c % WORDS


def _features(c: np.ndarray) -> np.ndarray:
    """One-hot kinds, votes and words, and shape bits."""
    kind, votes, shape, word = _parts(c)
    return np.column_stack([*(kind == k for k in range(len(KINDS))), *(v == x for v in votes for x in (0, 2)), *(shape >> k & 1 for k in range(3)), *(word == k for k in range(1, WORDS))]).astype(float)


def posteriors(counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """How likely a span of each code is real: expectation-maximisation over the votes, apart for each kind."""
    kind, votes, shape, _ = _parts(np.arange(CODES))
    out = np.full(CODES, 0.5)
    for k in range(len(KINDS)):
        own = kind == k
        n, v, base = counts[own], [x[own] for x in votes], shape[own] & 1
        prior, right = np.array([0.5, 0.5]), np.full((LABELERS, 2), 0.8)  # of candidates and of base spans; P(vote says yes | is), P(vote says no | isn't), given that it votes
        for _ in range(rounds):
            yes = np.log(prior)[base] + sum(np.where(x == 2, np.log(r[0]), np.where(x == 0, np.log(1 - r[0]), 0)) for x, r in zip(v, right))
            no = np.log(1 - prior)[base] + sum(np.where(x == 0, np.log(r[1]), np.where(x == 2, np.log(1 - r[1]), 0)) for x, r in zip(v, right))
            p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
            for b in (0, 1):  # candidates are real in one of three cases as far as is known beforehand, base spans in two
                prior[b] = np.clip(((n * p)[base == b].sum() + 2 * (1 + b)) / (n[base == b].sum() + 6), 0.02, 0.98)
            for j, x in enumerate(v):  # each with the weight of a prior belief of 0.8
                right[j] = [((n * p)[x == 2].sum() + 8) / ((n * p)[x != 1].sum() + 10), ((n * (1 - p))[x == 0].sum() + 8) / ((n * (1 - p))[x != 1].sum() + 10)]
            right = np.clip(right, 0.5, 0.99)
        out[own] = p
    return out


def fit(counts: np.ndarray, decision: float = 0.5) -> np.ndarray:
    """Which codes the span classifier accepts, from the number of spans of each code. Without candidates none."""
    posterior = posteriors(counts)
    c = np.flatnonzero((counts > 0) & (np.arange(CODES) // WORDS % 2 == 0))  # candidates' codes
    x, weight = _features(c), counts[c] / max(1.0, counts[c].sum())
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - posterior[c])) + 1e-4 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), grad)
    return 1 / (1 + np.exp(-np.clip(_features(np.arange(CODES)) @ w, -30, 30))) > decision


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The classifier's decision for each code, from all spans of all texts. Null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CODES, np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                if t:
                    base = base_spans(t)
                    for spans, is_base in ((base, True), (candidates(t, base), False)):
                        for s in spans:
                            seen[code(t, *s, is_base)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["code", "n"])

    rows = in_arrow(docs.select(F.col(text_col).cast("string").alias("text")), count, "code long, n long").groupBy("code").agg(F.sum("n")).collect()  # at most CODES rows
    counts = np.zeros(CODES)
    for c, n in rows:
        counts[c] = n
    return fit(counts)


def all_spans(text: str, accept: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if accept[code(text, *s, False)]]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as its kind in brackets; overlapping spans become one, of the first's kind."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, accept: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (kind:start:end, comma-joined; all spans).

    Offsets are code points, ends exclusive. A null or empty text has no spans (and the digest of an empty string).
    """

    def make():
        def compute(batch: Iterator[str | None]) -> list:
            columns: list[list] = [[] for _ in range(6)]
            for t in batch:
                base, spans = all_spans(t or "", accept)
                for column, value in zip(columns, (*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))):
                    column.append(value)
            return columns

        return compute

    return with_columns(docs, text_col, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", keep)


def redact(docs: DataFrame, accept: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced; null stays null."""

    def make():
        return lambda batch: [[t and redacted(t, all_spans(t, accept)[1]) for t in batch]]

    return with_columns(docs, text_col, make, f"`{text_col}` string")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs), keep=["doc_id"])
