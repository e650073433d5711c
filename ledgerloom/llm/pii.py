"""Personal data: emails, IP addresses, payment cards and phone numbers, plain and disguised.

Plain identifiers come from fixed patterns. Disguised ones (homoglyphs, spelled digits, "at"/"dot" words) come from
transducers that rewrite the text and keep, for each rewritten stretch, the source characters it stands for; identifiers
found on the rewritten text are mapped back to source offsets. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended, map_batches, place

KINDS = ("email", "ip", "card", "phone")
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits begins, so the lookbehind changes no result and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches: each is tied to the @ that ends a run of local characters."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of plain identifiers, by start and then kind."""
    out = []
    if "@" in t:
        out += [(a, 0, b) for a, b in _emails(t)]
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if 14 <= len(m[0]) and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Characters that look like ASCII ones, Cyrillic first, then Greek, then others.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ" "οανιρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "＠﹫．。․‐‑‒–—−﹣⁺＋", "aeopcyxijsdhqwABEKMHOPCTXIJS" "oaviptuABEZHIKMNOPTYX" + "@@..." + "-------" + "++", strict=True))
_GLYPHS = {**_LOOKALIKE, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}}
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # decimal digits of other scripts and styles
    _GLYPHS.update({chr(_zero + d): str(d) for d in range(10)})
_GLYPHS.update({c: "" for c in "​‌‍⁠﻿­"})  # invisible characters
# Digit words in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SIGN = "|".join(_SIGNS)
_NUMBER = re.compile(rf"(?:(?:plus|\+)[ \t,-]{{0,2}})?(?<![^\W_])(?:{_WORD}|[0-9]+)(?:[ \t,.-]{{1,3}}(?:{_WORD}|{_SIGN}|[0-9]+)(?![^\W_]))+", re.IGNORECASE)
_PART = re.compile(r"[^\W_]+|\+", re.IGNORECASE)
_RUN = re.compile(r"[^\W_]+")
_GLYPH = re.compile("[" + re.escape("".join(_GLYPHS)) + "]")
_AT = r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba|arobase)\s{0,3}[\])}>]\s{0,3}"
_DOT = r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|punto|point)\s{0,3}[\])}>]\s{0,3}"
_BRACKET = re.compile(f"(?P<at>{_AT})|(?P<dot>{_DOT})", re.IGNORECASE)
_BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:(?: dot [A-Za-z0-9._%+-]{1,64}){1,4} at [A-Za-z0-9-]{1,64}(?:(?: dot |\.)[A-Za-z0-9-]{1,64}){1,7}"
    r"| at [A-Za-z0-9-]{1,64}(?:(?: dot |\.)[A-Za-z0-9-]{1,64}){0,6} dot [A-Za-z0-9-]{1,24})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_BARE_WORD = re.compile(r" (at|dot) ", re.IGNORECASE)


def _number(m: re.Match, least: int = 1) -> list[tuple[int, int, str]]:
    """Rewrites of one run of digit words, digits and sign words; none if fewer than `least` digits of it are spelled."""
    parts = [(p.start(), p.end(), p[0]) for p in _PART.finditer(m.string, m.start(), m.end())]
    if sum(p.lower() in _SPELLED for *_, p in parts) < least:
        return []
    out, last = [], None
    for a, b, p in parts:
        new = _SPELLED.get(p.lower()) or _SIGNS.get(p.lower()) or p
        if last is not None and a > last and m.string[last:a] != ".":
            out.append((last, a, ""))
        if new != p:
            out.append((a, b, new))
        last = b
    return out


def _plain_glyphs(t: str) -> bool:
    """Whether t has none of the characters that _GLYPHS rewrites; most texts are told by a quick encoding."""
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return _GLYPHS.keys().isdisjoint(t)
    return "\u00ad" not in t


def _spelled(t: str) -> bool:
    """Whether t has a digit word at all, as a run of letters and digits like _PART's: a run of _NUMBER that is rewritten has one."""
    return not _SPELLED.keys().isdisjoint(_RUN.findall(t.lower()))


def rewrites(t: str, least: int = 1) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, replacement) by start: what the transducers change in t, of runs of numbers those with `least` spelled digits."""
    out: list[tuple[int, int, str]] = []
    if not t.isascii() and not _plain_glyphs(t):
        out += [(m.start(), m.end(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(t)]
    if any(x in t for x in "[({<"):
        out += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(t)]
    if " dot " in t.lower():
        for m in _BARE.finditer(t):
            out += [(w.start(), w.end(), "@" if w[1].lower() == "at" else ".") for w in _BARE_WORD.finditer(t, m.start(), m.end())]
    if _spelled(t):
        for m in _NUMBER.finditer(t):
            out += _number(m, least)
    out.sort()
    kept, end = [], 0
    for a, b, new in out:
        if a >= end:
            kept.append((a, b, new))
            end = b
    return kept


class _Overlap:
    """Whether a span overlaps one of a list, by kind; the spans of a kind do not overlap each other."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.of: list[tuple[list[int], list[int]]] = [([], []) for _ in KINDS]
        for a, k, b in sorted(spans):
            self.of[k][0].append(a)
            self.of[k][1].append(b)

    def __call__(self, a: int, kind: int, b: int) -> bool:
        starts, ends = self.of[kind]
        k = bisect_left(starts, b) - 1  # the last that starts before b; those before it end sooner
        return k >= 0 and ends[k] > a


def disguised_spans(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that only the rewritten text shows, as source spans; none that overlaps a plain one of its kind.

    Numbers with few spelled digits are rewritten beside the others and not instead: a digit word can belong to an address ("jane at two dot com").
    Bounds of the disguises: an address spelled with bare words has parts of at most 64 characters, up to four " dot "
    before its " at " and seven labels behind it, and one spelled " dot " at least; digit words are those of English, German, French and Spanish.
    """
    changes = rewrites(t)
    if not changes:
        return []
    overlaps = _Overlap(base)
    found = set(_found(t, changes, overlaps))
    if (fewer := rewrites(t, 4)) != changes:
        found |= set(_found(t, fewer, overlaps))
    # Of spans of one kind, those inside another go: by start, the longest first, a span inside an earlier one ends no later.
    kept, reach = [], [-1] * len(KINDS)
    for a, k, b in sorted(found, key=lambda x: (x[0], -x[2])):
        if b > reach[k]:
            kept.append((a, k, b))
            reach[k] = b
    return sorted(kept)


def _found(t: str, changes: list[tuple[int, int, str]], overlaps: _Overlap) -> list[tuple[int, int, int]]:
    if not changes:
        return []
    pieces, at, places, sources, long = [], 0, [], [], 0
    for a, b, new in changes:
        pieces += [t[at:a], new]
        places.append((long + a - at, long + a - at + len(new)))
        sources.append((a, b))
        long, at = places[-1][1], b
    pieces.append(t[at:])
    begins, ends = [p[0] for p in places], [p[1] for p in places]

    def source(p: int, last: bool) -> int:
        """The source offset of the rewritten character p: where its stretch starts or (last) where it ends."""
        k = bisect_right(begins, p) - 1
        if k < 0:
            return p + last
        if p < ends[k]:
            return sources[k][1] if last else sources[k][0]
        return sources[k][1] + p - ends[k] + last

    out = []
    for a, kind, b in base_spans("".join(pieces)):
        written, gone = bisect_right(ends, a), bisect_right(begins, a)  # the first stretches that end, and that begin, behind a
        if (written < len(begins) and begins[written] < b) or (gone < len(begins) and begins[gone] < b):
            x, y = source(a, False), source(b - 1, True)
            if not overlaps(x, kind, y):
                out.append((x, kind, y))
    return out


# Whole cards and phones inside a longer run of digits that failed as one match ("+1 (736) 555-2678 4524132264652876").
_LONE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})(?![0-9])")
_LONE_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])")


def nested_spans(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Cards and phones that the plain patterns lose because their match runs on into a neighbour."""
    if not _DIGIT.search(t):
        return []
    found = [(m.start(), 2, m.end()) for m in _LONE_CARD.finditer(t) if luhn(re.sub("[ -]", "", m[0]))]
    if "+" in t:
        found += [(m.start(), 3, m.end()) for m in _LONE_PHONE.finditer(t) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    overlaps = _Overlap(base)
    return [x for x in found if not overlaps(*x)]


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans; all spans."""
    base = base_spans(text) if text else []
    known = base + nested_spans(text, base) if text else []
    return base, sorted(known + disguised_spans(text, known)) if text else []


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans share the first one's mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """docs (text, any other columns) with n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    The counts and base_sha256 cover plain identifiers, spans also disguised ones. Null and empty texts have none: counts
    0, the SHA-256 of nothing, spans empty. Very long texts are read whole, in time that grows with their length. Rows are
    judged one by one, so ties and repeats play no part; an empty table gives an empty result. Columns with the names of
    results are replaced, others, however named, come back unchanged. No shuffle.
    """
    schema = appended(docs.schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py()) for t in batch.column(place(batch.schema.names, "text"))]
            bases = [b for b, _ in found]
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name.lower() not in _NEW]
            new = [pa.array([sum(s[1] == k for s in b) for b in bases], pa.int64()) for k in range(4)]
            new += [pa.array([hashlib.sha256(render(b).encode()).hexdigest() for b in bases], pa.string()), pa.array([render(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + new, names=[n for n, _ in kept] + list(schema.names[-6:]))

    return map_batches(docs, run, schema)


_NEW = {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with its spans replaced in text, and n_chars, where there is such a column of whole numbers, set to the new length.

    Null texts stay null, with their n_chars. Very long texts are read whole, rows are judged one by one, an empty table gives an
    empty one. Other columns, those named like results of find_pii() too, come back unchanged.
    """
    schema = docs.schema
    counted = any(f.name.lower() == "n_chars" and isinstance(f.dataType, T.IntegralType) for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.schema.names, list(batch.columns)
            k = place(names, "text")
            texts = [None if (t := x.as_py()) is None else redact(t, spans_of(t)[1]) for x in columns[k]]
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            if counted:
                j = place(names, "n_chars")
                columns[j] = pa.array([old.as_py() if t is None else len(t) for t, old in zip(texts, columns[j], strict=True)]).cast(batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, schema)
