"""Functions, initialisers, subscripts and computed properties cut out of Swift source.

One pass over tokens with a stack of open braces. A token list leaves out comments and the insides of strings, so braces
there count for nothing; an interpolation is skipped with the string that holds it. A brace that closes nothing starts a gap,
which ends at the next declaration that begins a line; a brace never closed is a gap from its line to the end.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Words of the language.
TYPES = {"class", "struct", "enum", "protocol", "extension", "actor"}
MEMBERS = {"func", "init", "subscript", "var"}
MODIFIERS = {
    "public", "private", "internal", "fileprivate", "open", "package", "static", "class", "final", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "required", "convenience",
    "dynamic", "optional", "indirect", "isolated", "nonisolated", "distributed", "prefix", "postfix", "infix", "consuming", "borrowing", "async",
}
OBSERVERS = {"willSet", "didSet"}

_PIECE = re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>#*")|(?P<word>`[^`\n]+`|[^\W\d]\w*)|(?P<op>[-+*/%=<>!&|^~?]+|\.{2,}[<.]?)|(?P<mark>[{}()\[\].,:;@#\\])|(?P<nl>\n)')
_EDGE = re.compile(r"/\*|\*/")
_DOC = re.compile(r"[ \t]*///[ \t]?(.*)")
_KINDS = {"init": "constructor", "subscript": "accessor", "var": "accessor"}


class Token(NamedTuple):
    text: str
    kind: str
    start: int
    line: int


def _after_comment(text: str, i: int) -> int:
    """Behind the block comment that opens at i; they nest."""
    depth = 0
    for m in _EDGE.finditer(text, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _after_string(text: str, i: int) -> int:
    """Behind the string that opens at i. A string of one line ends with the line at the latest."""
    hashes = text.index('"', i) - i
    quote = '"""' if text.startswith('"""', i + hashes) else '"'
    close, escape = quote + "#" * hashes, "\\" + "#" * hashes
    at = i + hashes + len(quote)
    while at < len(text):
        if text.startswith(close, at):
            return at + len(close)
        if text.startswith(escape, at):
            at += len(escape)
            at = _after_group(text, at) if text.startswith("(", at) else at + 1
        elif text[at] == "\n" and quote == '"':
            return at
        else:
            at += 1
    return len(text)


def _after_group(text: str, i: int) -> int:
    """Behind the parenthesis that opens at i."""
    depth = 0
    while m := _PIECE.search(text, i):
        i = m.end()
        if m["block"]:
            i = _after_comment(text, m.start())
        elif m["string"]:
            i = _after_string(text, m.start())
        elif m["mark"] in ("(", ")"):
            depth += 1 if m["mark"] == "(" else -1
            if not depth:
                return i
    return len(text)


def tokens(text: str) -> list[Token]:
    out, i, line = [], 0, 1
    while m := _PIECE.search(text, i):
        at, i = m.start(), m.end()
        if m.lastgroup == "block":
            i = _after_comment(text, at)
        elif m.lastgroup == "string":
            i = _after_string(text, at)
            out.append(Token('""', "string", at, line))
        elif m.lastgroup == "op" and re.search("/[/*]", m[0]):  # an operator ends where a comment starts
            i = at + re.search("/[/*]", m[0]).start()
            out.append(Token(text[at:i], "op", at, line))
        elif m.lastgroup != "line":
            out.append(Token(m[0], m.lastgroup, at, line))
        line += text.count("\n", at, i)
    return out


def _name(seen: list[Token], k: int) -> str:
    """The dotted name at token k, without backticks."""
    parts = []
    while k < len(seen) and seen[k].kind == "word":
        parts.append(seen[k].text.strip("`"))
        if k + 1 >= len(seen) or seen[k + 1].text != ".":
            break
        k += 2
    return ".".join(parts)


def _doc(lines: list[str], line: int) -> str:
    """The /// lines right above a line; lines of attributes between are passed over."""
    found, at = [], line - 2
    while at >= 0 and lines[at].lstrip().startswith("@"):
        at -= 1
    while at >= 0 and (m := _DOC.fullmatch(lines[at])):
        found.append(m[1].strip())
        at -= 1
    return "\n".join(reversed(found))


def _begins_line(seen: list[Token], k: int) -> bool:
    """Only modifiers and attributes stand before token k on its line."""
    while k and seen[k - 1].kind != "nl":
        k -= 1
        if not (seen[k].text in MODIFIERS or seen[k].text in "@()" or (k and seen[k - 1].text in ("@", "("))):
            return False
    return True


def _following(seen: list[Token], k: int) -> str:
    """The next token behind k that isn't a line's end."""
    k += 1
    while k < len(seen) and seen[k].kind == "nl":
        k += 1
    return seen[k].text if k < len(seen) else ""


def _opens(seen: list[Token], k: int) -> str | None:
    """`type` or `member` if a declaration starts at token k."""
    word, before = seen[k].text, seen[k - 1].text if k else "\n"
    after = seen[k + 1] if k + 1 < len(seen) else Token("", "nl", 0, 0)
    if before in (".", "import"):
        return None
    if word in TYPES and after.kind == "word" and after.text not in MODIFIERS | MEMBERS | {"let"} and before not in (":", ","):
        return "type"
    if word in ("func", "var"):
        return "member" if after.kind in ("word", "op") else None
    if word in ("init", "subscript"):
        return "member" if after.text in ("(", "<", "?", "!", "?<", "!<") and before not in ("func", "=", "(", ",", "return") else None
    return None


def scan(text: str) -> tuple[list[dict], list[tuple[int, int]], list[str]]:
    """Chunks by their start, gaps as (first line, last line), and the names of types."""
    text = text.replace("\r\n", "\n")
    seen, lines = tokens(text), text.split("\n")
    chunks: list[dict] = []
    gaps: list[tuple[int, int]] = []
    types: list[str] = []
    stack: list[tuple[str, str | int | None, int]] = []  # what the brace opens, its type's name or its chunk, its line
    pending: tuple[str, int, int] | None = None  # what is declared, its token, the depth of parentheses
    depth, lost = 0, 0
    depths: list[int] = []
    for k, t in enumerate(seen):
        opens = _opens(seen, k) if t.kind == "word" and (not lost or _begins_line(seen, k)) else None
        if lost:
            if not opens:
                continue
            gaps.append((lost, t.line))
            lost = depth = 0
        if opens and not (pending and depth > pending[2]):
            pending = (opens, k, depth)
        elif t.text in ("(", "["):
            depth += 1
        elif t.text in (")", "]"):
            depth = max(0, depth - 1)
        elif t.text == "{":
            entry: tuple[str, str | int | None, int] = ("other", None, t.line)
            if pending and depth == pending[2]:
                what, at, _ = pending
                pending = None
                if what == "type":
                    entry = ("type", _name(seen, at + 1), t.line)
                    types.append(entry[1])
                elif not (seen[at].text == "var" and _following(seen, k) in OBSERVERS):
                    above = [str(n) for kind, n, _ in stack if kind == "type" and n]
                    word = seen[at].text
                    symbol = word if word in ("init", "subscript") else seen[at + 1].text.strip("`")
                    chunks.append({
                        "kind": _KINDS.get(word, "method" if above else "function"), "symbol": symbol, "qualified_name": ".".join([*above, symbol]),
                        "signature": _signature(text, seen[at].start, t.start), "doc": _doc(lines, seen[at].line), "start_line": seen[at].line, "end_line": None,
                    })
                    entry = ("member", len(chunks) - 1, t.line)
            stack.append(entry)
            depths.append(depth)
            depth = 0 if entry[0] != "other" else depth
        elif t.text == "}":
            pending = None if pending and depth <= pending[2] else pending
            if not stack:
                lost = t.line
                continue
            kind, what, _ = stack.pop()
            depth = depths.pop()
            if kind == "member":
                chunks[what]["end_line"] = t.line
        elif pending and depth == pending[2] and seen[pending[1]].text == "var":
            if t.text in ("=", ";", ",") or (t.kind == "nl" and _following(seen, k) != "{"):
                pending = None
    last = len(lines)
    if lost:
        gaps.append((lost, last))
    if stack:
        gaps.append((stack[0][2], last))
    return [c for c in chunks if c["end_line"]], gaps, types


def _signature(text: str, start: int, end: int) -> str:
    """The declaration's head on one line, without comments."""
    out, i = [], start
    while i < end and (m := _PIECE.search(text, i, end)):
        out.append(text[i : m.start()])
        i = m.end()
        if m["block"]:
            i = _after_comment(text, m.start())
        elif m["string"]:
            i = _after_string(text, m.start())
            out.append(text[m.start() : i])
        elif not m["line"]:
            out.append(m[0])
    return " ".join(("".join(out) + text[i:end]).split())


def chunk_swift(text: str) -> tuple[list[dict], str]:
    """Chunks in order, and ok, or partial if the file has gaps."""
    try:
        chunks, gaps, _ = scan(text)
    except RecursionError:
        return [], "failed"
    return chunks, "partial" if gaps else "ok"


def declared_symbols(text: str) -> list[str]:
    """Qualified names of chunks, and names of types, whole and by their parts."""
    chunks, _, types = scan(text)
    return sorted({c["qualified_name"] for c in chunks} | {c["symbol"] for c in chunks} | {p for n in types for p in (n, *n.split(".")) if p})
