"""Changes to record files as pure functions from text to text: lines are inserted or replaced, never the whole re-written.

What a change leaves alone keeps its bytes. Each result is parsed again and compared before it is returned.
"""

from __future__ import annotations

import os
import re
import tempfile

from ..functions import fixed
from ..sources.records import parse


class Refused(ValueError):
    """The change would break a rule; nothing was written."""


def quoted(value: str) -> str:
    """A YAML scalar in double quotes, on one line."""
    out = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f'"{out}"'


def _front(text: str) -> tuple[list[str], int, int]:
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].rstrip() != "---":
        raise Refused("no front matter")
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            return lines, 1, i
    raise Refused("front matter has no end")


def _block(lines: list[str], start: int, end: int, key: str) -> tuple[int, int] | None:
    """Lines of a top-level key: its own and those that belong to it."""
    for i in range(start, end):
        if re.match(rf"{re.escape(key)}:", lines[i]):
            j = i + 1
            while j < end and (lines[j].startswith((" ", "\t", "-", "#")) or not lines[j].strip()):
                j += 1
            return i, j
    return None


def _checked(old: str, new: str) -> str:
    found = parse(new.encode())
    if not found["valid"]:
        raise Refused("; ".join(found["diagnostics"]))
    if parse(old.encode())["body"] != found["body"]:
        raise Refused("the body would change")
    return new


def link_ids(text: str) -> list[str]:
    return [x["link"] for x in parse(text.encode())["links"] if x["link"]]


def append_link(text: str, ruling: str, authority: str, source: str, date: str, *, status: str = "active", kind: str = "adopted", reverses: str | None = None, reason: str | None = None) -> str:
    """A new link above all others, with the next number; `current` follows it if it is active."""
    if authority not in fixed.AUTHORITIES or status not in fixed.STATUSES or kind not in fixed.KINDS:
        raise Refused("unknown authority, status or kind")
    if authority == "owner-verbatim" and ruling.rstrip(" \t\"')]}").endswith("?"):
        raise Refused("a question is no ruling")
    if reverses and (reverses not in link_ids(text) or not reason):
        raise Refused("reverses needs a link of this topic and a reason")
    number = 1 + max([int(m[1]) for x in link_ids(text) if (m := re.match(r"L(\d+)", x))], default=0)
    rows = [f"- link: L{number}\n", f"  date: {date}\n", f"  status: {status}\n", f"  kind: {kind}\n"]
    if reverses:
        rows += [f"  reverses: {reverses}\n", f"  reason_for_change: {reason}\n"]
    rows += ["  ruling:\n", f"    text: {quoted(ruling)}\n", f"    authority: {authority}\n", f"    source: {quoted(source)}\n"]
    lines, start, end = _front(text)
    at = _block(lines, start, end, "links")
    if at is None:
        lines[end:end] = ["links:\n", *rows]
    elif re.match(r"links:\s*(\[\s*\])?\s*(#.*)?$", lines[at[0]].rstrip("\n")):
        indent = re.match(r"[ \t]*", lines[at[0] + 1])[0] if at[0] + 1 < at[1] and lines[at[0] + 1].lstrip().startswith("-") else ""
        lines[at[0] : at[0] + 1] = ["links:\n", *[indent + r for r in rows]]
    else:
        raise Refused("links is written on one line")
    if status == "active":
        lines, start, end = _front("".join(lines))
        now = _block(lines, start, end, "current")
        if now:
            lines[now[0]] = f"current: L{number}\n"
    return _checked(text, "".join(lines))


def bind(text: str, ref: str) -> str:
    """ref as the last of code_refs; the text as it is if it is there."""
    if not ref.split("#")[0]:
        raise Refused("a reference must name a path")
    if ref in parse(text.encode())["code_refs"]:
        return text
    lines, start, end = _front(text)
    at = _block(lines, start, end, "code_refs")
    if at is None:
        lines[end:end] = ["code_refs:\n", f"- {quoted(ref)}\n"]
    elif (m := re.match(r"code_refs:\s*\[(.*)\]\s*$", lines[at[0]])) is not None:
        lines[at[0]] = f"code_refs: [{m[1] + ', ' if m[1].strip() else ''}{quoted(ref)}]\n"
    else:
        last = max([i for i in range(at[0], at[1]) if lines[i].lstrip().startswith("-")], default=at[0])
        indent = re.match(r"[ \t]*", lines[last])[0] if last > at[0] else ""
        lines.insert(last + 1, f"{indent}- {quoted(ref)}\n")
    return _checked(text, "".join(lines))


def unbind(text: str, ref: str) -> str:
    """code_refs without ref."""
    refs = parse(text.encode())["code_refs"]
    if ref not in refs:
        raise Refused("not bound")
    lines, start, end = _front(text)
    at = _block(lines, start, end, "code_refs")
    if lines[at[0]].strip() == "code_refs:":
        own = [i for i in range(at[0] + 1, at[1]) if lines[i].lstrip().startswith("-")]
        del lines[own[refs.index(ref)]]
        if len(refs) == 1:
            lines[at[0]] = "code_refs: []\n"
    else:
        lines[at[0] : at[1]] = [f"code_refs: [{', '.join(quoted(r) for r in refs if r != ref)}]\n"]
    return _checked(text, "".join(lines))


def mark_standing(text: str, link: str, add: bool, *, why: str, recorded_at: str, recorded_by: str, authority: str, source: str) -> str:
    """Put a link on the topic's standing list or take it off, with an audit row above the earlier ones; the text as it is if
    nothing changes. Only active, single-line owner rulings may stand."""
    if authority not in fixed.OWNER_AUTHORITIES or "\n" in why + source:
        raise Refused("needs an owner's word, reason and source on one line each")
    parsed = parse(text.encode())
    if (link in parsed["standing"]) == add:
        return text
    if add:
        found = next((x for x in parsed["links"] if x["link"] == link), None)
        words = (found or {}).get("ruling_text") or ""
        if not found or found["status"] != "active" or found["authority"] not in fixed.OWNER_AUTHORITIES or not words or len(words.splitlines()) > 1:
            raise Refused("not an active, single-line owner ruling")
    rest = [x for x in parsed["standing"] if x != link] + [link] * add
    lines, start, end = _front(text)
    at = _block(lines, start, end, "standing")
    if at is None:
        below = [b[0] for k in ("standing_marks", "anchors", "links") if (b := _block(lines, start, end, k))]
        lines.insert(min(below, default=end), f"standing: [{quoted(link)}]\n")
    elif (m := re.match(r"standing:\s*\[(.*)\]\s*$", lines[at[0]])) is not None and add:
        lines[at[0]] = f"standing: [{m[1] + ', ' if m[1].strip() else ''}{quoted(link)}]\n"
    elif m or not rest:
        lines[at[0] : at[1]] = [f"standing: [{', '.join(quoted(x) for x in rest)}]\n"]
    else:
        items = [i for i in range(at[0] + 1, at[1]) if lines[i].lstrip().startswith("-")]
        if not items:
            raise Refused("standing is neither a list on one line nor one of rows")
        if add:
            indent = re.match(r"[ \t]*", lines[items[-1]])[0]
            lines.insert(items[-1] + 1, f"{indent}- {quoted(link)}\n")
        else:
            del lines[items[parsed["standing"].index(link)]]
    row = {"link": link, "action": "add" if add else "remove", "date": recorded_at[:10], "recorded_at": quoted(recorded_at), "recorded_by": quoted(recorded_by), "authority": authority, "source": quoted(source), "why": quoted(why)}
    rows = [f"  {'- ' if k == 'link' else '  '}{k}: {v}\n" for k, v in row.items()]
    lines, start, end = _front("".join(lines))
    marks, list_ = _block(lines, start, end, "standing_marks"), _block(lines, start, end, "standing")
    if marks is None:
        lines[list_[1] : list_[1]] = ["standing_marks:\n", *rows]
    else:
        lines[marks[0] : marks[0] + 1] = ["standing_marks:\n", *rows]
    out = "".join(lines)
    if parse(out.encode())["standing"] != rest:
        raise Refused("the list would not read as meant")
    return _checked(text, out)


def promote(text: str, link: str, source: str, date: str) -> str:
    """A new owner-ratified link with the words of an open link of lower authority, which then names it."""
    old = next((x for x in parse(text.encode())["links"] if x["link"] == link), None)
    if not old or old["authority"] not in fixed.AUTHORITIES[2:] or old["status"] not in ("active", "provisional") or old["promoted_by"]:
        raise Refused("the link cannot be promoted")
    out = append_link(text, old["ruling_text"] or "", "owner-ratified", source, date)
    new = link_ids(out)[0]
    lines = out.splitlines(keepends=True)
    at = next(i for i, x in enumerate(lines) if re.match(rf"\s*-\s+link:\s*[\"']?{re.escape(link)}[\"']?\s*$", x))
    indent = " " * (len(lines[at]) - len(lines[at].lstrip()) + 2)
    lines.insert(at + 1, f"{indent}promoted_by: {new}\n")
    return _checked(text, "".join(lines))


def write(path: str, old: str, new: str) -> None:
    """Swap the file in as a whole if it still holds `old`."""
    with open(path, encoding="utf-8", newline="") as f:
        if f.read() != old:
            raise Refused("the file changed meanwhile")
    handle, at = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(new)
    os.replace(at, path)
