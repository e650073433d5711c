"""Markdown records: walking a store, parsing front matter and body, and the tables that come of them.

The driver lists paths (links are not followed, hidden and vendored folders are pruned); contents are read by Spark's binary
reader, and parsed in Arrow batches. A record that cannot be parsed is a row with diagnostics, never an exception.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.order import spread

#: Files that a task parses.
PARSE_ROWS = 500
LINK = "struct<link:string,seq:int,date:string,status:string,kind:string,reverses:string,reason_for_change:string,superseded_by:string,promoted_by:string,ruling_text:string,authority:string,source:string,rationale_text:string,rationale_authority:string,alternatives:array<struct<option:string,rejected_because:string,authority:string>>,evidence:array<string>,revisit_if:array<string>,edges:array<struct<rel:string,to_ref:string>>,assumptions:array<struct<aid:string,text:string,status:string,since:string>>,invariant_kind:string,invariant_pattern:string,invariant_scope:string,invariant_allowed:array<string>,recorded_by:string,recorded_at:string>"
RECORD = f"path string, sha256 string, size long, valid boolean, fallback boolean, diagnostics array<string>, type string, id string, title string, area string, status string, authority string, current string, tags array<string>, code_refs array<string>, standing array<string>, implemented_by array<string>, tested_by array<string>, governed_by array<string>, links array<{LINK}>, body string"
_SCALARS = ["type", "id", "title", "area", "project", "topic", "current", "status", "authority", "date", "source", "name", "description"]
_LISTS = ["tags", "code_refs", "standing", "implemented_by", "tested_by", "governed_by"]


def walk(root: str) -> tuple[list[str], int]:
    """Markdown paths under root, relative, in order; and the number of symbolic links passed over."""
    found, links = [], 0
    for at, dirs, names in os.walk(root):
        links += sum(os.path.islink(os.path.join(at, d)) for d in dirs)
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d != "node_modules" and not os.path.islink(os.path.join(at, d)))
        for n in sorted(names):
            if n.startswith(".") or not n.endswith(".md"):
                continue
            if os.path.islink(os.path.join(at, n)):
                links += 1
            else:
                found.append(os.path.relpath(os.path.join(at, n), root))
    return found, links


def _text(x) -> str | None:
    if x is None:
        return None
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


def _list(x) -> list[str]:
    return [_text(e) for e in x if e is not None] if isinstance(x, list) else []


def _map(x) -> dict:
    return x if isinstance(x, dict) else {}


def _link(raw: dict, seq: int) -> dict:
    ruling, why, inv = _map(raw.get("ruling")), _map(raw.get("rationale")), _map(raw.get("invariant"))
    maps = lambda name: [m for m in raw.get(name) or [] if isinstance(m, dict)] if isinstance(raw.get(name), list) else []
    return {
        **{k: _text(raw.get(k)) for k in ("link", "date", "status", "kind", "reverses", "reason_for_change", "superseded_by", "promoted_by", "recorded_by", "recorded_at")},
        "seq": seq, "ruling_text": _text(ruling.get("text")), "authority": _text(ruling.get("authority")), "source": _text(ruling.get("source")),
        "rationale_text": _text(why.get("text")), "rationale_authority": _text(why.get("authority")),
        "alternatives": [{k: _text(a.get(k)) for k in ("option", "rejected_because", "authority")} for a in maps("alternatives")],
        "evidence": _list(raw.get("evidence")), "revisit_if": _list(raw.get("revisit_if")),
        "edges": [{"rel": _text(e.get("rel")), "to_ref": _text(e.get("to"))} for e in maps("edges")],
        "assumptions": [{"aid": _text(a.get("id")), **{k: _text(a.get(k)) for k in ("text", "status", "since")}} for a in maps("assumptions")],
        "invariant_kind": _text(inv.get("kind")), "invariant_pattern": _text(inv.get("pattern")), "invariant_scope": _text(inv.get("scope")), "invariant_allowed": _list(inv.get("allowed")),
    }


def parse(raw: bytes) -> dict:
    """Front matter and body of one record. Never raises: what is wrong is in diagnostics."""
    import yaml

    out: dict = {"valid": True, "fallback": False, "diagnostics": [], "links": [], "body": ""} | {k: None for k in _SCALARS} | {k: [] for k in _LISTS}
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return out | {"valid": False, "diagnostics": [f"not UTF-8 at byte {e.start}"]}
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", text, re.DOTALL)
    if not m:
        if re.match(r"---[ \t]*\r?\n", text):
            return out | {"valid": False, "body": text, "diagnostics": ["front matter has no end"]}
        return out | {"body": text}
    out["body"] = text[m.end() :]
    try:
        fm = yaml.safe_load(m[1]) or {}
    except yaml.YAMLError as e:
        found = {k: v for k, v in re.findall(r"^([a-z_]+):[ \t]+([^\s\[{|>&*!].*?)[ \t]*$", m[1], re.MULTILINE) if k in _SCALARS}
        return out | {k: v.strip("\"'") for k, v in found.items()} | {"valid": False, "fallback": True, "diagnostics": [f"YAML: {str(e).splitlines()[0]}"]}
    if not isinstance(fm, dict):
        return out | {"valid": False, "diagnostics": ["front matter is no mapping"]}
    for k in _SCALARS:
        if isinstance(fm.get(k), (dict, list)):
            out["diagnostics"].append(f"{k}: expected one value")
        else:
            out[k] = _text(fm.get(k))
    out["type"] = out["type"] or _text(_map(fm.get("metadata")).get("type"))
    for k in _LISTS:
        if fm.get(k) is not None and not isinstance(fm[k], list):
            out["diagnostics"].append(f"{k}: expected a list")
        out[k] = _list(fm.get(k))
    links = fm.get("links")
    if links is not None and not (isinstance(links, list) and all(isinstance(x, dict) for x in links)):
        out["diagnostics"].append("links: expected a list of mappings")
        links = [x for x in links if isinstance(x, dict)] if isinstance(links, list) else []  # history that a repair is held against
    out["links"] = [_link(x, i) for i, x in enumerate(links or [])]
    names = [x["link"] for x in out["links"] if x["link"]]
    out["diagnostics"] += [f"links: duplicate link id {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    canonical = "links" in fm or re.match(r"(TOP|INC|INV|CON)-", out["id"] or "") or out["type"] in ("topic", "incident", "investigation", "concept")
    out["valid"] = not (canonical and out["diagnostics"])
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            raw = bytes(content)
            rows.append({"path": path, "sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw)} | parse(raw))
        names = [c.split()[0] for c in ("path sha256 size valid fallback diagnostics type id title area status authority current tags code_refs standing implemented_by tested_by governed_by links body").split()]
        yield pd.DataFrame(rows, columns=names)


def type_of(path: Column, given: Column) -> Column:
    """Inbox by folder, then the given type, then the folder's name in the singular."""
    folder = F.element_at(F.split(F.concat(F.lit("./"), path), "/"), -2)
    by_folder = F.create_map(*[F.lit(x) for kv in {"topics": "topic", "incidents": "incident", "investigations": "investigation", "concepts": "concept"}.items() for x in kv])
    return F.when(F.concat(F.lit("/"), path).contains("/inbox/"), "inbox").otherwise(F.coalesce(given, F.try_element_at(by_folder, folder)))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Records of a store, parsed; path relative to root."""
    paths, _ = walk(root)
    if not paths:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").load([os.path.join(os.path.abspath(root), p) for p in paths])
    base = "file:" + os.path.abspath(root).rstrip("/") + "/"
    return parse_records(files.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "content"))


def parse_records(files: DataFrame) -> DataFrame:
    """files (path, content) as records. Files are dealt over as many tasks as their number asks for: parsing takes milliseconds a file, and many
    can come from one small partition."""
    files = spread(files.select("path", F.col("content").cast("binary").alias("content")), ["path"], PARSE_ROWS)
    out = files.mapInPandas(_rows, RECORD)
    return out.withColumn("type", type_of(F.col("path"), F.col("type")))


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records; the others with their diagnostics."""
    return records.where("valid"), records.where("not valid").select("path", "sha256", "size", "diagnostics")


def parsed(records: DataFrame) -> Column:
    """Whether the front matter of a record, valid or not, was read as a mapping."""
    unread = F.exists(records["diagnostics"], lambda d: F.startswith(d, F.lit("not UTF-8")) | F.startswith(d, F.lit("front matter")))
    return ~records["fallback"] & ~F.coalesce(unread, F.lit(False))


def recorded_links(records: DataFrame) -> DataFrame:
    """Links of all records that could be parsed, valid or not."""
    return records.where(parsed(records)).select("path", F.col("path").alias("topic_path"), F.inline("links"))


def links(records: DataFrame) -> DataFrame:
    return records.where("valid").select(F.col("path"), F.col("path").alias("topic_path"), F.col("id").alias("topic_id"), "title", F.inline("links"))


def link_records(records: DataFrame) -> DataFrame:
    """Rulings and reasons as searchable rows of their own, of the family of their topic."""
    l = links(records).where("ruling_text is not null or rationale_text is not null")
    key = X.link_key(F.concat_ws("\n", "topic_path", "link"))
    return l.select(key.alias("path"), F.lit("link").alias("type"), "title", F.concat_ws("\n", "ruling_text", "rationale_text").alias("body"), "status", "authority", F.col("topic_path").alias("family"), F.col("link").alias("link_id"))


def edges(records: DataFrame) -> DataFrame:
    return links(records).select("topic_path", "link", F.concat_ws("/", "topic_id", "link").alias("from_ref"), F.inline("edges"))


def assumptions(records: DataFrame) -> DataFrame:
    return links(records).select("topic_path", "link", F.inline("assumptions"))


def concept_paths(records: DataFrame) -> DataFrame:
    kinds = [records.where("type = 'concept'").select(F.col("id").alias("concept_id"), F.lit(k).alias("kind"), F.explode(k).alias("ref")) for k in ("implemented_by", "tested_by", "governed_by")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def write_index(records: DataFrame, path: str, project: str) -> None:
    """Valid records by project, bad ones to a table beside them; each written as a whole and swapped in."""
    good, bad = quarantine(records)
    for name, df in (("records", good), ("index_errors", bad)):
        df.withColumn("project", F.lit(project)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, name: str = "records") -> DataFrame:
    """Raises where there is no index; readers never create one."""
    return spark.read.parquet(f"{path}/{name}")
