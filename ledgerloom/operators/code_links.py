"""What ties code to records: marks above declarations, tests of a symbol, wrapped chunks, prose of a record, context packs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SKIPPED_SYMBOLS = ["main", "init", "__init__", "test", "setUp"]
MOST_ROWS, MOST_PATHS = 50, 3


def nearest_marks(declarations: DataFrame, marks: DataFrame, above: int = 3) -> DataFrame:
    """declarations (path, line, symbol) with the marks (path, line, topic, link) in the `above` lines over them, none of which lies
    at or before the declaration that comes before. A range join turned into an equi-join on the line."""
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line"))
    d = declarations.withColumn("_before", F.coalesce(before, F.lit(-1)))
    d = d.withColumn("_at", F.explode(F.sequence(F.col("line") - above, F.col("line") - 1)))
    m = marks.select(F.col("path"), F.col("line").alias("_at"), "topic", "link")
    return d.where(F.col("_at") > F.col("_before")).join(m, ["path", "_at"]).select("path", "line", "symbol", "topic", "link")


def tested_by(hits: DataFrame, tests: DataFrame, skipped: list[str] = SKIPPED_SYMBOLS) -> DataFrame:
    """hits (symbol) with tested_by: at most 3 paths of test chunks (path, text) that name the symbol, of the first 50 such chunks. Symbols
    of under four characters and `skipped` ones get none.

    Test chunks are exploded into their words once and met by equality; each chunk counts once a symbol. Paths may be of any type that has an order.
    """
    names = hits.select("symbol").where((F.length("symbol") >= 4) & ~F.col("symbol").isin(skipped)).distinct()
    words = tests.select("path", F.monotonically_increasing_id().alias("_c"), F.explode(F.array_distinct(X.runs(F.col("text"), "[^A-Za-z0-9_]+"))).alias("symbol"))
    met = words.join(names, "symbol")
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("path", "_c"))).where(F.col("_n") <= MOST_ROWS)
    paths = first.groupBy("symbol").agg(F.slice(F.array_sort(F.collect_set("path")), 1, MOST_PATHS).alias("tested_by"))
    return hits.join(paths, "symbol", "left").withColumn("tested_by", F.coalesce("tested_by", F.array().cast(T.ArrayType(tests.schema["path"].dataType))))


def without_wrappers(chunks: DataFrame) -> DataFrame:
    """chunks (path, kind, qualified_name, start_line, end_line, wrapper) without declared wrappers around one of the same name and kind."""
    inner = chunks.select(F.col("path").alias("_p"), F.col("kind").alias("_k"), F.col("qualified_name").alias("_q"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    same = (F.col("path") == F.col("_p")) & (F.col("kind") == F.col("_k")) & (F.col("qualified_name") == F.col("_q"))
    inside = (F.col("start_line") <= F.col("_s")) & (F.col("_e") <= F.col("end_line")) & ((F.col("start_line") < F.col("_s")) | (F.col("_e") < F.col("end_line")))
    return chunks.join(inner, same & inside & F.col("wrapper"), "left_anti")


def blanked(text: str) -> str:
    """text with fenced blocks and code spans as spaces; lines and columns stay where they are."""
    out, fence = [], None
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            out.append(" " * len(line))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip(" `~"):
                fence = None
        elif m:
            fence = m[1]
            out.append(" " * len(line))
        else:
            out.append(re.sub(r"(`+)(?!`)(.*?)(?<!`)\1(?!`)", lambda s: " " * len(s[0]), line))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def prose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else blanked(t))


def link_spans(text: str) -> dict[str, str]:
    """The bytes of each link of a record's `links`, by its id: from its dash to the next at that depth."""
    lines = text.split("\n")
    out: dict[str, str] = {}
    try:
        at = next(i for i, x in enumerate(lines) if re.match(r"links:\s*(#.*)?$", x))
    except StopIteration:
        return out
    depth, start, name = None, None, None
    for i, line in enumerate([*lines[at + 1 :], "---"], at + 1):
        m = re.match(r"(\s*)-\s", line)
        if m and depth is None:
            depth = len(m[1])
        ends = line.strip() and not line.lstrip().startswith("#") and (len(line) - len(line.lstrip()) < (depth or 0) or (not m and len(line) - len(line.lstrip()) <= (depth or 0)) or line.startswith("---"))
        if start is not None and (ends or (m and len(m[1]) == depth)):
            out.setdefault(name or f"#{len(out)}", "\n".join(lines[start:i]))  # of links of one id, the first
            start = name = None
        if ends:
            break
        if m and len(m[1]) == depth:
            start = i
        if start is not None and name is None and (k := re.match(r"\s*(?:-\s+)?link:\s*[\"']?([^\s\"'#]+)", line)):
            name = k[1]
    return out


def spans(files: DataFrame) -> DataFrame:
    """(path, link, raw) of files (path, content): the bytes of each link; none of files that are not UTF-8."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, v) for k, v in link_spans(bytes(content).decode("utf-8")).items()]
                except UnicodeDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "link", "raw"])

    return files.select("path", "content").mapInPandas(cut, "path string, link string, raw string")


def context_pack(parts: DataFrame, pack: str, order: list[Column], text: Column, most_bytes: int) -> DataFrame:
    """(pack, text, parts, omitted): texts in order while the whole, with a line end each, stays within most_bytes, and the line that
    gives the hash and size of what stands above it. A part that does not fit ends the pack."""
    w = Window.partitionBy(pack).orderBy(*order)
    rows = parts.select(pack, text.alias("_t"), F.row_number().over(w).alias("_n"), F.sum(F.octet_length(text).cast("long") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"))
    kept = F.filter(F.array_sort(F.collect_list(F.when(F.col("_b") <= most_bytes, F.struct("_n", "_t")))), lambda s: s.isNotNull())
    out = rows.groupBy(pack).agg(F.concat(F.array_join(F.transform(kept, lambda s: s["_t"]), "\n"), F.lit("\n")).alias("body"), F.count_if(F.col("_b") <= most_bytes).alias("parts"), F.count_if(F.col("_b") > most_bytes).alias("omitted"))
    from ..functions.text import pack_hash_line

    return out.select(pack, F.concat("body", pack_hash_line(F.col("body"))).alias("text"), "parts", "omitted")
