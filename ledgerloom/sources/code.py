"""Source trees: enumeration, language census, and functions and methods cut out of Python and Swift files."""

from __future__ import annotations

import ast
import copy
import hashlib
import inspect
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from . import swift

CHUNK = "path string, lang string, kind string, symbol string, qualified_name string, signature string, doc string, start_line int, end_line int, status string"
MOST_BYTES = 1 << 20
NOISE = ["node_modules", "__pycache__", "venv"]
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def tree_paths(root: str) -> list[str]:
    """Paths that git knows or does not ignore; without git, all outside noise and hidden folders."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True, timeout=60).stdout
        paths = sorted({p for p in out.decode("utf-8", "surrogateescape").split("\0") if p})
    except (OSError, subprocess.SubprocessError):
        paths = []
        for at, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not os.path.isfile(os.path.join(at, d, ".git")))
            paths += [os.path.relpath(os.path.join(at, n), root) for n in sorted(names)]
    return [p for p in paths if not set(p.split("/")[:-1]) & set(NOISE) and os.path.isfile(os.path.join(root, p))]


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, content, length of the files of a tree, without those that are noise to their own language."""
    paths = tree_paths(root)
    if not paths:
        return spark.createDataFrame([], "path string, content binary, length long")
    base = "file:" + os.path.abspath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").load([os.path.join(os.path.abspath(root), p) for p in paths])
    files = files.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "content", "length")
    return files.where(~F.coalesce(X.skipped_for(F.col("path"), X.language_of(F.col("path"))), F.lit(False)))


def census(files: DataFrame) -> DataFrame:
    """(lang, n): files of each known language, none as 0; scripts without an extension by their first line."""
    spark = files.sparkSession
    line = F.substring_index(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), "\n", 1)
    lang = F.coalesce(X.language_of(F.col("path")), F.when(X.extension_of(F.col("path")) == "", X.language_of_shebang(line)))
    known = spark.createDataFrame([(x,) for x in fixed.LANGUAGES], "lang string")
    n = files.select(lang.alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return known.join(n, "lang", "left").fillna(0, ["n"])


def unindexed(paths: DataFrame) -> DataFrame:
    """(ext, n) of files of no known language."""
    return paths.where(X.language_of(F.col("path")).isNull()).groupBy(X.extension_of(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


_SHOWN = (ast.Name, ast.Attribute, ast.Constant, ast.Subscript, ast.Tuple, ast.List, ast.Dict, ast.UnaryOp, ast.Starred, ast.Call)


class _Shown(ast.NodeTransformer):
    """Expressions of the kinds that signatures show; others become a mark."""

    def visit(self, node):
        if isinstance(node, ast.expr) and not isinstance(node, _SHOWN) and not (isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr)):
            return ast.Name("<...>", ast.Load())
        return self.generic_visit(node)


def _expression(node) -> str:
    return ast.unparse(_Shown().visit(copy.deepcopy(node)))


def _parameters(a: ast.arguments) -> str:
    """Parameters as written, with spaces around the default of an annotated one and none around that of a bare one."""

    def one(arg: ast.arg, default=None, mark: str = "") -> str:
        typed = f": {_expression(arg.annotation)}" if arg.annotation else ""
        return mark + arg.arg + typed + (f"{' = ' if typed else '='}{_expression(default)}" if default is not None else "")

    plain = [*a.posonlyargs, *a.args]
    out = [one(x, d) for x, d in zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True)]
    if a.posonlyargs:
        out.insert(len(a.posonlyargs), "/")
    if a.vararg or a.kwonlyargs:
        out.append(one(a.vararg, mark="*") if a.vararg else "*")
    out += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    return ", ".join([*out, *([one(a.kwarg, mark="**")] if a.kwarg else [])])


def _signature(node) -> str:
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}"
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    tail = f" -> {_expression(node.returns)}" if node.returns else ""
    return f"{head} {node.name}({_parameters(node.args)}){tail}"


def _kind(node, in_class: bool) -> str:
    if not in_class:
        return "function"
    marks = [d.id if isinstance(d, ast.Name) else d.attr if isinstance(d, ast.Attribute) else "" for d in node.decorator_list]
    bare = [isinstance(d, ast.Name) for d in node.decorator_list]
    if node.name == "__init__":
        return "constructor"
    return "accessor" if any((m == "property" and b) or (m == "setter" and not b) for m, b in zip(marks, bare, strict=True)) else "method"


def chunk_python(text: str) -> tuple[list[dict], str]:
    """Functions and methods of Python source, in order, and ok or failed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], "failed"
    out: list[dict] = []
    todo = [(child, (), False) for child in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, names, in_class = todo.pop()
        if isinstance(node, _DEF):
            doc = ast.get_docstring(node) or ""
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append({"kind": _kind(node, in_class), "symbol": node.name, "qualified_name": ".".join([*names, node.name]), "signature": _signature(node), "doc": doc.splitlines()[0] if doc else "", "start_line": first, "end_line": node.end_lineno})
        named = isinstance(node, (ast.ClassDef, *_DEF))
        inner = ((*names, node.name) if named else names, isinstance(node, ast.ClassDef) if named else in_class)
        todo += [(child, *inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out, "ok"


def declared_symbols(text: str, lang: str = "python") -> list[str]:
    """Qualified names of classes, functions and module-level assignments; of Swift, of types and their members."""
    if lang == "swift":
        return swift.declared_symbols(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = [t.id for n in tree.body if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)]
    todo = [(n, "") for n in tree.body]
    while todo:
        node, above = todo.pop()
        if isinstance(node, (ast.ClassDef, *_DEF)):
            out.append(above + node.name)
            above = above + node.name + "."
        todo += [(c, above) for c in ast.iter_child_nodes(node)]
    return sorted(set(out))


PARSERS = {"python": chunk_python, "swift": swift.chunk_swift}


def chunker_version(lang: str) -> str:
    """What the chunks of a language depend on, as the first 12 hex digits of a hash: its row of the table and the source of its parser."""
    parser = inspect.getsource(inspect.getmodule(PARSERS[lang])) if lang in PARSERS else ""
    return hashlib.sha256(repr((lang, fixed.LANGUAGES[lang], parser)).encode()).hexdigest()[:12]


def languages(spark: SparkSession) -> DataFrame:
    """(lang, extensions, noise, chunker_version, backend): a row a language; backend is ok or missing, with its fingerprint beside it."""
    rows = [(x, row[0], row[2], chunker_version(x), "ok" if x in PARSERS else "missing") for x, row in fixed.LANGUAGES.items()]
    out = spark.createDataFrame(rows, "lang string, extensions array<string>, noise array<string>, chunker_version string, backend string")
    key = hashlib.sha256(repr([(r[0], r[4]) for r in rows]).encode()).hexdigest()[:12]
    return out.withColumn("availability", F.lit(key))


def common_noise(rows: DataFrame) -> DataFrame:
    """One row: folders that are noise to every language of rows (lang, noise)."""
    n = rows.select("lang").distinct().count()
    each = rows.select("lang", F.explode("noise").alias("dir")).distinct().groupBy("dir").count().where(F.col("count") == n)
    return each.agg(F.array_sort(F.collect_list("dir")).alias("dirs"))


def pin_mismatch(pinned: Column, installed: Column) -> Column:
    """Versions compare as text; a missing one is no match."""
    return ~F.coalesce(pinned == installed, F.lit(False))


def most_bytes(lang: Column, override: Column | None = None) -> Column:
    """The size from which a file is not parsed: the row's own, else LEDGERLOOM_MOST_BYTES, else 1 MiB."""
    general = F.lit(int(os.environ.get("LEDGERLOOM_MOST_BYTES", MOST_BYTES))).cast("long")
    return F.when(lang.isNotNull(), F.coalesce(override, general) if override is not None else general)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CHUNK.split(", ")]
    for pdf in batches:
        rows = []
        for path, lang, content, length in pdf.itertuples(index=False):
            blank = {n: None for n in names} | {"path": path, "lang": lang}
            if lang not in PARSERS:
                rows.append(blank | {"status": "not-indexed: no parser"})
            elif length > MOST_BYTES:
                rows.append(blank | {"status": "not-indexed: too large"})
            else:
                found, status = PARSERS[lang](bytes(content).decode("utf-8", "replace"))
                rows += [{"path": path, "lang": lang, "status": status} | c for c in found] or [blank | {"status": status}]
        yield pd.DataFrame(rows, columns=names)


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content, length); a file without any is one row that says why."""
    return files.select("path", X.language_of(F.col("path")).alias("lang"), "content", F.col("length").cast("long")).where("lang is not null").mapInPandas(_chunks, CHUNK)


def dedup_spans(entries: DataFrame, path: str = "path") -> DataFrame:
    """One entry a span: constructors, then accessors, then methods and functions; then an explicit qualifier; then the first."""
    from pyspark.sql import Window

    rank = F.when(F.col("kind") == "constructor", 0).when(F.col("kind") == "accessor", 1).otherwise(2)
    w = Window.partitionBy(path, "start_line", "end_line").orderBy(rank, (~F.contains("qualified_name", F.lit("."))).cast("int"), "ord")
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_intervals(spans: DataFrame, path: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching [start, end) spans of a path as islands. A task sorts the spans of some paths, of as many as there are rows for."""
    from pyspark.sql import Window

    from ..operators.order import spread

    spans = spread(spans, [path])
    w = Window.partitionBy(path).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_far", far).withColumn("_new", F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far")), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(path, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")
