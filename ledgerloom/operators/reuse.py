"""Reuse inventory: owners of jobs, and what duplicates or bypasses them.

Definitions come from Python sources in Arrow batches; copies are an equi-join on a hash of the normalised tree, so no
pair of definitions is compared.
"""

from __future__ import annotations

import ast
import copy
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import governance, patterns
from .lint import _found

DEFINITION = "path string, symbol string, line int, unit_line int, fingerprint string, calls array<string>, strings array<string>, text string"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def fingerprint(node: ast.AST) -> str:
    """SHA-256 of a definition with its own names, arguments, locals and docstring made alike."""
    node = copy.deepcopy(node)
    parts = list(ast.walk(node))
    bound = {node.name} | {a.arg for a in parts if isinstance(a, ast.arg)} | {n.id for n in parts if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}
    bound |= {n.name for n in parts if isinstance(n, ast.ExceptHandler) and n.name}
    bound -= {x for n in parts if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
    order: dict[str, str] = {}

    def alike(name: str) -> str:
        return order.setdefault(name, f"v{len(order)}") if name in bound else name

    if node.body and isinstance(node.body[0], ast.Expr) and isinstance(getattr(node.body[0], "value", None), ast.Constant) and isinstance(node.body[0].value.value, str):
        node.body = node.body[1:] or [ast.Pass()]
    for n in ast.walk(node):
        if isinstance(n, ast.arg):
            n.arg, n.annotation = alike(n.arg), None
        elif isinstance(n, ast.Name):
            n.id = alike(n.id)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            n.name = alike(n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            n.name, n.returns = alike(n.name), None
    return hashlib.sha256(ast.dump(node).encode()).hexdigest()


def _calls(node: ast.AST) -> list[str]:
    names = [n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None for n in ast.walk(node) if isinstance(n, ast.Call)]
    return sorted({n for n in names if n})


def _vocabulary(node: ast.AST) -> list[str]:
    sets = [[e.value for e in n.elts] for n in ast.walk(node) if isinstance(n, (ast.Set, ast.Tuple, ast.List)) and n.elts and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in n.elts)]
    return sorted(set(max(sets, key=len))) if sets else []


def _executable(node: ast.AST) -> str:
    """A definition's code without comments and docstrings."""
    node = copy.deepcopy(node)
    for n in ast.walk(node):
        if isinstance(n, (*_FUNCTION, ast.ClassDef)) and ast.get_docstring(n, clean=False) is not None:
            n.body = n.body[1:] or [ast.Pass()]
    return ast.unparse(node)


def _functions(tree: ast.AST) -> Iterator[tuple]:
    """Each function with the outermost one that holds it."""
    todo = [(tree, None)]
    while todo:
        node, top = todo.pop()
        if isinstance(node, _FUNCTION):
            top = top or node
            yield node, top
        todo += [(child, top) for child in reversed(list(ast.iter_child_nodes(node)))]


def _definitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in pdf.itertuples(index=False):
            try:
                tree = ast.parse(bytes(content).decode("utf-8", "replace"))
            except (SyntaxError, ValueError, RecursionError):
                continue
            rows += [(path, n.name, n.lineno, top.lineno, fingerprint(n), _calls(n), _vocabulary(n), _executable(n)) for n, top in _functions(tree)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEFINITION.split(", ")])


def definitions(files: DataFrame) -> DataFrame:
    """Functions of Python files (path, content)."""
    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(_definitions, DEFINITION)


def exact_copies(defs: DataFrame, owners: DataFrame) -> DataFrame:
    """Definitions that are an owner's (id, path, symbol, variants) under other names. Owners are met by fingerprint."""
    own = owners.join(defs, ["path", "symbol"]).select("id", F.col("path").alias("_path"), F.col("symbol").alias("_symbol"), "fingerprint", "variants")
    met = defs.join(own, "fingerprint").where(~((F.col("path") == F.col("_path")) & (F.col("symbol") == F.col("_symbol"))))
    met = met.where(~F.array_contains(F.coalesce("variants", F.array().cast("array<string>")), F.col("symbol")))
    return _found(met, "exact-copy", "error", F.concat(F.lit("copies "), F.col("_symbol"), F.lit(" of "), F.col("id")), "symbol")


def undelegated(defs: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers (path, symbol, owner) that never call their owner."""
    met = consumers.join(defs, ["path", "symbol"], "left")
    return _found(met.where(~F.coalesce(F.array_contains("calls", F.col("owner")), F.lit(False))), "delegation", "error", F.concat(F.lit("does not call "), F.col("owner")), "symbol")


def construct_owners(defs: DataFrame, owners: DataFrame) -> DataFrame:
    """A construct has one owner. owners: id, path, symbol, pattern, paths (where it is looked for; none: everywhere).

    Outermost functions whose code holds an owner's pattern and that are not its own are found, and owners that no longer
    hold it. Functions meet an owner by a literal that its pattern requires.
    """
    at = defs.select(F.col("path").alias("_path"), F.col("symbol").alias("_symbol"), F.col("unit_line").alias("_line")).distinct()
    own = owners.select("id", F.col("path").alias("_path"), F.col("symbol").alias("_symbol"), "pattern", "paths").join(at, ["_path", "_symbol"], "left")
    units = defs.where("line = unit_line")
    folder = lambda p: F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"))
    under = (F.coalesce(F.size("paths"), F.lit(0)) <= 0) | F.exists("paths", lambda p: (F.col("path") == p) | F.startswith(F.col("path"), folder(p)))
    met = patterns.matched(units, "text", own, "pattern").where(under)
    met = met.select("id", "path", "symbol", F.coalesce((F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")), F.lit(False)).alias("mine"))
    stale = owners.join(met.where("mine").select("id").distinct(), "id", "left_anti")
    out = _found(met.where("not mine"), "construct", "error", F.concat(F.lit("holds the construct of "), F.col("id")), "symbol")
    return out.unionByName(_found(stale, "construct-stale", "error", F.concat(F.lit("no longer holds the construct of "), F.col("id")), "symbol"))


def bypasses(defs: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers (path, symbol, owner, forbid) whose code holds one of the patterns that go past their owner."""
    met = consumers.join(defs.select("path", "symbol", "text"), ["path", "symbol"]).where(F.exists("forbid", lambda p: F.rlike(F.col("text"), p)))
    return _found(met, "bypass", "error", F.concat(F.lit("goes past "), F.col("owner")), "symbol")


def vocabulary_copies(defs: DataFrame, owners: DataFrame) -> DataFrame:
    """Definitions that spell out an owner's (id, path, vocabulary) set of words."""
    own = owners.select("id", F.col("path").alias("_path"), F.array_sort(F.array_distinct("vocabulary")).alias("strings"))
    met = defs.where(F.size("strings") > 1).join(own, "strings").where(F.col("path") != F.col("_path"))
    return _found(met, "vocabulary", "warning", F.concat(F.lit("spells out the words of "), F.col("id")), "symbol")


def jobs_for(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Inventory rows (id, ord, related_paths) that concern the given paths, in their order."""
    refs = rows.select("id", "ord", F.explode("related_paths").alias("ref"))
    return governance.govern(paths.select("path").distinct(), refs).select("id", "ord").distinct().orderBy("ord")
