"""An index of records that is published as a whole: versions are staged beside each other and named by manifests.

    <path>/versions/<id>/records, index_errors     tables of a version, written before anything names them (from `staged` beside them, deleted then)
    <path>/manifests/00000001.json                 names a version, with the rows, files and bytes of its tables

A manifest is made with a file that must not exist yet, so of two writers one wins. Readers take the newest manifest that is whole; a write that
was killed leaves a version that nothing names, or a manifest that breaks off, and the old index is read on. Tables that differ from what their
manifest says are an integrity failure, not an empty index.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system
from . import records as R

#: Texts that an embedding model gets at a time.
EMBED_BATCH = 128


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Damaged(RuntimeError):
    """Tables are not what their manifest says."""


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_system(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted((int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit()), reverse=True)


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"body": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True)


def _read_manifest(spark: SparkSession, path: str, n: int) -> dict | None:
    """None for one that breaks off or does not agree with its own digest."""
    rows = spark.read.text(f"{path}/manifests/{n:08d}.json", wholetext=True).collect()
    try:
        found = json.loads(rows[0][0]) if rows else {}
        return found["body"] if _sealed(found["body"]) == json.dumps(found, sort_keys=True) else None
    except (ValueError, KeyError, TypeError):
        return None


def current(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """Number and manifest of the version that readers see; None where nothing has been published."""
    for n in _manifests(spark, path):
        if body := _read_manifest(spark, path, n):
            return n, body
    return None


def _size(spark: SparkSession, table: str) -> tuple[int, int]:
    fs, at = file_system(spark, table)
    if not fs.exists(at):
        return 0, 0
    of = fs.getContentSummary(at)
    return of.getFileCount(), of.getLength()


def publish(records: DataFrame, path: str, base: int | None = None) -> int:
    """Stage valid and bad records as a version, check it, and name it. Gives its number: one more than `base`, the number that the work began
    from (by default the newest there is). Conflict if that has been taken meanwhile; Damaged if what was written cannot be read back."""
    spark = records.sparkSession
    base = (_manifests(spark, path) or [0])[0] if base is None else base
    at = f"{path}/versions/{uuid.uuid4().hex}"
    records.write.parquet(f"{at}/staged")  # computed once: both tables are read from it
    good, bad = R.quarantine(spark.read.schema(records.schema).parquet(f"{at}/staged"))
    tables = {}
    for name, df in (("records", good), ("index_errors", bad)):
        df.write.parquet(f"{at}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{at}/{name}")
        rows, paths = back.agg(F.count("*"), F.count_distinct("path")).first()
        if rows != paths:
            raise Damaged(f"{name}: {rows} rows for {paths} paths")
        files, size = _size(spark, f"{at}/{name}")
        tables[name] = {"rows": rows, "files": files, "bytes": size, "schema": df.schema.json()}
    fs, staged = file_system(spark, f"{at}/staged")
    fs.delete(staged, True)
    fs, target = file_system(spark, f"{path}/manifests/{base + 1:08d}.json")
    try:
        out = fs.create(target, False)
    except Exception as e:  # noqa: BLE001  Hadoop's file systems have different errors for it
        if fs.exists(target):
            raise Conflict(f"version {base + 1} has been published meanwhile") from e
        raise
    out.write(bytearray(_sealed({"at": at, "tables": tables}).encode()))
    out.close()
    return base + 1


def read(spark: SparkSession, path: str, name: str = "records") -> DataFrame:
    """A table of the current version. Raises where nothing has been published, and Damaged where files have gone or changed."""
    from pyspark.sql.types import StructType

    found = current(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    body, own = found[1], found[1]["tables"][name]
    if _size(spark, f"{body['at']}/{name}") != (own["files"], own["bytes"]):
        raise Damaged(f"{name} of version {found[0]} is not what its manifest says")
    return spark.read.schema(StructType.fromJson(json.loads(own["schema"]))).parquet(f"{body['at']}/{name}")


def reindex(files: DataFrame, path: str, full: bool = False) -> DataFrame:
    """Bring the index below path up to files (path, content) and publish it; what happened to each path: (path, outcome), kept, parsed, quarantined or
    dropped.

    Files whose SHA-256 is that of a valid record are kept as they are; only others are parsed, or all if `full`. The outcomes are of the
    version that was published: they are read from it.
    """
    spark = files.sparkSession
    found = current(spark, path)
    base = found[0] if found else 0
    hashed = files.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    empty = R.parse_records(files.where("false"))
    old = read(spark, path) if found else empty
    old = old.where("false") if full else old
    kept = old.join(hashed.select("path", "sha256"), ["path", "sha256"], "left_semi")
    new = R.parse_records(hashed.join(old.select("path", "sha256"), ["path", "sha256"], "left_anti"))
    publish(kept.select(*empty.columns).unionByName(new.select(*empty.columns)), path, base)
    good, bad = read(spark, path), read(spark, path, "index_errors")
    before = old.select("path", "sha256", F.lit(True).alias("_old"))
    now = good.select("path", "sha256").join(before, ["path", "sha256"], "left").select("path", F.when(F.col("_old"), "kept").otherwise("parsed").alias("outcome"))
    gone = (read_version(spark, found[1]) if found else empty.select("path")).join(files.select("path"), "path", "left_anti").select("path", F.lit("dropped").alias("outcome"))
    return now.unionByName(bad.select("path", F.lit("quarantined").alias("outcome"))).unionByName(gone)


def read_version(spark: SparkSession, body: dict) -> DataFrame:
    """(path) of all records, bad ones too, of the version that a manifest names."""
    return spark.read.parquet(f"{body['at']}/records").select("path").union(spark.read.schema("path string").parquet(f"{body['at']}/index_errors").select("path"))


def embedded(rows: DataFrame, fingerprint: str, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """(path, embed_sha, embed_fp, vector) of rows (path, sha256, text): embed() gets the texts of a task, at most `batch` at a time. For the rows of
    freshness.awaiting(); freshness.append_vectors() adds what comes of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                vectors = embed([t if isinstance(t, str) else "" for t in part["text"]])
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({"path": part["path"].to_numpy(), "embed_sha": part["sha256"].to_numpy(), "embed_fp": fingerprint, "vector": [list(map(float, v)) for v in vectors]})

    return rows.select("path", "sha256", "text").mapInPandas(run, "path string, embed_sha string, embed_fp string, vector array<double>")
