"""Other inputs: decision registries, inventories, benchmark queries and corpora, transcripts, session files, git snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import git

INVENTORY = "schema_version int, scan_roots array<string>, exclusions array<string>, rows array<struct<id:string,job:string,policy:string,implementation:string,contract:string,why_single:string,related_paths:array<string>,variants:array<struct<symbol:string,contract:string,reason:string>>,guards:array<struct<method:string,params:map<string,string>>>,evidence:string,test:string>>"
QUERIES = "id string, kind string, query string, expect array<string>, notes string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """key, decision, date and note (a map of its decoded k=v parts) of a tab-separated registry."""
    raw = spark.read.csv(path, sep="\t", schema="key string, decision string, date string, note string", quote="")
    parts = F.str_to_map("note", F.lit(" "), F.lit("="))
    return raw.withColumn("note", F.transform_values(parts, lambda _, v: X.note_decoded(v)))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(INVENTORY).json(path, multiLine=True)
    return out.select(F.posexplode("rows").alias("ord", "r")).select("ord", "r.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark queries; bad rows raise."""
    out = spark.read.schema(QUERIES).json(path)
    good = F.col("id").isNotNull() & F.col("query").isNotNull() & F.col("kind").isin("path", "question") & (F.size("expect") > 0)
    return out.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("bad benchmark row "), F.coalesce("id", F.lit("?"))))))


def read_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, text) of whole files; the id from an `id:` line, else the file's stem."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("f"))
    return raw.select(F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^id:\s*(\S+)\s*$", 1), F.lit("")), F.regexp_replace("f", r"\.[^.]*$", "")).alias("id"), "text")


def read_transcripts(spark: SparkSession, pattern: str) -> DataFrame:
    """What users typed, from transcripts of JSON lines."""
    raw = spark.read.schema("type string, isMeta boolean, message struct<content:string>, timestamp string").json(pattern)
    return raw.where("type = 'user' and not coalesce(isMeta, false) and message.content is not null").select(F.col("message.content").alias("text"), "timestamp")


def read_sessions(spark: SparkSession, pattern: str, schema: str = "session_id string, rows array<struct<path:string,kind:string,content_sha256:string,seen_at:double,root:string,source:string>>") -> DataFrame:
    return spark.read.schema(schema).json(pattern, multiLine=True)


def read_git(spark: SparkSession, root: str, ref: str = "HEAD", staged: bool = False) -> DataFrame:
    """(side, path, content) of Markdown files that differ between a revision and the work tree or index: old and new side."""
    return git.read_sides(spark, root, ref, staged).select("side", "path", "content")


def tree_status(spark: SparkSession, root: str) -> DataFrame:
    """(code, path, old_path) of a work tree's changes; renames carry both paths."""
    parts, rows = iter(git.run(root, "status", "--porcelain", "-z", "-uall").decode("utf-8", "replace").split("\0")), []
    for p in parts:
        if p:
            rows.append((p[:2], p[3:], next(parts) if p[0] in "RC" else None))
    return spark.createDataFrame(rows, "code string, path string, old_path string")
