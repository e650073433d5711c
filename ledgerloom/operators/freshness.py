"""What of an index is still right: vectors, chunks, file status, and the work that brings it up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAL_LIMIT = 500


def fresh_vectors(rows: DataFrame, vectors: DataFrame, fingerprint: str, dim: int | None = None) -> DataFrame:
    """rows (path, sha256, …) with the vector (path, embed_sha, embed_fp, vector) that was made of their present content by the
    present model, of its dimension. A null fingerprint, another model's or an older text's vector never matches."""
    own = vectors.where(F.col("embed_fp") == fingerprint)
    if dim is not None:
        own = own.where(F.size("vector") == dim)
    return rows.join(own.select("path", F.col("embed_sha").alias("sha256"), "vector"), ["path", "sha256"])


def awaiting(rows: DataFrame, vectors: DataFrame, fingerprint: str, dim: int | None = None) -> DataFrame:
    """rows without a fresh vector: the work list of an embedder."""
    return rows.join(fresh_vectors(rows.select("path", "sha256"), vectors, fingerprint, dim).select("path", "sha256"), ["path", "sha256"], "left_anti")


def orphans(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors whose row is gone or has another content."""
    return vectors.join(rows.select("path", F.col("sha256").alias("embed_sha")), ["path", "embed_sha"], "left_anti")


def append_vectors(made: DataFrame, rows: DataFrame, path: str) -> None:
    """Append vectors (path, embed_sha, embed_fp, vector) to a table, only those whose row is still there with that content."""
    made.join(rows.select("path", F.col("sha256").alias("embed_sha")), ["path", "embed_sha"], "left_semi").write.mode("append").parquet(path)


def reindex_plan(stored: DataFrame, walked: DataFrame, versions: DataFrame, availability: str, full: bool = False, retry: bool = True) -> DataFrame:
    """(root, path, action): keep, parse or drop for each path of either side.

    stored: root, path, sha256, lang, chunker_version, status, attempt_key; walked: root, path, sha256, lang; versions: lang,
    chunker_version. Parsed are new files, files of another content or another version of their chunker, all if `full`, and
    not-indexed ones if `retry` or if they were tried with other backends.
    """
    o = stored.select("root", "path", F.col("sha256").alias("_o"), F.col("chunker_version").alias("_ov"), F.col("status").alias("_status"), F.col("attempt_key").alias("_key"), F.lit(True).alias("_in_o"))
    n = walked.join(F.broadcast(versions.select("lang", "chunker_version")), "lang", "left").select("root", "path", F.col("sha256").alias("_n"), F.col("chunker_version").alias("_nv"), F.lit(True).alias("_in_n"))
    again = (F.col("_status") == "not-indexed") & (F.lit(retry) | ~F.col("_key").eqNullSafe(F.lit(availability)) | ~F.col("_ov").eqNullSafe(F.col("_nv")))
    changed = (F.col("_status") != "not-indexed") & (~F.col("_o").eqNullSafe(F.col("_n")) | ~F.col("_ov").eqNullSafe(F.col("_nv")))
    action = F.when(F.col("_in_n").isNull(), "drop").when(F.col("_in_o").isNull() | F.lit(full) | F.coalesce(again | changed, F.lit(True)), "parse").otherwise("keep")
    return o.join(n, ["root", "path"], "full_outer").select("root", "path", action.alias("action"))


def reindexed(stored_chunks: DataFrame, plan: DataFrame, files: DataFrame, parse) -> DataFrame:
    """Chunks after a run: those of kept paths as they are, those of `parse` made anew by parse(files), which sees only such files."""
    kept = stored_chunks.join(plan.where("action = 'keep'").select("root", "path"), ["root", "path"], "left_semi")
    return kept.unionByName(parse(files.join(plan.where("action = 'parse'").select("root", "path"), ["root", "path"], "left_semi")), allowMissingColumns=True)


def without_root(index: DataFrame, root: str) -> DataFrame:
    """The index without one root, whether or not it is still on disk."""
    return index.where(~F.col("root").eqNullSafe(F.lit(root)))


def root_report(files: DataFrame, roots: DataFrame) -> DataFrame:
    """A row a recorded root with its counts and its state: stale, degraded, current or metadata-current.

    files: root, status (ok, partial, failed, not-indexed), action of reindex_plan(), stale_attempt, hashed; roots: root, exists.
    Failed files are counted and play no part in the state; only a run that hashed every file can say current.
    """
    changed = F.col("action").isin("drop", "parse") & ~F.col("status").eqNullSafe("not-indexed")
    each = files.groupBy("root").agg(
        F.count_if(changed).alias("changed"), F.count_if(F.col("action") == "drop").alias("removed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "not-indexed").alias("not_indexed"), F.count_if(F.col("stale_attempt")).alias("stale_attempts"), F.count_if(~F.col("hashed")).alias("unproved"),
    )
    numbers = each.columns[1:]
    out = roots.join(each, "root", "left").fillna(0, numbers)
    state = F.when(F.col("changed") > 0, "stale").when((F.col("not_indexed") > 0) | (F.col("stale_attempts") > 0) | ~F.col("exists"), "degraded").when(F.col("unproved") == 0, "current").otherwise("metadata-current")
    return out.select("root", *numbers, state.alias("state"))


def heal_decision(report: DataFrame, limit: int = HEAL_LIMIT) -> DataFrame:
    """One row over a report: state of the whole, changed files, and whether a search may repair the index: heal, over-limit or leave."""
    worst = F.element_at(F.array(*[F.lit(x) for x in ("uninitialized", "stale", "degraded", "metadata-current", "current")]), F.coalesce(F.min(F.when(F.col("state") == "stale", 2).when(F.col("state") == "degraded", 3).when(F.col("state") == "metadata-current", 4).otherwise(5)), F.lit(1)))
    out = report.agg(worst.alias("state"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.coalesce(F.sum("stale_attempts"), F.lit(0)).alias("stale_attempts"))
    due = F.col("state").isin("stale", "degraded") & ((F.col("changed") > 0) | (F.col("stale_attempts") > 0))
    return out.withColumn("decision", F.when(~due, "leave").when(F.col("changed") > limit, "over-limit").otherwise("heal"))


def git_delta(diffed: DataFrame, stored: DataFrame, head_then: Column, head_now: Column) -> DataFrame:
    """(root, git_delta): unavailable, unchanged, verified (HEAD moved, every diffed path has its stored hash) or changed.

    diffed: root, path, sha256 now (null: gone); stored: root, path, sha256. Heads are columns of `stored`'s root rows."""
    heads = stored.groupBy("root").agg(F.max(head_then).alias("_then"), F.max(head_now).alias("_now"))
    met = diffed.join(stored.select("root", "path", F.col("sha256").alias("_had")), ["root", "path"])
    moved = met.groupBy("root").agg(F.count_if(~F.col("sha256").eqNullSafe(F.col("_had"))).alias("_moved"))
    out = heads.join(moved, "root", "left")
    state = F.when(F.col("_then").isNull() | F.col("_now").isNull(), "unavailable").when(F.col("_then") == F.col("_now"), "unchanged").when(F.coalesce("_moved", F.lit(0)) > 0, "changed").otherwise("verified")
    return out.select("root", state.alias("git_delta"))


def latest_mark_action(marks: DataFrame) -> DataFrame:
    """(path, ref, action): the newest mark of each reference; rows (path, ref, action, seq) stand newest first."""
    return marks.groupBy("path", "ref").agg(F.min_by("action", "seq").alias("action"))


def without_shown(hits: DataFrame, fallbacks: DataFrame, standing: DataFrame, key: str = "id") -> DataFrame:
    """hits whose id neither an earlier search brought up nor the standing rulings hold."""
    return hits.join(fallbacks.select(key).union(standing.select(key)).distinct(), key, "left_anti")


def digest_deliveries(starts: DataFrame) -> DataFrame:
    """Session starts (session, at, source, hash) with what each does: startup and resume pass over a digest whose hash was shown
    last in their session; clear and compact always show it. Null hashes show nothing and leave the last one standing."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A pass over a digest shows the same hash again, so the last hash seen is the last one shown.
    shown = F.last("hash", ignorenulls=True).over(w)
    again = F.col("source").isin("startup", "resume") & F.col("hash").eqNullSafe(shown)
    return starts.withColumn("standing", F.when(F.col("hash").isNull(), "none").when(again, "dedup").otherwise("injected"))


def pending_evidence(events: DataFrame) -> DataFrame:
    """Evidence of a session that no injection has carried yet: rows (session, at, kind evidence or injection, path) after the last injection, compactions or not, each path once."""
    last = events.where("kind = 'injection'").groupBy("session").agg(F.max("at").alias("_last"))
    own = events.where("kind = 'evidence'").join(last, "session", "left").where(F.col("_last").isNull() | (F.col("at") > F.col("_last")))
    return own.groupBy("session", "path").agg(F.min("at").alias("since"))


def envelope(results: DataFrame, order: list[Column], **head: Column) -> DataFrame:
    """One row, `json`: the fields of head and, as an array in order, the results; for results cut to a page before."""
    from pyspark.sql import Window

    rows = results.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*results.columns).alias("r")))).alias("a"))
    return listed.select(F.to_json(F.struct(*[c.alias(k) for k, c in head.items()], F.transform("a", lambda x: x["r"]).alias("results"))).alias("json"))
