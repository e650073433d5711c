"""Statistics over log lines and ledgers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values
from .order import placed


def read_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of a log and its rotated parts, with the file of each and its age: the largest rotation is the oldest."""
    name = F.col("_metadata.file_name")
    return spark.read.text(pattern).select(F.col("value").alias("line"), name.alias("file_name"), rotation(name).alias("rotation")).where("rotation is not null")


def rotation(name: Column) -> Column:
    """0 for x.log, n for x.log.n, null for other files; oldest first is by descending rotation."""
    return F.when(name.rlike(r"\.log(\.\d+)?$"), F.coalesce(F.regexp_extract(name, r"\.log\.(\d+)$", 1).try_cast("int"), F.lit(0)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """ts, kind (`pre-edit` where a line names none), outcome, session, project, file, reason of each line."""
    first = F.regexp_extract("line", r"^(\S+)", 1)
    second = F.regexp_extract("line", r"^\S+\s+(\S+)", 1)
    kind = F.when(F.contains(second, F.lit("=")), "pre-edit").otherwise(second)
    fields = {n: X.log_field(F.col("line"), n) for n in ("outcome", "session", "project", "file", "reason", "elapsed")}
    return lines.select("line", values.log_time(first).alias("ts"), kind.alias("kind"), *[c.alias(n) for n, c in fields.items()])


def within(rows: DataFrame, ts: str, days: int, now: datetime.datetime) -> DataFrame:
    """Rows of the last days, both bounds included; later ones are out."""
    end = F.lit(now)
    return rows.where(F.col(ts).between(end - F.make_interval(days=F.lit(days)), end))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def nearest_rank(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """p50 and p95 as the values at the nearest rank; nulls do not count. Equal values are counted first, and the counts summed up in the
    order of values over range partitions: no group's values meet in one buffer."""
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    at = placed(each.where(F.col(value).isNotNull()), list(keys), [value], weight="_m")
    hit = [F.min(F.when(F.col("_i") + F.col("_m") >= F.ceil(F.round(F.col("_n") * F.lit(p), 9)), F.col(value))).alias(f"p{int(p * 100)}") for p in (0.5, 0.95)]
    found = at.groupBy(*keys).agg(*hit)
    return found if not keys else found.unionByName(each.groupBy(*keys).agg(F.max(value).alias("_v")).where("_v is null").select(*keys, *[F.lit(None).cast(each.schema[value].dataType).alias(c) for c in ("p50", "p95")]))


def top_topics(rows: DataFrame, topic: str, k: int = 5) -> DataFrame:
    return counts(rows, topic).orderBy(F.desc("n"), topic).limit(k)


def injected_topics(lines: DataFrame) -> DataFrame:
    """(line, topic): the topics that a line of an edit names; the `+N` of a cut list is none."""
    each = lines.select("line", F.explode(F.split(X.log_field(F.col("line"), "topics"), ",")).alias("topic"))
    return each.where(~F.col("topic").rlike(r"^\+\d+$") & (F.col("topic") != ""))


def listed(ids: DataFrame, key: str, by: list[str], most: int = 10) -> DataFrame:
    """(by, shown): distinct ids in order, at most `most` of them, and `+N` for the others."""
    w = Window.partitionBy(*by).orderBy(key)
    each = ids.select(*by, F.col(key).cast("string").alias("_id"), key).distinct().withColumn("_n", F.row_number().over(w))
    out = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "_id")))).alias("_a"), F.count_if(F.col("_n") > most).alias("_more"))
    return out.select(*by, F.concat_ws(" ", F.array_join(F.transform("_a", lambda s: s["_id"]), " "), F.when(F.col("_more") > 0, F.concat(F.lit("+"), F.col("_more").cast("string")))).alias("shown"))


def health(rows: DataFrame, nudge: Column, append: Column, prompt: Column, lookup: Column, kill: Column) -> DataFrame:
    """Counts in one row, and the flags they raise: write-silent, read-silent, watchdog."""
    n = {"nudges": nudge, "appends": append, "prompts": prompt, "lookups": lookup, "kills": kill}
    out = rows.agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return out.withColumns({
        "write_silent": (F.col("nudges") >= 3) & (F.col("appends") == 0),
        "read_silent": (F.col("prompts") >= 10) & (F.col("lookups") == 0),
        "watchdog": F.col("kills") >= 3,
    })


def ledger_growth(events: DataFrame, session: str, path: str, sha: str, ts: str) -> DataFrame:
    """Events whose (path, content) is new to their session: the batch form of the ledger stream."""
    w = Window.partitionBy(session, path, sha).orderBy(ts)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def redelivered(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Events that repeat another of their key within `seconds` before them."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(ts))
    return events.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp")) <= seconds * 1_000_000)).drop("_b")


def newest(rows: DataFrame, partition: list[str], order: list[Column], keep: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def embedding_mode(rows: DataFrame, fresh: Column) -> DataFrame:
    """One row: fresh vectors, all rows, and none, partial or full."""
    out = rows.agg(F.count_if(fresh).alias("fresh"), F.count("*").alias("total"))
    return out.withColumn("mode", F.when(F.col("fresh") == 0, "none").when(F.col("fresh") == F.col("total"), "full").otherwise("partial"))


def coverage_fact(rows: DataFrame, path: str, shown: int = 8) -> DataFrame:
    """How many paths are unmapped, the first of them by name, how many more."""
    first = rows.select(path).orderBy(path).limit(shown).agg(F.array_sort(F.collect_list(path)).alias("first"), F.lit(1).alias("_one"))
    return rows.agg(F.count("*").alias("n"), F.lit(1).alias("_one")).join(F.broadcast(first), "_one").drop("_one").withColumn("more", F.greatest(F.col("n") - shown, F.lit(0)))
