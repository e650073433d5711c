"""Sessions as a stream: ledger growth, reminders with a cooldown, redelivered prompts; and the same rules over a batch.

step() holds the rules for one event; the stream keeps its state in a state store by session. verdicts() gives the same rows of
a batch by windows and joins; replay() applies step() to each session in order and is what the other two are tested against.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import written

TURNS, SECONDS = 3, 15 * 60
LOOK_TURNS, LOOK_SECONDS = 5, 20 * 60
COMMITS = 20
LOST = "lost"
TTL_MS = 24 * 3600 * 1000
OUT = "session string, at double, kind string, verdict string, turn int, grown int"


def fresh() -> dict:
    return {"turn": 0, "seen": {}, "grown": 0, "last_turn": None, "last_time": None, "look_turn": 0, "look_time": None, "last_prompt": None, "open": False, "commits": []}


def step(s: dict, kind: str, key: str, value: str, at: float) -> str:
    """Apply one event to a session's state and say what it brings.

    edit (path, content hash): `grown` if the path had another content or none. commit (root, hash): `commit` if the hash is not
    among the last 20. prompt (id hash, `lost` if the delivery broke off before it was answered): a prompt of the id of the one
    before is a redelivery: `repeat` if an earlier delivery was answered, else a retry, which decides anew and is no further turn.
    A lost delivery is `open`, and decides nothing. Others: `coverage` if evidence grew since the last one and three turns or 15
    minutes passed since the last reminder of either sort; else `look-back` after five turns or 20 minutes; else `quiet`.
    """
    if kind == "edit":
        if key in s["seen"] and s["seen"][key] == value:
            return "same"
        s["seen"][key] = value
        s["grown"] += 1
        return "grown"
    if kind == "commit":
        if value in s["commits"]:
            return "same"
        s["commits"] = [*s["commits"], value][-COMMITS:]
        return "commit"
    if key == s["last_prompt"]:
        if not s["open"]:
            return "repeat"
    else:
        s["turn"] += 1
        s["last_prompt"] = key
    s["open"] = value == LOST
    if s["look_time"] is None:
        s["look_time"] = at
    if s["open"]:
        return "open"
    waited = s["last_turn"] is None or s["turn"] - s["last_turn"] >= TURNS or at - s["last_time"] >= SECONDS
    if s["grown"] and waited:
        verdict = "coverage"
        s["grown"] = 0
    elif s["turn"] - s["look_turn"] >= LOOK_TURNS or at - s["look_time"] >= LOOK_SECONDS:
        verdict = "look-back"
    else:
        return "quiet"
    s.update(last_turn=s["turn"], last_time=at, look_turn=s["turn"], look_time=at)
    return verdict


def _clean(events: DataFrame) -> DataFrame:
    """Keys and values that are null are empty; events without a time have no place in a session and are left out."""
    return events.where("at is not null").select("session", F.col("at").cast("double").alias("at"), F.coalesce("kind", F.lit("prompt")).alias("kind"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("key", "value")])


def _row(session, e, verdict: str, s: dict) -> tuple:
    return session, float(e.at), e.kind, verdict, s["turn"], s["grown"]


def replay(events: DataFrame) -> DataFrame:
    """events (session, at seconds, kind, key, value) in the order of their time, each with its verdict."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = fresh(), []
        for e in pdf.sort_values(["at", "kind", "key", "value"]).itertuples(index=False):
            out.append(_row(e.session, e, step(s, e.kind, e.key, e.value, float(e.at)), s))
        return pd.DataFrame(out, columns=["session", "at", "kind", "verdict", "turn", "grown"])

    return _clean(events).groupBy("session").applyInPandas(run, OUT)


def verdicts(events: DataFrame) -> DataFrame:
    """The rows of replay(), by windows and joins.

    After a reminder of either sort no evidence is pending and both clocks start anew, so the place of a reminder alone says where
    the next one is: the first prompt with three turns or 15 minutes and new evidence behind it, or the first with five turns or
    20 minutes, whichever is earlier. Those next places are taken for every prompt by windows that grow one way, and the ones
    that are reached from a session's start are found by doubling the steps: as many rounds as the logarithm of the longest chain
    of reminders, by joins on (session, place), which no long session makes uneven. Windows over a session spill to disk.
    """
    here = Window.partitionBy("_k").orderBy("_i")
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_k").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    is_prompt = ~F.col("kind").isin("edit", "commit")
    one = lambda c: F.when(c, 1).otherwise(0)

    rows = _clean(events).withColumn("_k", F.to_json(F.struct("session")))  # no null: a session without a name is one too
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy("at", "kind", "key", "value")))
    had = F.lag("value").over(Window.partitionBy("_k", "kind", "key").orderBy("_i"))
    rows = rows.withColumn("_grew", (F.col("kind") == "edit") & (had.isNull() | (had != F.col("value"))))
    last_key = F.last(F.when(is_prompt, F.col("key")), ignorenulls=True).over(before)
    rows = rows.withColumn("_new", is_prompt & (last_key.isNull() | (last_key != F.col("key"))))
    rows = rows.withColumn("turn", F.sum(one(F.col("_new"))).over(upto).cast("int"))
    answered = F.sum(one(is_prompt & (F.col("value") != LOST))).over(Window.partitionBy("_k", "turn").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(F.coalesce(answered, F.lit(0)) > 0, "repeat").when(F.col("value") == LOST, "open").otherwise("decides")
    rows = rows.withColumn("_prompt", F.when(is_prompt, state)).withColumn("_began", F.min(F.when(is_prompt, F.col("at"))).over(upto))
    rows = written(rows, "session_events")

    decides = F.col("_prompt").eqNullSafe(F.lit("decides"))
    ahead = rows.withColumn("_next", F.min(F.when(decides, F.col("_i"))).over(after))
    # The decision behind the next new evidence; places only grow, so the smallest is that of the first such evidence.
    ahead = ahead.withColumn("_evidence", F.min(F.when(F.col("_grew"), F.col("_next"))).over(after))
    asleep = (F.col("turn") >= LOOK_TURNS) | (F.col("at") - F.col("_began") >= LOOK_SECONDS)
    first = F.least(F.min(F.when(decides & asleep, F.col("_i"))), F.min(F.when(F.col("_grew"), F.col("_next"))))
    reached = ahead.groupBy("_k").agg(first.alias("_i")).where("_i is not null")
    by_turn, by_time = (Window.partitionBy("_k").orderBy(F.desc(c)) for c in ("turn", "at"))

    def first_behind(turns: int, seconds: int) -> Column:
        return F.least(F.min("_i").over(by_turn.rangeBetween(Window.unboundedPreceding, -turns)), F.min("_i").over(by_time.rangeBetween(Window.unboundedPreceding, -seconds)))

    jumps = ahead.where(decides).withColumn("_waited", first_behind(TURNS, SECONDS)).withColumn("_look", first_behind(LOOK_TURNS, LOOK_SECONDS))
    covers = F.when(F.col("_waited").isNotNull() & F.col("_evidence").isNotNull(), F.greatest("_waited", "_evidence"))
    jumps = written(jumps.select("_k", "_i", F.least(covers, F.col("_look")).alias("_to")).where("_to is not null"), "jumps")
    reached = written(reached, "reached")
    while not jumps.isEmpty():
        step_on = reached.join(jumps, ["_k", "_i"]).select("_k", F.col("_to").alias("_i"))
        reached = written(reached.unionByName(step_on), "reached")
        far = jumps.select("_k", F.col("_i").alias("_to"), F.col("_to").alias("_far"))
        jumps = written(jumps.join(far, ["_k", "_to"]).select("_k", "_i", F.col("_far").alias("_to")), "jumps")

    out = rows.join(reached.withColumn("_hit", F.lit(True)), ["_k", "_i"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    grew, reminded = (F.coalesce(F.max(F.when(F.col(c), F.col("_i"))).over(before), F.lit(0)) for c in ("_grew", "_hit"))
    out = out.withColumn("_covers", F.col("_hit") & (grew > reminded)).withColumn("_sum", F.sum(one(F.col("_grew"))).over(upto))
    spent = F.coalesce(F.max(F.when(F.col("_covers"), F.col("_sum"))).over(upto), F.lit(0))
    said = F.when(F.col("_covers"), "coverage").when(F.col("_hit"), "look-back").when(decides, "quiet").otherwise(F.col("_prompt"))
    out = out.withColumn("grown", (F.col("_sum") - spent).cast("int")).join(_commits(rows), ["_k", "_i"], "left")
    verdict = F.when(F.col("kind") == "edit", F.when(F.col("_grew"), "grown").otherwise("same")).when(F.col("kind") == "commit", F.when(F.col("_once"), "commit").otherwise("same")).otherwise(said)
    return out.select("session", "at", "kind", verdict.alias("verdict"), "turn", "grown")


def _commits(rows: DataFrame) -> DataFrame:
    """(_k, _i, _once) of commits: whether the hash is not among the last 20 new ones. Where a session has 20 hashes at most, that is a hash's
    first row; others are read in order, with 20 hashes kept."""
    own = rows.where("kind = 'commit'").select("_k", "_i", "value")
    many = own.groupBy("_k").agg(F.count_distinct("value").alias("_d")).where(F.col("_d") > COMMITS).select("_k")
    few = own.join(many, "_k", "left_anti").withColumn("_once", F.row_number().over(Window.partitionBy("_k", "value").orderBy("_i")) == 1)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for pdf in batches:
            once = []
            for k, value in zip(pdf["_k"], pdf["value"], strict=True):
                if k != at:
                    at, kept = k, []
                once.append(value not in kept)
                if once[-1]:
                    kept = [*kept, value][-COMMITS:]
            yield pdf[["_k", "_i"]].assign(_once=once)

    rest = own.join(many, "_k", "left_semi").repartition("_k").sortWithinPartitions("_k", "_i").mapInPandas(fold, "_k string, _i int, _once boolean")
    return few.select("_k", "_i", "_once").unionByName(rest)


class Sessions(StatefulProcessor):
    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "json string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = fresh() | (json.loads(self.state.get()[0]) if self.state.exists() else {})
        out = []
        for pdf in rows:
            for e in pdf.sort_values(["at", "kind", "key", "value"]).itertuples(index=False):
                out.append(_row(key[0], e, step(s, e.kind, e.key, e.value, float(e.at)), s))
        self.state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["session", "at", "kind", "verdict", "turn", "grown"])

    def close(self) -> None:
        pass


def stream(events: DataFrame, expire: bool = True) -> DataFrame:
    """replay() over a stream; needs the RocksDB state store. State goes after 24 hours without events, if expire is set; a
    query that is to end when its input is read (availableNow) sets it off, for expiry keeps the query running."""
    return _clean(events).groupBy("session").transformWithStateInPandas(Sessions(TTL_MS if expire else None), OUT, "Append", "ProcessingTime" if expire else "None")


def deduplicated(prompts: DataFrame, ts: str, key: str, within: str = "10 minutes") -> DataFrame:
    """A stream of prompts without redelivered ones."""
    return prompts.withColumn("_key", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
