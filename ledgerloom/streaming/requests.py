"""Requests for work on a queue that coalesce: marks, one worker at a time, and requests that are put back.

A mark raises a request, further marks join it. A worker that starts takes the request, unless another holds the queue; marks that come
meanwhile make it go on when it is done. A pass that fails puts its request back, a killed one loses it (the next mark raises another).

step() holds the rules; the stream keeps its state by queue. The batch cuts each queue into blocks of at most BLOCK rows: a
block is first reduced to what it does to any state that it may begin with, those few rows are composed in order, and then each block is run
from its own state. So a queue of any length is worked on in parallel, a block at a time in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.order import placed
from ..session import written

BLOCK = 4096
OUT = "queue string, at double, seq long, kind string, verdict string, pending long, taken long"
_EFFECT = "queue string, block long, marked boolean, held boolean, to_held boolean, p0 long, p1 long, p2 long, t0 long, t1 long, t2 long"

Count = tuple[int, int, int]  # marks that stood when a block began, marks that were taken then, marks since: how many of each count
NONE: Count = (0, 0, 0)


class State(NamedTuple):
    held: bool  # a worker has the queue
    pending: Count  # marks of the request that stands
    taken: Count  # marks of the request that the worker took


def number(n: int) -> Count:
    return 0, 0, int(n)


def _sum(a: Count, b: Count) -> Count:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def step(s: State, kind: str, some: Callable[[Count], bool]) -> tuple[State, str]:
    """What an event does, and what is said of it. some: whether a count is not 0.

    mark: `raised`, or `coalesced` with a request that stands. start: `claimed`, `busy` if a worker has the queue, `idle` if nothing is asked
    for. done: `again` if marks came meanwhile, else `finished`. fail: `put-back`. kill: `abandoned`. The last three are `ignored` where no
    worker has the queue, and so are events of another kind.
    """
    held, pending, taken = s
    if kind == "mark":
        return State(held, _sum(pending, (0, 0, 1)), taken), "coalesced" if some(pending) else "raised"
    if kind == "start":
        if held:
            return s, "busy"
        return (State(True, NONE, pending), "claimed") if some(pending) else (s, "idle")
    if not held or kind not in ("done", "fail", "kill"):
        return s, "ignored"
    if kind == "done":
        return (State(True, NONE, pending), "again") if some(pending) else (State(False, pending, NONE), "finished")
    if kind == "fail":
        return State(False, _sum(pending, taken), NONE), "put-back"
    return State(False, pending, NONE), "abandoned"


def _some(count: Count) -> bool:
    return count[2] > 0


def _run(pdf: pd.DataFrame, s: State) -> tuple[pd.DataFrame, State]:
    said = []
    for kind in pdf["kind"]:
        s, verdict = step(s, kind, _some)
        said.append((verdict, s.pending[2], s.taken[2]))
    return pdf[["queue", "at", "seq", "kind"]].assign(**{c: [x[i] for x in said] for i, c in enumerate(("verdict", "pending", "taken"))}), s


def _effects(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's effect on each of the four sorts of states: with and without a request, with and without a worker."""
    rows, kinds = [], pdf.sort_values("_i")["kind"].tolist()
    for marked in (False, True):
        for held in (False, True):
            s = State(held, (1, 0, 0) if marked else NONE, (0, 1, 0) if held else NONE)
            for kind in kinds:
                s, _ = step(s, kind, any)  # counts that enter a block are not 0 in its sort of state
            rows.append((pdf["queue"].iloc[0], pdf["block"].iloc[0], marked, held, s.held, *s.pending, *s.taken))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _EFFECT.split(", ")])


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state that each block of a queue begins with."""
    at = {(e.block, e.marked, e.held): e for e in pdf.itertuples(index=False)}
    held, pending, taken, rows = False, 0, 0, []
    for block in sorted(pdf["block"].unique()):
        rows.append((pdf["queue"].iloc[0], block, held, pending, taken))
        e = at[block, pending > 0, held]
        held, pending, taken = e.to_held, pending * e.p0 + taken * e.p1 + e.p2, pending * e.t0 + taken * e.t1 + e.t2
    return pd.DataFrame(rows, columns=["queue", "block", "from_held", "from_pending", "from_taken"])


def _clean(events: DataFrame) -> DataFrame:
    """Null queues are the queue of the empty name. Events without a time have no place and are left out."""
    return events.where("at is not null").select(F.coalesce(F.col("queue").cast("string"), F.lit("")).alias("queue"), F.col("at").cast("double").alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"))


def coalesced(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """events (queue, at, seq, kind) in the order of at, seq and kind, each with what is said of it, and the marks that stand and are taken after it."""
    rows = placed(_clean(events), ["queue"], ["at", "seq", "kind"]).withColumn("block", F.floor(F.col("_i") / block)).drop("_n")
    rows = written(rows, "requests")
    starts = rows.groupBy("queue", "block").applyInPandas(_effects, _EFFECT).groupBy("queue").applyInPandas(_compose, "queue string, block long, from_held boolean, from_pending long, from_taken long")

    def replayed(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return _run(pdf.sort_values("_i"), State(bool(first["from_held"]), number(first["from_pending"]), number(first["from_taken"])))[0]

    return rows.join(starts, ["queue", "block"]).groupBy("queue", "block").applyInPandas(replayed, OUT)


class Queues(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "held boolean, pending long, taken long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, pending, taken = self.state.get() if self.state.exists() else (False, 0, 0)
        s = State(held, number(pending), number(taken))
        pdf = pd.concat(list(rows))  # a micro-batch comes in no order
        out, s = _run(pdf.sort_values(["at", "seq", "kind"]), s)
        self.state.update((bool(s.held), s.pending[2], s.taken[2]))
        yield out

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """coalesced() over a stream whose micro-batches follow one another in time; needs the RocksDB state store."""
    return _clean(events).groupBy("queue").transformWithStateInPandas(Queues(), OUT, "Append", "None")
