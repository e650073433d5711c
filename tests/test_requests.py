"""Requests that coalesce: the rules, the batch by blocks against a loop, the stream against the batch."""

import random

from ledgerloom.streaming import requests

SCHEMA = "queue string, at double, seq long, kind string"


def loop(rows):
    states, out = {}, []
    for q, at, seq, kind in sorted(((q or "", at, seq or 0, k or "") for q, at, seq, k in rows if at is not None), key=lambda r: (r[0], r[1], r[2], r[3])):
        s, said = requests.step(states.get(q, requests.State(False, requests.NONE, requests.NONE)), kind, lambda c: c[2] > 0)
        states[q] = s
        out.append((q, at, seq, kind, said, s.pending[2], s.taken[2]))
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    kinds = ["mark", "mark", "start", "done", "fail", "kill", "other", None]
    return [(r.choice(["a"] * 5 + ["b", "c", None]), float(r.randrange(n // 2)), r.randrange(3), r.choices(kinds, [5, 5, 5, 5, 2, 1, 1, 1])[0]) for _ in range(n)] + [("d", None, 1, "mark"), ("e", 1.0, None, "start")]


def test_rules():
    kinds = ["start", "mark", "mark", "start", "start", "mark", "done", "fail", "start", "kill", "done", "mark", "start", "done"]
    want = ["idle", "raised", "coalesced", "claimed", "busy", "raised", "again", "put-back", "claimed", "abandoned", "ignored", "raised", "claimed", "finished"]
    got = loop([("q", float(i), 0, k) for i, k in enumerate(kinds)])
    assert [g[4] for g in got] == want
    assert [g[5:] for g in got][3:8] == [(0, 2), (0, 2), (1, 2), (0, 1), (1, 0)]


def test_blocks_give_what_a_loop_gives(spark):
    rows = made(600, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = loop(rows)
    for block in (1, 7, 4096):
        assert sorted(map(tuple, requests.coalesced(df, block).collect())) == want
    assert {g[4] for g in want} == {"raised", "coalesced", "claimed", "busy", "idle", "again", "finished", "put-back", "abandoned", "ignored"}
    assert requests.coalesced(df.limit(0)).count() == 0


def test_the_stream_agrees_over_micro_batches(spark, tmp_path):
    rows = [r for r in made(200, 5) if r[1] is not None]
    for n, part in enumerate((lambda a: a < 50, lambda a: a >= 50)):
        spark.createDataFrame([r for r in rows if part(r[1])], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"p{n}"))
        q = requests.stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in" / "p*"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == loop(rows)
