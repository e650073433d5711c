import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values
from ledgerloom.operators import governance, lint, logs, patterns, rank
from ledgerloom.sources import code, records
from ledgerloom.streaming import sessions

PATHS = [
    ("src/foo.py.bak", "src/foo.py", False), ("src/core2/x.py", "src/core", False), ("src/core/x.py", "src/core", True), ("src/core/x.py", "src/core/", True), ("src/x.py", "src/x.py", True),
    ("src/x.py", "src/x.py#Foo.bar", True), ("src", "src/x.py", True), ("src/x.py", "#Foo", False), ("src/x.py", "", False), ("src/a/b.py", "src/*.py", True), ("src/a.pyc", "src/*.py", False), ("a[1].py", "a?1?.py", True), ("b.py", "[!a].py", True),
]


def test_path_predicate_and_join_agree(spark):
    pairs = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(PATHS)], "i int, path string, ref string")
    got = {r["i"]: r["m"] for r in pairs.select("i", governance.matches(F.col("path"), F.col("ref")).alias("m")).collect()}
    assert got == {i: m for i, (_, _, m) in enumerate(PATHS)}
    joined = governance.govern(pairs.select("path").distinct(), pairs.select("ref").distinct())
    found = {(r["path"], r["ref"]) for r in joined.collect()}
    for p, r, m in PATHS:
        assert ((p, r) in found) == m


@pytest.mark.parametrize("most", [10_000, 3])
def test_glob_references_govern_alike_on_both_sides_of_the_bound(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "BLOCK", most)
    refs = ["app/[id]/page.tsx", "app/[id]", "docs/*.md", "docs", "*/1*", "src/**/t?st.py", "/abs/*.c", "a//*.py", "*", "app/i/", "lib/?#sym", "x[!y]/z", "", "#q"]
    paths = ["app/[id]/page.tsx", "app/[id]", "app/[id]/a/b", "app/i", "app/i/page.tsx", "app", "docs", "docs/a.md", "docs/a/b.md", "docs/*.md", "docs/*.md/x", "a/1", "a/b/1c", "src", "src/**", "src/a/b/test.py", "/abs", "/abs/f.c", "a", "a//m.py", "lib/s", "lib/?", "lib/?/y", "xa/z", "xy/z", "x[!y]", "z.txt"]
    p, r = spark.createDataFrame([(x,) for x in paths], "path string"), spark.createDataFrame([(x,) for x in refs], "ref string")
    want = {(x["path"], x["ref"]) for x in p.crossJoin(r).where(governance.matches(F.col("path"), F.col("ref"))).collect()}
    assert {("docs", "docs/*.md"), ("app/[id]/page.tsx", "app/[id]"), ("app/[id]/page.tsx", "app/[id]/page.tsx")} <= want
    got = [(x["path"], x["ref"]) for x in governance.govern(p, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def naive_bm25(docs, query):
    toks = {k: __import__("re").findall("[a-z0-9]+", t.lower()) for k, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for k, t in toks.items():
        c = Counter(t)
        s = 0.0
        for q in dict.fromkeys(query):
            df = sum(q in x for x in toks.values())
            if c[q]:
                s += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * c[q] * 2.2 / (c[q] + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if any(c[q] for q in query):
            out[k] = s
    return out


def test_bm25_equals_a_loop(spark):
    r = random.Random(7)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randrange(0, 12)))) for i in range(60)]
    got = {x["k"]: x["score"] for x in rank.bm25(spark.createDataFrame(docs, "k int, text string"), "k", F.col("text"), ["alpha", "beta", "alpha", "none"]).collect()}
    want = naive_bm25(docs, ["alpha", "beta", "none"])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cosine_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 0.0]), (4, [float("nan"), 1.0], [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [r[0] for r in rows.orderBy("i").select(values.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 10, 97, 1000])
def test_coprime_offset(n):
    o = values.coprime_offset(n)
    assert 1 <= o < n and math.gcd(o, n) == 1


def test_coverage_bound_is_enough(spark):
    df = spark.createDataFrame([("one two three four zebra", "zebra")], "q string, d string")
    q = "north south east zebra"
    assert df.select(rank.confident(F.lit(q), F.col("d"))).first()[0]
    assert not df.select(rank.confident(F.lit(q + " west"), F.col("d"))).first()[0]


def test_language_and_shebang(spark):
    df = spark.createDataFrame([("#!/usr/bin/env python3.11",), ("#!/bin/lua",), ("no",), ("#!",)], "l string")
    assert [r[0] for r in df.select(X.language_of_shebang(F.col("l"))).collect()] == ["python", "lua", None, None]


TOPIC = b"""---
type: topic
id: TOP-1
title: One
area: processing/x
current: L1
code_refs: [src/a.py]
links:
- link: L2
  date: 2024-01-02
  status: active
  kind: adopted
  ruling: {text: Keep it., authority: owner-verbatim, source: s}
  edges: [{rel: led_to, to: TOP-2}]
  assumptions: [{id: A1, text: t, status: broken}]
- link: L1
  status: superseded
  ruling: {text: Old., authority: agent-inference}
---
Body.
"""


def test_records(spark, tmp_path):
    (tmp_path / "topics").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "inbox").mkdir()
    (tmp_path / "topics/a.md").write_bytes(TOPIC)
    (tmp_path / "topics/bad.md").write_bytes(b"---\nid: TOP-9\ntitle: [x\n---\n")
    (tmp_path / "inbox/n.md").write_bytes(b"plain \xc3\xa9")
    (tmp_path / "node_modules/x.md").write_bytes(b"no")
    rows = {r["path"]: r for r in records.read_store(spark, str(tmp_path)).collect()}
    assert set(rows) == {"topics/a.md", "topics/bad.md", "inbox/n.md"}
    assert rows["inbox/n.md"]["type"] == "inbox" and rows["inbox/n.md"]["body"] == "plain é"
    assert not rows["topics/bad.md"]["valid"] and rows["topics/bad.md"]["fallback"] and rows["topics/bad.md"]["id"] == "TOP-9"
    store = records.read_store(spark, str(tmp_path))
    links = records.links(store)
    assert [(r["link"], r["seq"]) for r in links.orderBy("seq").collect()] == [("L2", 0), ("L1", 1)]
    assert governance.current_links(links).first()["current"] == "L2"
    assert records.link_records(store).count() == 2
    chain = governance.chain(links, records.edges(store), records.assumptions(store)).first()
    assert chain["edges"][0]["rel"] == "led_to" and chain["broken"] == ["A1"]
    found = {r["rule"] for r in lint.topic_rules(store.where("type = 'topic' and valid"), links).collect()}
    assert found == {"current"}
    rules = {(r["link"], r["rule"]) for r in lint.link_rules(links).collect()}
    assert ("L1", "superseded") in rules
    records.write_index(store, str(tmp_path / "index"), "demo")
    assert records.read_index(spark, str(tmp_path / "index")).count() == 2
    assert records.read_index(spark, str(tmp_path / "index"), "index_errors").count() == 1
    with pytest.raises(Exception):  # noqa: B017  readers never create an index
        records.read_index(spark, str(tmp_path / "none"))


def test_parse_never_raises():
    for raw in (b"\xff", b"---\n", b"---\n- a\n---\n", b"---\nlinks: 3\n---\n", b"", b"---\nid: TOP-1\nlinks:\n- link: L1\n- link: L1\n---\n"):
        out = records.parse(raw)
        assert out["valid"] == (raw == b"")


def test_census_seeds_every_language(spark):
    files = spark.createDataFrame([("a.py", b"x", 1), ("run", b"#!/usr/bin/env python3\n", 3), ("x.unknown", b"", 0)], "path string, content binary, length long")
    n = {r["lang"]: r["n"] for r in code.census(files).collect()}
    assert n["python"] == 2 and n["swift"] == 0 and len(n) == 9
    assert [(r["ext"], r["n"]) for r in code.unindexed(files).orderBy("ext").collect()] == [("", 1), (".unknown", 1)]


def test_declared_symbols():
    assert code.declared_symbols("A = 1\nclass B:\n    def c(self): pass\n") == ["A", "B", "B.c"]
    assert code.declared_symbols("def (") == []


def test_log_lines(spark, tmp_path):
    lines = ["2026-01-01T00:00:00+00:00 userprompt outcome=injected session=s1 project=demo", "2026-01-02T00:00:00+00:00 outcome=matched elapsed=0s project=demo file=/z y.py", "rubbish"]
    (tmp_path / "hook.log").write_text(lines[0] + "\n")
    (tmp_path / "hook.log.1").write_text("\n".join(lines[1:]) + "\n")
    (tmp_path / "hook.log.bak").write_text("no\n")
    parsed = logs.parse_lines(logs.read_logs(spark, str(tmp_path / "hook.log*")))
    rows = {r["line"]: r for r in parsed.collect()}
    assert len(rows) == 3
    assert rows[lines[0]]["kind"] == "userprompt" and rows[lines[0]]["session"] == "s1"
    assert rows[lines[1]]["kind"] == "pre-edit" and rows[lines[1]]["file"] == "/z y.py" and rows["rubbish"]["ts"] is None
    now = datetime.datetime(2026, 1, 2)
    assert logs.within(parsed, "ts", 1, now).count() == 2 and logs.within(parsed, "ts", 0, now).count() == 1


EVENTS = [("s", 0.0, "edit", "a", "1"), ("s", 1.0, "prompt", "p1", ""), ("s", 2.0, "prompt", "p1", ""), ("s", 3.0, "edit", "a", "1"), ("s", 4.0, "edit", "a", "2"), ("s", 5.0, "prompt", "p2", ""), ("s", 1000.0, "prompt", "p3", ""), ("s", 1001.0, "commit", "r", "c1"), ("s", 1002.0, "commit", "r", "c1"), ("t", 0.0, "prompt", "q1", ""), ("t", 1300.0, "prompt", "q2", "")]
VERDICTS = ["grown", "coverage", "repeat", "same", "grown", "quiet", "coverage", "commit", "same", "quiet", "look-back"]


def test_session_rules(spark):
    df = spark.createDataFrame(EVENTS, "session string, at double, kind string, key string, value string")
    assert [r["verdict"] for r in sessions.replay(df).orderBy("session", "at").collect()] == VERDICTS


def test_session_rules_by_windows(spark):
    """Windows and joins give what a loop over each session gives: redeliveries, lost ones, ties, nulls, many commits, one long session."""
    import random

    r = random.Random(7)
    rows = list(EVENTS) + [(None, 1.0, "prompt", None, None), (None, 2.0, "edit", None, None), ("n", None, "edit", "a", "1")]
    for n in range(25):
        at = 0.0
        for _ in range(400 if n == 0 else r.randrange(1, 60)):
            at += r.choice([0, 1, 30, 300, 900, 1200])
            kind = r.choices(["edit", "commit", "prompt"], [1 if n % 2 else 4, 6 if n % 5 == 0 else 1, 6])[0]
            value = {"edit": str(r.randrange(3)), "commit": str(r.randrange(30)), "prompt": r.choice(["", "", "lost"])}[kind]
            rows.append((f"s{n}", at, kind, r.choice("abc"), value))
    df = spark.createDataFrame(rows, "session string, at double, kind string, key string, value string")
    want, got = (sorted(map(repr, map(tuple, f(df).collect()))) for f in (sessions.replay, sessions.verdicts))
    assert got == want
    said = {x.split("'")[-2] for x in want}
    assert {"grown", "same", "commit", "repeat", "open", "coverage", "look-back", "quiet"} <= said
    assert sessions.verdicts(df.limit(0)).count() == 0


def test_a_lost_delivery_is_retried(spark):
    s = sessions.fresh()
    events = [("edit", "a", "1", 0.0), ("prompt", "p", "lost", 1.0), ("prompt", "p", "lost", 2.0), ("prompt", "p", "", 3.0), ("prompt", "p", "", 4.0)]
    assert [(sessions.step(s, *e), s["turn"]) for e in events] == [("grown", 0), ("open", 1), ("open", 1), ("coverage", 1), ("repeat", 1)]


def test_session_stream(spark, tmp_path):
    schema = "session string, at double, kind string, key string, value string"
    src = str(tmp_path / "in")
    spark.createDataFrame(EVENTS, schema).coalesce(1).write.json(src)
    q = sessions.stream(spark.readStream.schema(schema).json(src), expire=False).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r["verdict"] for r in spark.sql("select * from verdicts order by session, at").collect()] == VERDICTS


def test_history_rules(spark):
    schema = "path string, link string, seq int, status string, superseded_by string, promoted_by string, ruling string"
    old = spark.createDataFrame([("t", "L1", 1, "active", None, None, "a"), ("t", "L2", 0, "active", None, None, "b"), ("u", "L1", 0, "active", None, None, "c")], schema)
    new = spark.createDataFrame([("t", "L1", 2, "superseded", "L3", None, "a"), ("t", "L2", 0, "active", None, None, "B"), ("t", "L3", 1, "active", None, None, "n")], schema)
    got = {(r["path"], r["link"], r["rule"]) for r in lint.history(old, new, ["ruling"]).collect()}
    assert got == {("u", "L1", "removed"), ("t", "L2", "body-frozen"), ("t", "L3", "insert")}


def test_rejections_are_restored(spark):
    rows = [("a", "L1", 1, "declined", "declined", "No.", None, None, []), ("a", "L2", 2, "active", "restored", "Back", "L1", None, []), ("a", "L3", 3, "active", "adopted", "No.", None, None, [])]
    df = spark.createDataFrame(rows, "path string, link string, seq int, status string, kind string, ruling_text string, reverses string, rationale_text string, alternatives array<struct<option:string,rejected_because:string>>")
    assert lint.rejections(df).first()["restored_num"] == 2
    assert lint.readoptions(df).count() == 0


def test_readoptions_across_topics_do_not_grow_with_pairs(spark):
    """600 topics that reject one sentence and 600 that adopt it: a finding for each that adopts it, and one for a topic that does both with another's rejection."""
    rows = [(f"r{i}", "L1", 1, "declined", "declined", "No  way.", None, None, []) for i in range(600)] + [(f"a{i}", "L1", 1, "active", "adopted", "No way.", None, None, []) for i in range(600)]
    rows += [("r0", "L2", 2, "active", "adopted", "No\nway.", None, None, []), ("o", "L1", 1, "declined", "declined", "Own.", None, None, []), ("o", "L2", 2, "active", "adopted", "Own.", None, None, [])]
    df = spark.createDataFrame(rows, "path string, link string, seq int, status string, kind string, ruling_text string, reverses string, rationale_text string, alternatives array<struct<option:string,rejected_because:string>>")
    got = [(r["path"], r["link"], r["message"]) for r in lint.readoptions(df, across_topics=True).collect()]
    assert sorted(got) == sorted([(f"a{i}", "L1", "re-adopts what L1 rejects") for i in range(600)] + [("r0", "L2", "re-adopts what L1 rejects")])
    assert {(r["path"], r["link"]) for r in lint.readoptions(df).collect()} == {("r0", "L2"), ("o", "L2")}


def test_offsets_of_columns_equal_those_of_numbers(spark):
    from ledgerloom.functions import values

    got = spark.range(2, 200).select("id", values.coprime_column(F.col("id")).alias("o")).collect()
    assert all(r["o"] == values.coprime_offset(r["id"]) for r in got)


def test_texts_are_cut_once_a_scan_and_sides_joined_once(spark):
    """Plans: one tokenisation in the scored pass and one in the statistics; one full outer join for all rules of history."""
    from ledgerloom.operators import lint, rank

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    plan = rank.bm25(docs, "doc_id", F.col("text"), ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 2
    side = spark.createDataFrame([("p", "L1", 1, "active", None, None, "x")], "path string, link string, seq int, status string, superseded_by string, promoted_by string, body string")
    plan = lint.history(side, side, ["body"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1


def test_chunker_versions_follow_the_parser(monkeypatch):
    from ledgerloom.sources import code

    before = code.chunker_version("python")
    assert len(before) == 12 and before != code.chunker_version("swift")
    monkeypatch.setitem(code.fixed.LANGUAGES, "python", ([".py", ".pyi"], *code.fixed.LANGUAGES["python"][1:]))
    assert code.chunker_version("python") != before


def test_signatures_as_written():
    from ledgerloom.sources import code

    src = "class A:\n    def __new__(cls, a, /, b: int = 1, *, c=2, d: str = 'x', **k) -> 'A': pass\n    def f(self, x=lambda: 1, y: a | b = -1, *z: int): pass\n"
    got = [(c["kind"], c["signature"]) for c in code.chunk_python(src)[0]]
    assert got == [("method", "def __new__(cls, a, /, b: int = 1, *, c=2, d: str = 'x', **k) -> 'A'"), ("method", "def f(self, x=<...>, y: a | b = -1, *z: int)")]
