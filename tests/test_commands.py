import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.commands import Store, code_search, stats
from ledgerloom.operators import edits
from ledgerloom.sources import records

CACHE = """---
id: TOP-001
type: topic
title: Cache bounds
status: active
area: storage
current: L2
code_refs: [src/cache.py, "lib/*.py"]
standing: [L2]
links:
- link: L2
  date: 2026-02-02
  status: active
  kind: revised
  ruling: {text: The cache is bounded by bytes, authority: owner-verbatim, source: s2}
  edges: [{rel: depends_on, to: TOP-002/L1}]
  assumptions: [{id: A1, text: memory is scarce, status: broken}]
  invariant: {kind: pattern-absent, pattern: unbounded_cache, allowed: [tests]}
- link: L1
  date: 2026-01-01
  status: superseded
  superseded_by: L2
  ruling: {text: The cache is bounded by entries, authority: owner-verbatim, source: s1}
---
Eviction and limits of the cache.
"""
LOGS = """---
id: TOP-002
type: topic
title: Log rotation
status: active
current: L9
links:
- link: L1
  status: active
  ruling: {text: Logs rotate weekly, authority: owner-verbatim}
---
Rotation.
"""
CONCEPT = """---
id: CON-1
type: concept
title: Logger
implemented_by: [src/log.py#Logger.rotate]
tested_by: [tests/test_log.py]
governed_by: [TOP-002]
---
This is not this concept: the printer.
"""
FILES = {"topics/cache.md": CACHE, "topics/logs.md": LOGS, "concepts/log.md": CONCEPT, "inbox/new.md": "cache cache cache\n", "topics/bad.md": "---\nid: [\n"}


@pytest.fixture(scope="module")
def store(spark):
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    vectors = [("topics/cache.md", [1.0, 0.0]), ("topics/logs.md", [0.0, 1.0]), ("inbox/new.md", [1.0, 0.1])]
    return Store(records.parse_records(files).cache(), spark.createDataFrame(vectors, "path string, vector array<double>"))


def test_search_by_words(store):
    got = store.search("cache bounded by bytes", mode="fts").collect()
    assert [(r["rank"], r["path"], r["fusion"]) for r in got] == [(1, "topics/cache.md", "fts")]
    assert got[0]["matched_link_id"] == "L2" and got[0]["link_status"] == "active"
    assert store.search("entries", mode="fts").collect() == []
    assert [r["matched_link_id"] for r in store.search("entries", mode="fts", status=["any"]).collect()] == ["L1"]
    assert {r["path"] for r in store.search("cache", mode="fts", include_inbox=True).collect()} == {"topics/cache.md", "inbox/new.md"}
    assert store.search("cache", mode="fts", area=["other"]).collect() == [] and store.search("", mode="fts").collect() == []
    assert {r["path"] for r in store.search("logger printer", decisions_only=True).collect()} == set()


def test_search_hybrid(store):
    got = store.search("cache bytes", query_vector=[1.0, 0.0]).collect()
    assert [(r["path"], r["fusion"]) for r in got] == [("topics/cache.md", "rrf"), ("topics/logs.md", "rrf")]
    assert got[0]["score"] == pytest.approx(2 / 61) and got[1]["score"] == pytest.approx(1 / 62)
    assert [[(c["rank"], c["channel"]) for c in r["contributing"]] for r in got] == [[(1, "fts"), (1, "vector")], [(2, "vector")]]
    assert {c["item"] for c in got[0]["contributing"]} <= {None, "L1", "L2"}
    got = store.search("cache zebra quagga okapi tapir", query_vector=[0.0, 1.0], limit=1).collect()
    assert [(r["path"], r["fusion"]) for r in got] == [("topics/logs.md", "vector")] and [c["channel"] for c in got[0]["contributing"]] == ["vector"]


def test_far_ranks_are_counted(spark, store):
    n = 230
    more = [(f"topics/t{i:03}.md", f"---\nid: T-{i}\ntype: topic\n---\nfiller {'needle' if i == n - 1 else ''}\n".encode()) for i in range(n)]
    s = Store(records.parse_records(spark.createDataFrame(more, "path string, content binary")).cache(), spark.createDataFrame([(p, [1.0, i / n]) for i, (p, _) in enumerate(more)], "path string, vector array<double>"))
    (hit,) = s.search("needle", query_vector=[1.0, 0.0], limit=1).collect()
    assert hit["path"] == f"topics/t{n - 1:03}.md" and hit["score"] == pytest.approx(1 / 61 + 1 / (60 + n))


def test_for_path_and_why(store):
    got = {(r["path"], r["topic_id"], r["via"], r["current"]) for r in store.for_path(["src/cache.py", "lib/a.py", "src/log.py", "x.py"]).collect()}
    assert got == {("src/cache.py", "TOP-001", "direct", "L2"), ("lib/a.py", "TOP-001", "direct", "L2"), ("src/log.py", "TOP-002", "concept", "L1")}
    assert [r["link"] for r in store.why("src/cache.py").collect()] == ["L2", "L1"]
    assert [r["topic_id"] for r in store.why("rotate").collect()] == ["TOP-002"] and store.why("nothing").collect() == []
    got = {r["path"]: r["class"] for r in store.unmapped(["src/cache.py", "src/log.py", "x.py", "y.lock"], F.col("path").endswith(".lock")).collect()}
    assert got == {"src/cache.py": "mapped_topic", "src/log.py": "mapped_concept_only", "x.py": "unmapped", "y.lock": "ignored"}


def test_chain(store):
    got = store.chain("TOP-001").collect()
    assert [r["link"] for r in got] == ["L2", "L1"] and got[0]["broken"] == ["A1"] and got[0]["edges"][0]["to_ref"] == "TOP-002/L1"


def test_check_and_lint(spark, store):
    now = [(p, (t + "x").encode() if "cache" in p else t.encode()) for p, t in FILES.items() if p != "inbox/new.md"] + [("topics/more.md", b"a")]
    drifted, counters = store.check(records.parse_records(spark.createDataFrame(now, "path string, content binary")))
    assert {(r["path"], r["state"]) for r in drifted.collect()} == {("topics/cache.md", "changed"), ("inbox/new.md", "removed"), ("topics/more.md", "added")}
    assert counters.first().asDict() == {"source_topic_count": 2, "searchable_row_count": 7, "searchable_vector_count": 3, "quarantined": 1, "vector_index_state": "partial"}
    found = {(r["path"], r["rule"]) for r in store.lint().collect()}
    assert {("topics/bad.md", "unreadable"), ("topics/logs.md", "owner-ruling"), ("topics/logs.md", "current")} <= found
    assert not {r for p, r in found if p == "topics/cache.md"} - {"kind-enum"}


def test_drift_and_standing(spark, store):
    lines = spark.createDataFrame([("src/a.py", 1, "unbounded_cache()"), ("tests/a.py", 1, "unbounded_cache()")], "path string, line_no int, text string")
    assert [(r["inv_id"], r["state"], r["outside"]) for r in store.drift(lines).collect()] == [("TOP-001/L2", "violation", 1)]
    r = store.standing().first()
    assert r["reason"] is None and r["links"] == 1 and "TOP-001 L2: The cache is bounded by bytes" in r["text"]
    bad = spark.createDataFrame([("topics/c.md", CACHE.replace("standing: [L2]", "standing: [L1]").encode())], "path string, content binary")
    r = Store(records.parse_records(bad)).standing().first()
    assert r["reason"] == "ineligible" and r["text"] is None


def test_lint_of_concepts(spark, store):
    files = spark.createDataFrame([("src/other.py", 10)], "file string, lines int")
    assert ("concepts/log.md", "missing-ref") not in {(r["path"], r["rule"]) for r in store.lint().collect()}
    assert "missing-ref" in {r["rule"] for r in store.lint(files).collect()}


def test_code_search(spark, store):
    row = lambda p, s, n, body: (p, "python", "function", s, s, f"def {s}()", "", n, n + 1, body)
    rows = [row("src/log.py", "rotate", 1, "def rotate(): move()"), row("src/log.py", "rotateAll", 9, "rotate rotate rotate"), row("tests/test_log.py", "test_rotate", 1, "rotate()"), row("src/x.py", "other", 1, "pass"), row("src/y.py", "third", 1, "pass"), ("bad.py", "python", None, None, None, None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "path string, lang string, kind string, symbol string, qualified_name string, signature string, doc string, start_line int, end_line int, body string")
    got = code_search(chunks, "rotate", concept_refs=store.concept_refs).collect()
    assert [(r["rank"], r["symbol"], r["role"], r["concept_id"]) for r in got] == [(1, "rotate", "code", None), (2, "rotateAll", "code", None)]
    assert got[0]["tested_by"] == ["tests/test_log.py"]
    assert [r["symbol"] for r in code_search(chunks, "rotate", role="test").collect()] == ["test_rotate"]
    assert len(code_search(chunks, "rotate", role=None, limit=2).collect()) == 2 and code_search(chunks, "").collect() == []
    vectors = chunks.where("symbol is not null").select("path", "qualified_name", "start_line", F.when(F.col("symbol") == "other", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    got = [r["symbol"] for r in code_search(chunks, "rotate", vectors=vectors, query_vector=[1.0, 0.0], limit=3).collect()]
    assert got[0] == "rotate" and "other" in got and len(got) == 3


def test_stats(spark):
    lines = ["2026-03-01T10:00:00+00:00 nudge outcome=shown session=a elapsed=1", "2026-03-01T11:00:00+00:00 nudge outcome=shown session=b elapsed=3", "2026-01-01T10:00:00+00:00 nudge outcome=shown session=c", "2026-04-01T10:00:00+00:00 nudge outcome=shown session=d", "torn"]
    lines += ["2026-03-01T10:00:00+00:00 code-search outcome=ok hits=4 q=x project=p", "2026-03-01T10:00:00+00:00 outcome=matched elapsed=1s session=a topics=TOP-2,TOP-1,+3 project=p file=f", "2026-03-01T10:00:01+00:00 outcome=matched elapsed=1s session=a topics=TOP-2 project=p file=f"]
    got = stats(spark.createDataFrame([(x, "hook.log") for x in lines], "line string, file_name string"), 7, datetime.datetime(2026, 3, 2, tzinfo=datetime.UTC))
    assert {tuple(r) for r in got["counts"].collect()} == {("nudge", "shown", 2), ("code-search", "ok", 1), ("pre-edit", "matched", 2)}
    assert [tuple(r) for r in got["hits"].collect()] == [(4, 1)] and tuple(got["topics"].first()) == (2, 2)
    assert [tuple(r) for r in got["top_topics"].collect()] == [("TOP-2", 2), ("TOP-1", 1)]
    assert tuple(got["sessions"].first()) == (2, 5) and [tuple(r) for r in got["elapsed"].where("kind = 'nudge'").collect()] == [("nudge", 1.0, 3.0)] and got["untimed"].first()[0] == 1


def test_declined_and_proposals(spark, store):
    text = CACHE.replace("---\nEviction", "- link: L0\n  status: declined\n  ruling: {text: No cache}\n---\nEviction")
    s = Store(records.parse_records(spark.createDataFrame([("topics/c.md", text.encode())], "path string, content binary")))
    assert [r["sentence"] for r in s.declined(["topics/c.md"]).collect()] == ["No cache"] and s.declined(["x"]).collect() == []
    fall = spark.createDataFrame([("s", 1, "/r/src/cache.py", "TOP-001", "h"), ("s", 2, "/r/src/new.py", "TOP-001", "h"), ("z", 3, "/r/free.py", "TOP-001", "h")], "session string, seq int, file string, topic_id string, hook string")
    ledger = spark.createDataFrame([("s", f"/r/{p}", None, "/r", "ab" * 32, 1.0) for p in ("src/cache.py", "src/new.py", "free.py")] + [("s", "/n.md", None, None, "ab", 1.0)], "session string, path string, worktree_path string, root string, content_sha256 string, seen_at double")
    proposals, free = store.propose_bindings(fall, ledger, "s")
    assert [(r["topic_id"], r["path"], r["sha"]) for r in proposals.collect()] == [("TOP-001", "src/new.py", "ab" * 6)] and [r["path"] for r in free.collect()] == ["free.py"]


def test_mark_standing():
    word = {"why": "agreed", "recorded_at": "2026-03-01T09:00:00+01:00", "recorded_by": "me", "authority": "owner-ratified", "source": "s: 1"}
    off = edits.mark_standing(CACHE, "L2", False, **word)
    assert records.parse(off.encode())["standing"] == [] and "action: remove" in off
    on = edits.mark_standing(off, "L2", True, **word)
    assert records.parse(on.encode())["standing"] == ["L2"] and on.index("action: add") < on.index("action: remove")
    assert edits.mark_standing(on, "L2", True, **word) == on
    block = CACHE.replace("standing: [L2]", "standing:\n- L2")
    assert records.parse(edits.mark_standing(block, "L2", False, **word).encode())["standing"] == []
    assert records.parse(edits.mark_standing(CACHE.replace("standing: [L2]\n", ""), "L2", True, **word).encode())["standing"] == ["L2"]
    for link, change in (("L1", {}), ("L7", {}), ("L2", {"authority": "agent-inference"})):
        with pytest.raises(edits.Refused):
            edits.mark_standing(CACHE.replace("standing: [L2]", "standing: []"), link, True, **word | change)
