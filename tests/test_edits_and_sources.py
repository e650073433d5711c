import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerloom import commands
from ledgerloom.operators import edits, patterns, reuse
from ledgerloom.sources import git, records, tables

TEXT = "---\ntype: topic\nid: TOP-1\ncurrent: L1\ncode_refs: [src/a.py]   \nlinks:\n- link: L1\n  status: active   # keep\n  ruling: {text: Old., authority: agent-inference}\n---\nBody ünd more.\n"


def test_append_keeps_the_rest():
    new = edits.append_link(TEXT, 'Use "x": yes', "owner-verbatim", "sitting", "2026-01-01")
    assert edits.link_ids(new) == ["L2", "L1"] and "current: L2\n" in new
    assert TEXT.split("- link: L1")[1] in new
    assert records.parse(new.encode())["links"][0]["ruling_text"] == 'Use "x": yes'


def test_refusals():
    for bad in (dict(ruling="Really?", authority="owner-verbatim"), dict(ruling="x", authority="nobody"), dict(ruling="x", authority="code-derived", reverses="L9", reason="r")):
        with pytest.raises(edits.Refused):
            edits.append_link(TEXT, source="s", date="d", **bad)
    with pytest.raises(edits.Refused):
        edits.unbind(TEXT, "src/none.py")
    with pytest.raises(edits.Refused):
        edits.bind(TEXT, "#x")
    with pytest.raises(edits.Refused):
        edits.append_link("no front matter", "x", "code-derived", "s", "d")


def test_bind_and_undo():
    both = edits.bind(TEXT, "lib/b.py#f")
    assert records.parse(both.encode())["code_refs"] == ["src/a.py", "lib/b.py#f"]
    assert edits.bind(both, "src/a.py") == both
    assert records.parse(edits.unbind(both, "src/a.py").encode())["code_refs"] == ["lib/b.py#f"]


def test_promote():
    new = edits.promote(TEXT, "L1", "sitting", "2026-01-01")
    links = {x["link"]: x for x in records.parse(new.encode())["links"]}
    assert links["L1"]["promoted_by"] == "L2" and links["L2"]["authority"] == "owner-ratified" and links["L2"]["ruling_text"] == "Old."
    with pytest.raises(edits.Refused):
        edits.promote(new, "L1", "s", "d")


def test_write_is_guarded(tmp_path):
    p = tmp_path / "a.md"
    p.write_text(TEXT)
    edits.write(str(p), TEXT, TEXT + "x")
    assert p.read_text() == TEXT + "x"
    with pytest.raises(edits.Refused):
        edits.write(str(p), TEXT, "y")


def test_reuse(spark):
    src = {"own.py": "def job(a, b):\n    'Doc.'\n    c = a + b\n    return c\nWORDS = 1\n", "copy.py": "def other(x, y):\n    z = x + y\n    return z\n", "use.py": "def f():\n    return job(1, 2)\ndef g():\n    return 3\ndef h():\n    return {'a', 'b'}\n", "bad.py": "def ("}
    defs = reuse.definitions(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in src.items()], "path string, content binary"))
    owners = spark.createDataFrame([("J1", "own.py", "job", [])], "id string, path string, symbol string, variants array<string>")
    assert [(r["path"], r["link"]) for r in reuse.exact_copies(defs, owners).collect()] == [("copy.py", "other")]
    use = spark.createDataFrame([("use.py", "f", "job"), ("use.py", "g", "job")], "path string, symbol string, owner string")
    assert [r["link"] for r in reuse.undelegated(defs, use).collect()] == ["g"]
    words = spark.createDataFrame([("V", "own.py", ["b", "a"])], "id string, path string, vocabulary array<string>")
    assert [r["link"] for r in reuse.vocabulary_copies(defs, words).collect()] == ["h"]
    rows = spark.createDataFrame([("J1", 0, ["src"]), ("J2", 1, ["lib/*.py"]), ("J3", 2, ["doc"])], "id string, ord int, related_paths array<string>")
    assert [r["id"] for r in reuse.jobs_for(rows, spark.createDataFrame([("lib/a.py",), ("src/b.py",)], "path string")).collect()] == ["J1", "J2"]


def test_constructs_and_bypasses(spark, monkeypatch):
    src = {"own.py": "def job():\n    def inner():\n        return open('x')\n    return inner\n", "a.py": "def f():\n    return open('y')\ndef g():\n    'open(x)'  # open(x)\n    return 1\n", "b/c.py": "class K:\n    def m(self):\n        return open('z')\n"}
    defs = reuse.definitions(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in src.items()], "path string, content binary"))
    kind = "id string, path string, symbol string, pattern string, paths array<string>"
    owners = spark.createDataFrame([("J1", "own.py", "inner", r"open\(", None), ("J2", "own.py", "job", r"open\(", ["b/"]), ("J3", "own.py", "job", "close", [])], kind)
    want = [("a.py", "f", "construct", "J1"), ("b/c.py", "m", "construct", "J1"), ("b/c.py", "m", "construct", "J2"), ("own.py", "job", "construct-stale", "J2"), ("own.py", "job", "construct-stale", "J3")]
    for few in (1, 100):
        monkeypatch.setattr(patterns, "FEW", few)
        assert sorted((r["path"], r["link"], r["rule"], r["message"].split()[-1]) for r in reuse.construct_owners(defs, owners).collect()) == want
    use = spark.createDataFrame([("a.py", "f", "job", [r"open\("]), ("a.py", "g", "job", [r"open\("]), ("b/c.py", "m", "job", [])], "path string, symbol string, owner string, forbid array<string>")
    assert [(r["path"], r["link"]) for r in reuse.bypasses(defs, use).collect()] == [("a.py", "f")]


def test_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("k\td\t2026-01-01\ta=x%20y b=1%25\n")
    assert tables.read_registry(spark, str(tmp_path / "r.tsv")).first()["note"] == {"a": "x y", "b": "1%"}
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q", "kind": "path", "query": "x", "expect": ["a"]}) + "\n")
    assert tables.read_queries(spark, str(tmp_path / "q.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps({"id": "q", "kind": "odd", "query": "x", "expect": ["a"]}) + "\n")
    with pytest.raises(Exception, match="bad benchmark row"):
        tables.read_queries(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "t.md").write_text("x\nid: TOP-5\n")
    (tmp_path / "u.md").write_text("x\n")
    assert {r["id"] for r in tables.read_corpus(spark, str(tmp_path / "*.md")).collect()} == {"TOP-5", "u"}
    (tmp_path / "inv.json").write_text(json.dumps({"schema_version": 1, "rows": [{"id": "J1", "related_paths": ["a"]}]}))
    assert tables.read_inventory(spark, str(tmp_path / "inv.json")).first()["id"] == "J1"
    (tmp_path / "tr.jsonl").write_text('{"type":"user","message":{"content":"hi"}}\n{"type":"user","isMeta":true,"message":{"content":"no"}}\n')
    assert [r["text"] for r in tables.read_transcripts(spark, str(tmp_path / "tr.jsonl")).collect()] == ["hi"]


def test_git_sides(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text(TEXT)
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.md").write_text(TEXT.replace("Old.", "New."))
    (tmp_path / "b.md").write_text("new")
    sides = tables.read_git(spark, str(tmp_path))
    assert {(r["side"], r["path"]) for r in sides.collect()} == {("old", "a.md"), ("new", "a.md")}
    from ledgerloom.operators import lint

    old, new = (records.links(records.parse_records(sides.where(F.col("side") == s))) for s in ("old", "new"))
    assert {r["rule"] for r in lint.history(old, new, ["ruling_text"]).collect()} == {"body-frozen"}
    assert {(r["code"], r["path"]) for r in tables.tree_status(spark, str(tmp_path)).collect()} == {(" M", "a.md"), ("??", "b.md")}


def _repository(at):
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    return run


def test_git_source_reads_in_partitions(spark, tmp_path):
    """Many files over many partitions: odd names, empty and binary content, links, deletions, both kinds of new side."""
    run = _repository(tmp_path)
    for i in range(20):
        (tmp_path / f"f{i}.md").write_bytes(f"old {i}\n".encode())
    (tmp_path / "gone.md").write_text("x")
    (tmp_path / "two words \n.md").write_text("odd")
    os.symlink("f0.md", tmp_path / "link.md")
    run("add", ".")
    run("commit", "-qm", "x")
    for i in range(0, 20, 2):
        (tmp_path / f"f{i}.md").write_bytes(b"" if i == 4 else bytes(range(256)) + str(i).encode())
    (tmp_path / "gone.md").unlink()
    (tmp_path / "two words \n.md").write_text("new")
    (tmp_path / "link.md").unlink()
    os.symlink("f1.md", tmp_path / "link.md")
    sides = git.read_sides(spark, str(tmp_path), files=3)
    assert sides.rdd.getNumPartitions() == 5
    got = {(r["side"], r["path"]): (r["change"], bytes(r["content"])) for r in sides.collect()}
    assert len(got) == 25 and got["old", "gone.md"] == ("D", b"x") and ("new", "gone.md") not in got
    assert got["new", "f4.md"] == ("M", b"") and got["new", "f6.md"][1] == bytes(range(256)) + b"6" and got["old", "f6.md"][1] == b"old 6\n"
    assert got["new", "two words \n.md"][1] == b"new" and got["old", "link.md"][1] == b"f0.md" and got["new", "link.md"][1] == b"f1.md"
    run("add", "f6.md")
    (tmp_path / "f6.md").write_text("later")
    staged = {(r["side"], r["path"]): bytes(r["content"]) for r in git.read_sides(spark, str(tmp_path), staged=True).collect()}
    assert staged == {("old", "f6.md"): b"old 6\n", ("new", "f6.md"): bytes(range(256)) + b"6"}
    with pytest.raises(Exception, match="no revision"):
        git.read_sides(spark, str(tmp_path), "--output=x").collect()
    run("add", ".")
    run("commit", "-qm", "y")
    assert git.read_sides(spark, str(tmp_path)).count() == 0


def test_git_heads_as_a_stream(spark, tmp_path):
    at = tmp_path / "r"
    at.mkdir()
    run = _repository(at)
    out, seen = str(tmp_path / "out"), str(tmp_path / "cp")

    def pull():
        q = git.stream_heads(spark, [str(at), str(tmp_path / "none")]).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return {(r["before"] is None, r["path"], r["complete"]) for r in spark.read.parquet(out).collect()}

    (at / "a.md").write_text("a")
    run("add", ".")
    run("commit", "-qm", "x")
    assert pull() == {(True, None, True)}
    (at / "b.md").write_text("b")
    (at / "a.md").write_text("A")
    run("add", ".")
    run("commit", "-qm", "y")
    assert pull() == {(True, None, True), (False, "a.md", True), (False, "b.md", True)}
    assert len(pull()) == 3


def test_append_only_rules_over_git(spark, tmp_path):
    """Refused, repaired and recovered records, frozen links, raw text, types, `current` and deletions over one diff."""
    run = _repository(tmp_path)
    bad = "---\ntype: topic\nid: [x\n---\n"
    old = {"ok": TEXT, "body": TEXT, "raw": TEXT, "gone": TEXT, "type": TEXT, "cur": TEXT, "lost": bad, "broken": TEXT,
           "part": TEXT.replace("id: TOP-1", "id: TOP-1\ntags: no-list"), "none": "---\ntype: topic\nlinks: no\n---\n", "both": bad}
    for k, v in old.items():
        (tmp_path / f"{k}.md").write_text(v)
    run("add", ".")
    run("commit", "-qm", "x")
    new = old | {"ok": TEXT + "More.", "body": TEXT.replace("Old.", "New."), "raw": TEXT.replace("# keep", "# kept"), "type": TEXT.replace("type: topic", "type: incident"), "cur": TEXT.replace("current: L1", "current: L7"),
                 "lost": TEXT, "broken": bad, "part": TEXT.replace("Old.", "New."), "none": TEXT, "both": bad + "."}
    for k, v in new.items():
        (tmp_path / f"{k}.md").write_text(v)
    (tmp_path / "gone.md").unlink()
    got = {(r["path"][:-3], r["rule"], r["severity"]) for r in commands.against(git.read_sides(spark, str(tmp_path))).collect()}
    assert got == {
        ("body", "body-frozen", "error"), ("raw", "raw-changed", "error"), ("gone", "record-deleted", "error"), ("type", "type-change", "error"), ("cur", "current-head", "error"), ("cur", "current-moved", "error"),
        ("lost", "repaired", "note"), ("broken", "unreadable", "error"), ("both", "unreadable", "error"), ("part", "recovered", "note"), ("part", "body-frozen", "error"), ("none", "no-history", "note"),
    }
