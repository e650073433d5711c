"""The published index: whole versions only, conflicts, damage, reindexing; and the store on top: parsed once, fresh vectors only."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.commands import Store
from ledgerloom.operators import freshness
from ledgerloom.sources import index, records

GOOD = "---\nid: TOP-{0}\ntype: topic\ntitle: T{0}\nstatus: active\ncode_refs: [src/{0}.py]\nlinks:\n- link: L1\n  date: 2026-01-01\n  status: active\n  ruling: {{text: Use {0}, authority: owner-verbatim, source: s}}\n---\nBody {0}\n"


def files_of(spark, rows):
    return spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows.items()], "path string, content binary")


ROWS = {f"topics/t{i}.md": GOOD.format(i) for i in range(6)} | {"topics/bad.md": "---\nlinks: [\n---\n"}


def outcome(df):
    return {r["path"]: r["outcome"] for r in df.collect()}


def test_records_are_parsed_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    """publish() computes its records once, though it writes two tables of them; files of one partition are parsed in many tasks."""
    monkeypatch.setattr(records, "PARSE_ROWS", 20)
    rows = ROWS | {f"notes/{i}.md": f"note {i}" for i in range(193)}
    files = files_of(spark, rows).coalesce(1)
    parsed = records.parse_records(files)
    assert parsed.rdd.getNumPartitions() == 10
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    at = str(tmp_path / "ix")
    index.publish(parsed.mapInPandas(count, parsed.schema), at)
    assert seen.value == len(rows) == 200
    assert index.read(spark, at).count() == 199 and index.read(spark, at, "index_errors").count() == 1
    assert os.listdir(f"{at}/versions") and all(sorted(os.listdir(f"{at}/versions/{v}")) == ["index_errors", "records"] for v in os.listdir(f"{at}/versions"))


def test_reindex_parses_what_changed(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "ix")
    assert index.current(spark, at) is None
    with pytest.raises(FileNotFoundError):
        index.read(spark, at)
    assert outcome(index.reindex(files_of(spark, ROWS), at)) == {p: "quarantined" if "bad" in p else "parsed" for p in ROWS}
    later = {p: c for p, c in ROWS.items() if p != "topics/t0.md"} | {"topics/t1.md": GOOD.format(11), "topics/new.md": GOOD.format(9)}
    seen, plain = [], records.parse_records
    monkeypatch.setattr(records, "parse_records", lambda f: seen.append(sorted(r["path"] for r in f.collect())) or plain(f))
    assert outcome(index.reindex(files_of(spark, later), at)) == {"topics/t0.md": "dropped", "topics/t1.md": "parsed", "topics/new.md": "parsed", "topics/bad.md": "quarantined"} | {f"topics/t{i}.md": "kept" for i in (2, 3, 4, 5)}
    assert seen[-1] == ["topics/bad.md", "topics/new.md", "topics/t1.md"]
    assert index.current(spark, at)[0] == 2 and {r["id"] for r in index.read(spark, at).collect()} == {"TOP-11", "TOP-2", "TOP-3", "TOP-4", "TOP-5", "TOP-9"}
    assert [r["path"] for r in index.read(spark, at, "index_errors").collect()] == ["topics/bad.md"]
    assert set(outcome(index.reindex(files_of(spark, later), at, full=True)).values()) == {"parsed", "quarantined"}
    assert set(outcome(index.reindex(files_of(spark, {}), at)).values()) == {"dropped"} and index.read(spark, at).count() == 0


def test_a_killed_write_leaves_the_old_index(spark, tmp_path):
    at = str(tmp_path / "ix")
    parsed = records.parse_records(files_of(spark, ROWS))
    assert index.publish(parsed, at) == 1
    parsed.limit(1).write.parquet(f"{at}/versions/half/records")  # killed before it was named
    (tmp_path / "ix" / "manifests" / "00000002.json").write_text('{"body": {"at": "' + at + '/versions/half"')  # and while it was
    assert index.current(spark, at)[0] == 1 and index.read(spark, at).count() == 6
    (tmp_path / "ix" / "manifests" / "00000003.json").write_text('{"body": {"at": "x", "tables": {}}, "sha256": "0"}')
    assert index.current(spark, at)[0] == 1
    assert index.publish(parsed.limit(2), at) == 4 and index.current(spark, at)[0] == 4


def test_one_of_two_writers_wins(spark, tmp_path):
    at = str(tmp_path / "ix")
    parsed = records.parse_records(files_of(spark, ROWS))
    assert index.publish(parsed, at, base=0) == 1
    with pytest.raises(index.Conflict):
        index.publish(parsed.limit(1), at, base=0)
    assert index.read(spark, at).count() == 6


def test_damage_is_no_empty_index(spark, tmp_path):
    at = str(tmp_path / "ix")
    parsed = records.parse_records(files_of(spark, ROWS))
    index.publish(parsed, at)
    table = index.current(spark, at)[1]["at"] + "/records"
    part = next(f for f in os.listdir(table) if f.startswith("part-"))
    os.remove(f"{table}/{part}")
    with pytest.raises(index.Damaged):
        index.read(spark, at)
    with pytest.raises(index.Damaged):
        index.publish(parsed.union(parsed), at)
    assert index.current(spark, at)[0] == 1


def test_embedding_in_batches(spark):
    rows = spark.range(300).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("s").alias("sha256"), F.when(F.col("id") != 7, F.concat(F.lit("t"), "id")).alias("text")).coalesce(1)
    got = index.embedded(rows, "m1", lambda texts: [[float(len(texts)), float(len(t))] for t in texts]).collect()
    assert len(got) == 300 and {r["vector"][0] for r in got} == {128.0, 44.0} and {r["embed_fp"] for r in got} == {"m1"}
    assert {r["path"]: r["vector"][1] for r in got}["p7"] == 0.0
    with pytest.raises(Exception, match="0 vectors for 128 texts"):
        index.embedded(rows, "m1", lambda texts: []).collect()


def test_store_parses_once(spark):
    s = Store(records.parse_records(files_of(spark, ROWS)))
    for out in (s.lint(), s.for_path(["src/1.py"]), s.chain(), s.search("use", limit=3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan
    assert {r["rule"] for r in s.lint().collect()} == {"unreadable"}


def test_store_counts_and_ranks_fresh_vectors_only(spark):
    parsed = records.parse_records(files_of(spark, ROWS))
    sha = lambda i: hashlib.sha256(f"T{i}\nBody {i}\n".encode()).hexdigest()
    rows = [(f"topics/t{i}.md", sha(i), "m1", [1.0, i / 10]) for i in range(3)]
    rows += [("topics/t3.md", "0" * 64, "m1", [1.0, 0.0]), ("topics/t4.md", sha(4), "m0", [1.0, 0.0]), ("topics/t5.md", sha(5), "m1", [1.0])]  # an old text, another model, another dimension
    vectors = spark.createDataFrame(rows, "path string, embed_sha string, embed_fp string, vector array<double>")
    with pytest.raises(ValueError, match="fingerprint"):
        Store(parsed, vectors)
    s = Store(parsed, vectors, "m1", 2)
    assert {r["path"] for r in s.rows.select("path", "sha256").join(vectors.where("embed_fp = 'm1'").select("path", F.col("embed_sha").alias("sha256")), ["path", "sha256"]).collect()} == {f"topics/t{i}.md" for i in (0, 1, 2, 5)}
    assert [r["path"] for r in s.search("x", mode="vector", query_vector=[1.0, 0.0], limit=9).collect()] == ["topics/t0.md", "topics/t1.md", "topics/t2.md"]
    counters = s.check(s.records.select("path", "sha256"))[1].first()
    assert counters["searchable_vector_count"] == 3 and counters["vector_index_state"] == "partial"
    assert freshness.awaiting(s.rows.select("path", "sha256"), vectors, "m1", 2).count() == s.rows.count() - 3


def test_lint_reads_citations_and_marks_of_the_code(spark):
    text = GOOD.format(1).replace("Use 1", "See src/a.py:7 and src/gone.py:3").replace("src/1.py", "src/a.py#f")
    s = Store(records.parse_records(files_of(spark, {"topics/t1.md": text})))
    files = spark.createDataFrame([("src/a.py", 5)], "file string, lines int")
    marks = spark.createDataFrame([("src/b.py", "TOP-9", "L1")], "path string, topic string, link string")
    got = {(r["path"], r["rule"], r["severity"]) for r in s.lint(files, marks, strict=True).collect()}
    assert got == {("topics/t1.md", "citation-line", "error"), ("topics/t1.md", "citation-file", "error"), ("src/b.py", "marker-unknown", "error"), ("src/a.py", "marker-missing", "warning")}
