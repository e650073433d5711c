from pyspark.sql import functions as F

from ledgerloom.operators import code_links


def test_prose_keeps_places(spark):
    text = "a `code` b\n```py\nx = 1\n```\n~~~~\n```\n~~~~\nend ``a`b`` z"
    out = code_links.blanked(text)
    assert [len(x) for x in out.split("\n")] == [len(x) for x in text.split("\n")]
    assert out.split() == ["a", "b", "end", "z"]
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(code_links.prose(F.col("t"))).collect()] == [out, None]


def test_link_spans():
    text = "---\nid: T\nlinks:\n  - link: L2\n    status: active\n    # note\n    alternatives:\n    - {option: x}\n  - status: old\n    link: L1\ntags: [a]\n---\nbody\n"
    spans = code_links.link_spans(text)
    assert list(spans) == ["L2", "L1"] and spans["L2"].endswith("- {option: x}") and spans["L1"] == "  - status: old\n    link: L1"
    assert code_links.link_spans("no links") == {}


def test_tested_by(spark):
    hits = spark.createDataFrame([("parseThing",), ("main",), ("abc",), ("other",)], "symbol string")
    tests = spark.createDataFrame([(f"t{i}.py", "x parseThing(1) main abc") for i in range(5)], "path string, text string")
    got = {r["symbol"]: r["tested_by"] for r in code_links.tested_by(hits, tests).collect()}
    assert got == {"parseThing": ["t0.py", "t1.py", "t2.py"], "main": [], "abc": [], "other": []}


def test_tested_by_of_any_symbol_and_order(spark):
    """A symbol that is skipped by default is found where nothing is to be skipped; numbers stand in their own order."""
    hits = spark.createDataFrame([("test",), ("rest",)], "symbol string")
    tests = spark.createDataFrame([(n, "x test") for n in (1000000000, 9, 200000000, 7)], "path long, text string")
    got = {r["symbol"]: r["tested_by"] for r in code_links.tested_by(hits, tests, skipped=[]).collect()}
    assert got == {"test": [7, 9, 200000000], "rest": []}


def test_tested_by_query_keeps_skipped_symbols(spark, tmp_path):
    from ledgerloom.plans import catalog

    spark.createDataFrame([(1, "test main"), (200000000, "a test"), (1000000000, "test")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["symbol"], r["tests"]) for r in catalog.queries()["tested_by"](spark, str(tmp_path)).collect()}
    assert got == {("test", "00000001 1000000000 200000000"), ("main", "00000001")}


def test_wrappers_go(spark):
    rows = [("a", "function", "f", 1, 9, True), ("a", "function", "f", 2, 8, False), ("a", "function", "g", 1, 9, True), ("b", "function", "f", 1, 9, False), ("b", "function", "f", 2, 3, False)]
    df = spark.createDataFrame(rows, "path string, kind string, qualified_name string, start_line int, end_line int, wrapper boolean")
    assert sorted((r["path"], r["qualified_name"], r["start_line"]) for r in code_links.without_wrappers(df).collect()) == [("a", "f", 2), ("a", "g", 1), ("b", "f", 1), ("b", "f", 2)]
