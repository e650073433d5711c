"""The inverted index against scans, patterns against the plain join with their expressions, products of blocks against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values
from ledgerloom.operators import patterns, postings, rank
from ledgerloom.session import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    voc = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(r.choices(voc, [1 / (k + 1) for k in range(60)], k=r.choice([0, 1, 3, 10, 40, 200])))) for i in range(700)]
    rows += [(1000, None), (1001, ""), (1002, "only once here"), (1003, "w1 " * 500), (1004, "é W1-w2_w3")]
    return spark.createDataFrame(rows, "id long, text string").repartition(6)


QUERIES = [["w1"], ["w3", "w50", "w3"], ["nothing"], ["once", "w0", "nothing"], [f"w{k}" for k in range(20)], []]


@pytest.mark.parametrize("block", [20, 5000])
def test_index_gives_the_rows_of_a_scan(spark, corpus, monkeypatch, block):
    path = scratch(spark, "index")
    postings.build(corpus, "id", F.col("text"), path, block=block, buckets=4)
    ix = postings.Index(spark, path)
    assert ix.n == corpus.count()
    keep = corpus.where("id % 3 <> 0").select(F.col("id").alias("key"))
    six = lambda rows: {r[0]: round(r[1], 15) for r in rows}
    for q in QUERIES:
        want = six(rank.bm25(corpus.fillna(""), "id", F.col("text"), q).collect()) if q else {}
        assert six(ix.bm25(q).collect()) == pytest.approx(want)
        assert six(ix.tfidf(q).collect()) == pytest.approx(six(rank.tfidf(corpus.fillna(""), "id", F.col("text"), q).collect()) if q else {})
        for most, only in ((0, None), (1 << 20, None), (0, keep)):  # blocks are left out, or none is
            monkeypatch.setattr(postings, "PLAIN", most)
            best = sorted(((-s, i) for i, s in want.items() if only is None or i % 3), key=lambda x: (round(x[0], 14), x[1]))[:7]
            assert [r["key"] for r in ix.bm25_top(q, 7, only).collect()] == [i for _, i in best], (q, most)


def test_a_search_reads_the_blocks_that_can_still_win(spark, corpus, monkeypatch):
    """Of the blocks that hold a common term, most are not read for the best document."""
    path = scratch(spark, "index")
    postings.build(corpus, "id", F.col("text"), path, block=5, buckets=4)
    ix = postings.Index(spark, path)
    seen, plain = [], ix._bm25
    monkeypatch.setattr(postings, "PLAIN", 0)
    monkeypatch.setattr(ix, "_bm25", lambda rows, weight: seen.append(rows.count()) or plain(rows, weight))
    ix.bm25_top(["w40"], 1).collect()
    assert seen[0] <= 4 and seen[1] < ix._of(ix._postings, ["w40"]).count()


def test_index_of_files_is_made_anew_when_they_change(spark, tmp_path):
    at = str(tmp_path / "t")
    make = lambda text, mode: spark.createDataFrame([(1, text)], "id long, text string").write.mode(mode).parquet(at)
    make("alpha", "overwrite")
    one = postings.of_files(spark.read.parquet(at), "id", "text")
    assert one is postings.of_files(spark.read.parquet(at), "id", "text") and one.frequencies(["alpha", "beta"]) == {"alpha": 1}
    make("beta", "overwrite")
    assert postings.of_files(spark.read.parquet(at), "id", "text").frequencies(["alpha", "beta"]) == {"beta": 1}


def test_index_of_nothing(spark):
    path = scratch(spark, "index")
    postings.build(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), path)
    ix = postings.Index(spark, path)
    assert ix.n == 0 and ix.bm25(["a"]).collect() == [] and ix.bm25_top(["a"], 3).collect() == []


def test_tokens_are_those_of_the_expressions(spark):
    texts = ["", None, "  ", "Ab-c_9 ÀÉ x", "a", "-a-", "ß½ 語 word"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f, p in ((X.tokens, "[a-z0-9]+"), (X.record_tokens, r"[\p{L}\p{N}]+"), (X.code_tokens, r"[\p{L}\p{N}_]+")):
        folded = F.lower("t") if f is X.tokens else F.translate(F.lower("t"), X._ACCENTED[: len(X._FOLDED)], X._FOLDED)
        assert df.where(~f(F.col("t")).eqNullSafe(F.regexp_extract_all(folded, F.lit(p), F.lit(0)))).collect() == []


# --- patterns ---
@pytest.mark.parametrize(
    ("pattern", "want"),
    [("ERROR|error", ["ERROR", "error"]), ("the ", ["the "]), ("^PROMO", ["PROMO"]), (r"open\(", ["open("]), ("ab", None), ("abc|x", None), ("(?i)error", None), ("abcd*", ["abc"]), ("abcd?ef", ["abc"]), ("abc+d", ["abc"]), ("abcx{0,3}", ["abc"]), ("(foo|bar)bazz", ["bazz"]), ("[abc]defg", ["defg"]), (r"\Qa.c\E", None), (r"\bword\b", ["word"]), ("[a[bc]]def", None), ("a.cdef", ["cdef"]), ("", None), ("(?=abc)def", None), ("(?:abc)?defg", ["defg"]), (r"x\.y\.z", ["x.y.z"]), ("(abc", None), (r"a\|bcd", ["a|bcd"])],
)
def test_required_literals(pattern, want):
    assert patterns.required(pattern) == want


def test_required_literals_are_in_every_match():
    r = random.Random(9)
    bits = ["a", "b", "ab", "abc", "cab", ".", "[ab]", "[^c]", "(ab|c)", "(?:b|ca)", "a*", "b+", "c?", "a{2}", "(abc)*", "|", r"\.", r"\w", "^", "$"]
    told = 0
    for _ in range(4000):
        p = "".join(r.choice(bits) for _ in range(r.randrange(1, 7)))
        try:
            found = re.compile(p)
        except re.error:
            continue
        need = patterns.required(p, 2)
        for _ in range(6):
            t = "".join(r.choice("abc.") for _ in range(r.randrange(0, 12)))
            if need is not None and found.search(t):
                told += 1
                assert any(x in t for x in need), (p, t)
    assert told > 200


@pytest.mark.parametrize("few", [2, 1000])
def test_patterns_join_gives_each_pair_once(spark, monkeypatch, few):
    monkeypatch.setattr(patterns, "FEW", few)
    monkeypatch.setattr(patterns, "BLOCK", few)
    r = random.Random(2)
    lines = [(i, "".join(r.choice("abcde \n") for _ in range(r.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "é語abc語"), (902, "é語abc語"), (903, "abcabcabc")]
    exprs = ["abc", "abc|cab", "bca|abc|cab", "a.c", "^ab", "[0-9]", "d+e", "語abc", "zzz", "a b", "", "(?i)ABC", "(ab|cd)eab", None, "abc", r"\s\sa"]
    texts, some = spark.createDataFrame(lines, "k int, text string").repartition(4), spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "p int, regex string")
    want = sorted((x["k"], x["p"]) for x in texts.crossJoin(some).where(F.rlike(F.col("text"), F.col("regex"))).collect())
    got = patterns.matched(texts, "text", some, "regex")
    assert got.columns == ["k", "text", "p", "regex"] and sorted((x["k"], x["p"]) for x in got.collect()) == want
    none = spark.createDataFrame([], "p int, regex string")
    assert patterns.matched(texts, "text", none, "regex").collect() == [] and patterns.matched(texts.where("false"), "text", some, "regex").collect() == []


@pytest.mark.parametrize(("few", "least"), [(1, 3), (100, 1)])
def test_patterns_with_literals_need_no_pairs_of_all_with_all(spark, monkeypatch, few, least):
    monkeypatch.setattr(patterns, "FEW", few)
    texts = spark.range(1000).select(F.concat(F.lit("line "), "id").alias("text"))
    some = spark.createDataFrame([("line 7$",), ("ine [0-9]5",)], "regex string")
    got = patterns.matched(texts, "text", some, "regex", least=least)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == texts.where("text rlike 'line 7$'").count() + texts.where("text rlike 'ine [0-9]5'").count()


# --- vectors ---
@pytest.mark.parametrize("block", [7, 256])
def test_nearest_of_each_equals_all_pairs(spark, block):
    r = random.Random(6)
    rows = [(i, [round(r.uniform(-1, 1), 1) for _ in range(3)]) for i in range(120)]
    rows += [(200, [0.0, 0.0, 0.0]), (201, None), (202, [1.0, None, 0.0]), (203, [float("nan"), 0.0, 1.0]), (204, [1.0, 2.0]), (205, []), (10, rows[10][1]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").dropDuplicates(["id"])
    a, b = df.alias("a"), df.where("id % 4 = 0").alias("b")
    both = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("b.id").alias("q"), F.col("a.id").alias("id"), F.round(values.cosine(F.col("a.v"), F.col("b.v")), 9).alias("s")).where("s is not null")
    want = {}
    for x in sorted(both.collect(), key=lambda x: (x["q"], -x["s"], x["id"])):
        want.setdefault(x["q"], []).append(x["id"])
    got = {}
    found = rank.nearest_of_each(df, "id", "v", F.col("id") % 4 == 0, 5, block)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for x in sorted(found.collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["id"])
    assert got == {q: ids[:5] for q, ids in want.items()}


def test_a_build_shuffles_documents_and_lists(spark, tmp_path):
    """Rows that are shuffled number as the documents and the lists of (term, block), not as the postings."""
    spark.range(300).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), i))).alias("text")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = written()
    path = scratch(spark, "index")
    postings.build(docs, "id", F.col("text"), path, block=300)
    assert written() - before < 5000  # of 60,000 postings
    assert spark.read.parquet(f"{path}/postings").agg(F.sum("n")).first()[0] == 60000


def test_an_index_of_odd_documents(spark):
    """Null and empty texts, keys that are strings, letters that are no tokens."""
    rows = [("b", "x y x"), ("a", "y"), ("c", None), ("d", ""), ("e", "z é")]
    path = scratch(spark, "index")
    postings.build(spark.createDataFrame(rows, "id string, text string"), "id", F.col("text"), path)
    got = {(r["term"], tuple(r["keys"]), tuple(r["tfs"]), tuple(r["lengths"])) for r in spark.read.parquet(f"{path}/postings").collect()}
    assert got == {("x", ("b",), (2,), (3,)), ("y", ("a", "b"), (1, 1), (1, 3)), ("z", ("e",), (1,), (1,))}
    assert postings.Index(spark, path).n == 5


def test_blocks_of_vectors_meet_in_groups_of_their_own(spark):
    """One turn of queries and four blocks: their products are made in four groups, not in the one task of the turn; copies tie by their keys over blocks."""
    df = spark.range(1000).select("id", F.array(F.lit(1.0), (F.col("id") % 10).cast("double")).alias("v"))
    found = rank.nearest_of_each(df, "id", "v", F.col("id") % 500 == 0, 3, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "block#" in plan and "turn#" in plan
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()) == [(0, 1, 10, 1.0), (0, 2, 20, 1.0), (0, 3, 30, 1.0), (500, 1, 0, 1.0), (500, 2, 10, 1.0), (500, 3, 20, 1.0)]
