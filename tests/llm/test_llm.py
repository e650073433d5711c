import base64
import collections
import hashlib
import math
import os
import random
import re
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm import common, decontam, entries, langid, lm, mixing, neardup, pii, quality, substring, tokens, topk

SF = "/root/testdata/sf0.001"
need = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- near-duplicates ---
def brute_near(rows, k, s):
    sets = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            w = t.encode().lower().split() if t else []
            sets[i] |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= s * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize(("k", "s"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, s):
    got = neardup.near_duplicates(docs, k, s / 100).collect()
    assert len(got) == docs.count()
    want = brute_near(pairs_of(docs), k, s)
    assert {r[0]: tuple(r[1:]) for r in got if r[0] is not None} == want
    assert [tuple(r[2:]) for r in got if r[0] is None] == [(None, True)]


def test_near_duplicates_of_a_large_loose_group(spark):
    """Near copies that differ from each other by more than the threshold, some linked through others."""
    r = random.Random(3)
    voc = [f"w{i}" for i in range(2000)]
    base = [r.choice(voc) for _ in range(100)]
    rows = []
    for i in range(300):
        b = list(base)
        for _ in range(r.randrange(0, 8)):
            b[r.randrange(100)] = r.choice(voc)
        rows.append((i, " ".join(b)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == brute_near(rows, 3, 85)


def template_family(n, changed=5):
    """Copies of one text of 300 words with some words changed each: with five, a few of a hundred pairs are over 0.85; with four, most."""
    r = random.Random(12)
    base = [f"t{r.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        b = list(base)
        for at in r.sample(range(300), changed):
            b[at] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(b)))
    return rows


def test_near_duplicates_of_a_template_family(spark):
    """Hardly any pair of a family is linked, and all may be."""
    rows = template_family(150)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == brute_near(rows, 3, 85)


def test_a_template_family_costs_its_size(spark, monkeypatch):
    """Pairs that are confirmed grow with the family and not with its square."""
    seen, plain = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    rows = template_family(1000, 4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(seen) < 1000 * 999 / 2 / 10, seen


def test_near_duplicates_of_ids_with_several_texts(spark):
    """brute_near over rows with ids of their own, which are then united by doc_id."""
    r = random.Random(8)
    words = {x: [f"{x}{r.randrange(900)}" for _ in range(80)] for x in "abcdef"}
    full = {x: " ".join(w) for x, w in words.items()}
    near = {x: " ".join([*w[:-1], "other"]) for x, w in words.items()}
    rows = [(3, full["a"]), (5, full["a"]), (5, full["b"]), (9, near["b"])]  # a link through a text whose doc_id is a later copy elsewhere
    rows += [(20, full["c"]), (21, full["c"]), (21, full["d"]), (22, full["d"]), (23, near["d"])]  # a class whose first document is a later copy
    rows += [(30, full["e"]), (30, full["f"]), (31, near["f"]), (31, ""), (32, None), (40, "alone here"), (40, "alone here")]
    rows += [(None, full["a"]), (None, None)]
    of = {i: (row if row[0] is not None else None) for i, row in enumerate(rows)}
    alone = brute_near([(i, row[1]) for i, row in of.items() if row], 3, 85)
    label = {i: v[1] for i, v in alone.items()}
    for _ in rows:
        for i, j in ((i, j) for i in label for j in label if rows[i][0] == rows[j][0] and label[i] != label[j]):
            label = {x: min(label[i], label[j]) if v in (label[i], label[j]) else v for x, v in label.items()}
    first = {c: min(rows[i][0] for i in label if label[i] == c) for c in label.values()}
    want = [(rows[i][0], alone[i][0], first[c], rows[i][0] == first[c]) for i, c in label.items()] + [(None, 78, None, True), (None, 0, None, True)]
    assert {w[0]: w[2] for w in want if w[0]} == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20, 30: 30, 31: 30, 32: 32, 40: 40}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 0.85).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_duplicates_empty(empty):
    assert neardup.near_duplicates(empty).collect() == []


def test_one_of_each_group_stays(docs):
    left = neardup.drop_near_duplicates(docs)
    want = {i for i, v in brute_near(pairs_of(docs), 5, 80).items() if v[2]}
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


# --- substring ---
def brute_substring(rows, window=20):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = t.encode().split() if t else []
        gone = [False] * len(w)
        own = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in own or first.setdefault(key, i) < i:
                gone[k : k + window] = [True] * window
            own.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 20, 31])
def test_substring(docs, window):
    got = substring.repeated_passages(docs, window).collect()
    assert len(got) == docs.count()
    assert sorted(tuple(r) for r in got if r[0] is not None) == brute_substring(pairs_of(docs), window)
    assert all(r["n_removed"] == 0 for r in got if r[0] is None)


def test_substring_random_overlaps(spark):
    r = random.Random(9)
    pieces = [[f"p{i}_{j}" for j in range(r.randrange(18, 45))] for i in range(12)]
    rows = [(i, " ".join(x for _ in range(6) for x in r.choice(pieces)[r.randrange(6) :])) for i in range(60)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, got)) == brute_substring(rows)


def test_substring_tasks_follow_the_input(docs, monkeypatch):
    """However few partitions are set for shuffles, a task sorts texts and entries of a bounded size; texts are shuffled once."""
    spark, few = docs.sparkSession, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(substring, "TASK_WORDS", 4000)
    monkeypatch.setattr(substring, "BUCKET_WORDS", 1000)
    monkeypatch.setattr(substring, "TASK_BUCKETS", 5)
    was = spark.conf.get(few)
    spark.conf.set(few, "2")
    try:
        out = substring.repeated_passages(docs)
        words = sum(len((r[0] or "").split()) for r in docs.select("text").collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
        dealt = {k: set(map(int, re.findall(rf"Exchange hashpartitioning\({k}, (\d+)\)", plan))) for k in (r"doc_id#\d+L, th#\d+L", r"bucket#\d+L", r"piece#\d+L")}
        tasks = -(-common.power_of_two(words / 1000) // 5)
        assert words > 8000 and dealt == {r"doc_id#\d+L, th#\d+L": {2, -(-words // 4000)}, r"bucket#\d+L": {tasks}, r"piece#\d+L": {tasks}}
        texts = [x for x in plan.splitlines() if "RepartitionByExpression [doc_id" in x]
        assert texts and all("text" not in x for x in texts)
        assert sorted(tuple(r) for r in out.collect() if r[0] is not None) == brute_substring(pairs_of(docs))
    finally:
        spark.conf.set(few, was)


def test_substring_piece_without_repeats(spark):
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(30))) for d in (1, 2)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_substring(rows)


def test_substring_text_and_empty(docs, empty):
    assert substring.repeated_passages(empty).collect() == []
    for r in substring.repeated_passages(docs, with_text=True).where("kept_text is not null").collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_cover_is_a_difference_cover():
    for a in range(13):
        for b in range(13):
            assert any((a + k) % 13 in substring.COVER and (b + k) % 13 in substring.COVER for k in range(13))


# --- decontamination ---
def brute_decontam(rows, bench):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    out = []
    for i, t in rows:
        w = find((t or "").encode().lower())
        hit, items = set(), set()
        for item, b in bench:
            x = find((b or "").encode().lower())
            m = min(13, len(x))
            grams = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    items.add(None if item is None else str(item))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, docs, block):
    texts = dict(pairs_of(docs))
    bench = [(1, " ".join(texts[27].split()[400:450])), (2, " ".join(texts[5].split()[:13]).upper()), (3, texts[40].split()[0] + "!"), (4, None), (5, ""), (6, "loop " * 14), (7, "é ü"), (None, "loop " * 13), (None, " ".join(texts[27].split()[500:520])), (1, " ".join(texts[27].split()[400:450]))]
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == brute_decontam(pairs_of(docs), bench)


def test_decontamination_hot_item(spark):
    """One item with most rows, one window shared by many items, texts split over several passes."""
    shared = " ".join(f"p{k}" for k in range(13))
    bench = [(7, f"{shared} own{k} " + " ".join(f"q{k}x{j}" for j in range(12))) for k in range(60)] + [(100 + k, shared) for k in range(30)]
    rows = [(1, "head " + shared + " tail"), (2, bench[5][1]), (3, " ".join(f"p{k}" for k in range(12))), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (1 << 20, 2000):
        got = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block).select(*cols).collect()
        assert sorted(map(tuple, got)) == brute_decontam(rows, bench)


def test_decontamination_tables_are_small():
    r = random.Random(3)
    items = [(str(k), " ".join(f"w{r.randrange(20_000):x}" for _ in range(120)).encode()) for k in range(500)]
    tables = decontam.Patterns(items).lengths
    held = sum(x.nbytes for length, *own in tables for x in (length.strings, length.shift, length.first, length.order, *own))
    assert held < 24 * sum(len(t) for _, t in items)  # windows of 13 word numbers, and tables in step with them


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, none).count() == 0


# --- personal data ---
def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_the_patterns():
    r = random.Random(2)
    bits = ["a.b@c.d", "@", ".", "x_y@z", "-", " ", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (736) 555-2678", "+", "007", "é", "a@b.c_d@e.f", "\n", "1", "12345678901234567"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))
        assert pii.base_spans(t) == plain_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com.", "email", "john [at] example [dot] com"), ("jane at foo dot org says", "email", "jane at foo dot org"), ("x аdmin＠site.com", "email", "аdmin＠site.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"), ("ip one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one"),
        ("+1 (736) 555-2678 4111111111111111", "card", "4111111111111111"), ("te 4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, spans = pii.spans_of(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in spans]
    assert set(base) <= set(spans)


@pytest.mark.parametrize("text", ["look at this dot", "five six seven apples", "we met at noon", "version 1.2.3", "un deux trois quatre", ""])
def test_pii_leaves_clean_text(text):
    assert pii.spans_of(text) == ([], [])
    assert pii.redact(text, []) == text


@pytest.mark.parametrize(("text", "kind", "found"), [("+four nine three zero 1234567", "phone", "+four nine three zero 1234567"), ("(one nine two dot 168 dot one dot one)", "ip", "one nine two dot 168 dot one dot one")])
def test_pii_digit_words_beside_punctuation(text, kind, found):
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in pii.spans_of(text)[1]]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane dot doe at example.com, please", "email", "jane dot doe at example.com"), ("Jane dOt Doe at example dOt com", "email", "Jane dOt Doe at example dOt com"),
        ("+1 415 five five five 2671", "phone", "+1 415 five five five 2671"), ("+one 2 3 four 5 6 seven 8 9 zero 1", "phone", "+one 2 3 four 5 6 seven 8 9 zero 1"),
        ("at 192.168.one.1 now", "ip", "192.168.one.1"), ("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"), ("mail jane at two dot com", "email", "jane at two dot com"),
    ],
)
def test_pii_few_spelled_digits_and_dots_before_the_at(text, kind, found):
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in pii.spans_of(text)[1]]


def test_pii_gate_equals_the_ungated_rewrite():
    r = random.Random(6)
    words = ["four", "Nine", "three", "ZERO", "fünf", "un", "dot", "2", "1234567"]
    ends = ["", "+", "(", ")", "[", "]", ":", ";", "/", "'", '"', "_", "«", "!", "İ", "plus ", "x"]
    for _ in range(3000):
        run = [r.choice(words[:6]) for _ in range(3)] + [r.choice(words) for _ in range(r.randrange(5))]
        t = "".join([r.choice(["", "Say "]), r.choice(ends), *(w + r.choice([" ", ", ", "-", "."]) for w in run), r.choice(words), r.choice(ends)])
        assert pii.rewrites(t) == [x for m in pii._NUMBER.finditer(t) for x in pii._number(m)], t


def disguised(r):
    """An identifier in disguise, and its kind."""
    word = lambda: "".join(r.choice("bcdfgkmprt") for _ in range(r.randrange(3, 8)))
    spelled = "zero one two three four five six seven eight nine".split()
    at, dot = r.choice([" [at] ", " (at) ", "(@)", " {arroba} "]), r.choice([" [dot] ", " (dot) ", "[.]", " <punkt> "])
    how = r.randrange(4)
    if how == 0:
        return "email", word() + at + word() + dot + "com"
    if how == 1:
        return "email", f"{word()} at {word()} dot org"
    if how == 2:
        return "ip", " dot ".join(" ".join(spelled[int(d)] for d in str(r.randrange(256))) for _ in range(4))
    return "phone", "plus " + " ".join(spelled[r.randrange(10)] for _ in range(r.randrange(10, 14)))


def test_pii_disguises_round_trip():
    """Identifiers hidden in clean text come back with their kind and their characters, and nothing else does."""
    r = random.Random(11)
    clean = ["Look here:", "they said", "(see)", "Früher,", "日本 text", "and then;"]
    for _ in range(1500):
        kind, hidden = disguised(r)
        before, after = r.choice(clean) + "; ", r.choice([". ", "; ", " / "]) + r.choice(clean)
        base, spans = pii.spans_of(before + hidden + after)
        assert base == [] and [(pii.KINDS[k], (before + hidden + after)[a:b]) for a, k, b in spans] == [(kind, hidden)], hidden


def test_pii_time_grows_with_the_text():
    text = "mail bob [at] site [dot] com or 10.0.0.1, +1 415 five five five 2671; "
    took = []
    for n in (1000, 8000):
        began = time.perf_counter()
        assert len(pii.spans_of(text * n)[1]) == 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]  # eight times the text; the square would be 64


def test_pii_frames(spark, docs, empty):
    more = docs.unionByName(spark.createDataFrame([(99, "a@b.c 1.2.3.4", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = {r["doc_id"]: r for r in pii.find_pii(more).collect()}
    assert rows[99]["n_email"] == 1 and rows[99]["spans"] == "email:0:5,ip:6:13" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    red = {r["doc_id"]: r for r in pii.redact_pii(more).collect()}
    assert red[99]["text"] == "[EMAIL] [IP]" and red[99]["n_chars"] is not None and red[1]["text"] is None
    assert pii.find_pii(empty).count() == 0 and pii.redact_pii(empty).count() == 0


# --- search ---
def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [float("inf")] + [0.0] * 7), (303, [1.0, None] + [0.0] * 6), (304, [1.0, 2.0]), (400, [1.0, 2.0]), (305, []), (306, []), (600, []), (None, [0.0] * 8)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), F.col("vec_id") % 100 == 0, 10)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, e in good:
        if q % 100 == 0:
            best = sorted((-sum(map(int.__mul__, e, v)), i) for i, v in good if i != q and len(v) == len(e))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, 10, query_bytes=64)
    assert sorted(map(tuple, few.collect())) == sorted(want)


def test_top_k_of_components_beyond_the_doubles(spark):
    """1024 x is no finite double: such a vector takes no part; large ones below that do."""
    rows = [(0, [1.0, 2.0]), (1, [1e306, 0.0]), (2, [-1.7e308, 1.0]), (3, [1e300, 0.0]), (100, [3.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]


def test_top_k_extremes(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [1e30, 0.0])], "vec_id long, embedding array<double>")
    s = {(r[0], r[2]): r[3] for r in topk.top_k(big, F.col("vec_id") == 0, 5).collect()}
    assert s[0, 1] == (1024 * 10**9) ** 2 + 3072 * 5120 if (1024 * 10**9) ** 2 < 2**63 else s[0, 1] == 2**63 - 1
    assert s[0, 2] == 2**63 - 1


# --- tokens ---
@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_sections_add_up(docs, rule):
    with open(tokens.RANKS, "rb") as f:
        encoder, _ = tokens.encoding(f.read(), tokens.PATTERN)
    got = collections.Counter()
    for r in tokens.attribute(docs.where("doc_id is not null"), rule).collect():
        got[r["doc_id"]] += r["n_tokens"]
    want = collections.Counter()
    for i, t in pairs_of(docs):
        if i is not None:
            want[i] += len(encoder.encode_ordinary(t or ""))
    assert got == want


def brute_tokens(text, ranks, rule):
    """Tokens of each line: pieces by the pattern, the lowest rank merged first; each token's bytes mapped to characters one by one."""
    import regex

    chars = [k for k, c in enumerate(text) for _ in c.encode()]
    lines = [0, *(k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text))]
    line_of = lambda k: sum(s <= k for s in lines) - 1
    got, at = [0] * len(lines), 0
    for m in regex.finditer(tokens.PATTERN, text):
        parts = [bytes([b]) for b in m[0].encode()]
        while (best := min(((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0)))[0] < 1 << 30:
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        for p in parts:
            first, last = chars[at], chars[at + len(p) - 1]
            at += len(p)
            share = [line_of(k) for k in range(first, last + 1)]
            got[share[0] if rule == "start" else share[-1] if rule == "end" else max(sorted(set(share)), key=share.count)] += 1
    return got


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_sections_equal_brute_force(spark, rule):
    with open(tokens.RANKS, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    r = random.Random(7)
    bits = ["the ", "word", "é", "漢字 ", "\n", "\n\n", "  ", " \n ", "😀", "don't", "2024", "!!", "\t", "\x1c", "\u00a0", "\u2028"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for k in range(120)]
    got = collections.defaultdict(dict)
    for x in tokens.attribute(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect():
        got[x["doc_id"]][x["section"]] = x["n_tokens"]
    for k, t in rows:
        assert [n for _, n in sorted(got[k].items())] == brute_tokens(t, ranks, rule), t


def test_tokens_of_long_runs():
    """What the encoder can take by itself it counts alike; what it cannot does not end the worker."""
    with open(tokens.RANKS, "rb") as f:
        coder = tokens.encoding(f.read(), tokens.PATTERN)
    for run in (" ", "\n", "\t", "\u00a0", " \n", "\x1c"):
        for frame in ("{}", "a{}", "{}b", "a {}b c", "a{}'s 12{}!!\n{}x"):
            text = frame.replace("{}", run * 3000)
            assert tokens.encode(text, coder[0]) == coder[0].encode_ordinary(text)
    for run in (" ", "\n", "a", "!", "1", "é", " \n", "\u2028"):
        text = "start" + run * 1_000_000 + "end"
        first, last = tokens.token_spans(text, coder)
        assert first[0] == 0 and last[-1] == len(text) - 1


def test_token_spans_round_trip():
    with open(tokens.RANKS, "rb") as f:
        coder = tokens.encoding(f.read(), tokens.PATTERN)
    for text in ("plain words\nand more", "é ü 漢字 😀 x", "a\n\n\nb"):
        first, last = tokens.token_spans(text, coder)
        assert first[0] == 0 and last[-1] == len(text) - 1 and (last >= first).all() and (np.diff(first) >= 0).all()


def test_token_allocation_rules():
    first, last, starts = np.array([0, 3, 8]), np.array([2, 7, 9]), np.array([0, 5])
    assert tokens.allocate(first, last, starts, "start").tolist() == [0, 0, 1]
    assert tokens.allocate(first, last, starts, "end").tolist() == [0, 1, 1]
    assert tokens.allocate(first, last, starts, "most").tolist() == [0, 1, 1]
    assert tokens.allocate(np.array([3]), np.array([6]), starts, "most").tolist() == [0]


def test_token_fields_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "ab cd", None, "x")], "doc_id long, title string, sub string, body string")
    assert [r["section"] for r in tokens.attribute(df, fields=["title", "sub", "body"]).orderBy("section").collect()] == [0, 1, 2]
    assert tokens.attribute(empty).count() == 0


# --- language model ---
def brute_lm(rows, order, alpha=0.4):
    grams = [[collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in ((t or "").encode().split() for _, t in rows)]
    total = [sum((g[k] for g in grams), collections.Counter()) for k in range(order)]
    out = []
    for (i, t), own in zip(rows, grams, strict=True):
        w = (t or "").encode().split()
        others = max(1, sum(total[0].values()) - len(w))
        s = 0.0
        for p in range(len(w)):
            top = min(order, p + 1)
            for k in range(top, 1, -1):
                g = tuple(w[p - k + 1 : p + 1])
                a, b = total[k - 1][g] - own[k - 1][g], total[k - 2][g[:-1]] - own[k - 2][g[:-1]]
                if a > 0 and b > 0:
                    s += math.log(a / b) + (top - k) * math.log(alpha)
                    break
            else:
                s += math.log(max(1, total[0][(w[p],)] - own[0][(w[p],)]) / others) + (top - 1) * math.log(alpha)
        out.append((i if i is not None else -1, len(w), round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, order):
    got = lm.score(docs, order, block_bytes=20_000, bucket_bytes=20_000).collect()
    have, want = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got), brute_lm(pairs_of(docs), order)
    assert [x[:2] for x in have] == [x[:2] for x in want] and [x[2] for x in have] == pytest.approx([x[2] for x in want], abs=1e-5)
    assert all(r["mean_log_score"] is None for r in got if r["n_words"] == 0)


def test_lm_null_ids_are_dealt(spark):
    """Rows that share an id, or have none, are spread over the blocks by their text, and score as further documents."""
    rows = [(None if k % 2 else 7, f"a b c d{k % 5} e{k}", None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = lm.score(docs, block_bytes=100, bucket_bytes=100).collect()
    want = brute_lm([r[:2] for r in rows], 2)
    assert sorted(r[2] for r in got) == pytest.approx(sorted(x[2] for x in want), abs=1e-5)


def test_lm_empty(empty):
    assert lm.score(empty).count() == 0


# --- classifiers ---
@need
def test_quality_on_held_out(spark):
    at = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    r = entries.op1_quality_classifier(spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    right, common_share = (r.predicted == r.quality).mean(), max(r.quality.mean(), 1 - r.quality.mean())
    assert right > common_share and right > 0.9
    assert r.score[r.quality == 1].mean() - r.score[r.quality == 0].mean() > 0.5


def test_quality_odd_inputs(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, none).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 1), (28, 0), (27, 7), (40, 0), (41, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, odd).count() == docs.count()
    assert quality.score_quality(empty, odd).count() == 0
    assert quality.drop_low_quality(docs, odd).columns == docs.columns


@need
def test_language_on_held_out(spark):
    at = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    r = entries.op8_language_id(spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97


def test_language_odd_inputs(docs, empty):
    model = langid.fit(docs, docs)
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(rows) and rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    none = langid.fit(empty, empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_of_texts_without_letters(spark, docs):
    model = langid.fit(docs, docs)
    texts = ["½", "²³ ①", "123 _ -- ☃", "Ⅷ", "", None, "ª", "ß", "語", "½ a"]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] != "und" for r in sorted(got, key=lambda r: r["doc_id"])] == [False] * 6 + [True] * 4


def test_language_vectors_depend_on_their_text_only(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdé fgh") for _ in range(n)) for n in (0, 1, 2, 5, 50, 5000)]
    whole = langid.vectors(texts)
    assert all((langid.vectors([t])[0] == v).all() for t, v in zip(texts, whole, strict=True))
    for t, v in zip(texts, whole, strict=True):  # counted one by one
        raw, want = f" {t.lower()} ".encode(), collections.Counter()
        for k in (2, 3):
            for i in range(len(raw) - k + 1):
                code = int.from_bytes(raw[i : i + k], "little") | (1 << 24 if k == 2 else 0)
                want[code * 0x9E3779B1 % 2**32 >> 32 - langid.BITS] += 1
        size = math.sqrt(sum(want.values()))
        assert all(abs(v[b] - math.sqrt(n) / size) < 1e-5 for b, n in want.items()) and np.count_nonzero(v) == len(want)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert (langid.vectors(texts) == whole).all()


def test_language_prediction_equals_brute_force(spark, docs):
    """Family by the largest margin, then votes within it, ties by worth; all by the definition, one text at a time."""
    model = langid.fit(docs, docs)
    for row in langid.identify(docs, model).collect():
        if row["lang_pred"] == "und":
            continue
        x = langid.vectors([row["text"]])[0]
        margins = [float(x @ w + b) for w, b in model["family"]]
        family = model["families"][int(np.argmax(margins))] if margins else model["families"][0]
        members = model["members"][family]
        votes = dict.fromkeys(members, 0.0)
        for i, j, w, b in model["pairs"][family]:
            d = float(x @ w + b)
            p = 1 / (1 + math.exp(-3 * d))
            votes[members[i]] += (d >= 0) + p / (len(members) + 1)
            votes[members[j]] += (d < 0) + (1 - p) / (len(members) + 1)
        assert row["lang_pred"] == max(members, key=lambda m: votes[m])


def test_quality_scores_equal_brute_force(spark):
    """Sizes compressed block by block with dictionaries given as such, features and logistic function written out."""
    import zstandard

    r = random.Random(2)
    good = [" ".join(r.choice(["alpha", "river", "stone", "cloud", "green"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(r.choice(["buy", "now", "$$$", "click", "win"]) for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad), (900, ""), (901, None), (902, "x" * 5000)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(k, int(k < 150)) for k in range(300)], "doc_id long, quality int"))
    size = lambda t, d: sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t[i : i + quality.BLOCK])) for i in range(0, len(t), quality.BLOCK))
    for row in quality.score(docs, model).collect():
        t = (row["text"] or "").encode()
        a, b, c, n = size(t, model.good), size(t, model.bad), size(t, None), max(1, len(t))
        x = [(v - m) / s for v, m, s in zip([(b - a) / max(1, a + b), c / n, b / n, a / n, math.log(n)], model.mean, model.scale, strict=True)]
        x = [max(-6, min(6, v)) for v in x]
        z = sum(w * v for w, v in zip(model.weights, [*x, *(v * v for v in x), *(x[0] * v for v in x[1:]), 1], strict=True))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-9) and row["predicted"] == (row["score"] >= 0.5)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(scored[k] for k in range(150)) > 0.5 > max(scored[k] for k in range(150, 300))


# --- mixing ---
def brute_rake(cells, targets, rounds=200):
    w = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for k in range(3):
            have = collections.Counter()
            for c, x in w.items():
                have[c[k]] += x
            w = {c: x * targets[k].get(c[k], 0) / have[c[k]] if have[c[k]] else 0.0 for c, x in w.items()}
    return w


def test_rake_meets_all_margins(spark):
    r = random.Random(4)
    cells = {(s, l, p): r.randrange(1, 500) for s in "abc" for l in "xy" for p in "mn"}
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"m": 0.7, "n": 0.3}]
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    got = {tuple(x[:3]): x["weight"] for x in mixing.rake(df, dict(zip(mixing.MARGINS, targets, strict=True))).collect()}
    want = brute_rake(cells, targets)
    assert all(abs(got[c] - want[c]) < 1e-5 for c in cells)
    rated = mixing.rates(mixing.rake(df), 0.5).collect()
    assert sum(x["rate"] * x["tokens"] for x in rated) == pytest.approx(0.5 * sum(cells.values()), rel=1e-3) and all(0 <= x["rate"] <= 1 for x in rated)


def test_mix_odd_inputs(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(not r["sampled"] and r["rate"] == 0 for r in got if r["n_tokens"] == 0)
    assert sum(r["weight"] for r in got) == pytest.approx(1, abs=1e-6)
    assert {r["sampled"] for r in got if r["doc_id"] == 26} in ({True}, {False})
    assert mixing.draw(docs, targets={"lang": {"en": 1.0}}).where("lang <> 'en'").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.draw(docs).columns == docs.columns


def test_mix_equals_brute_force(spark, docs):
    """Tokens, cells, raked weights, rates and draws of every document, in plain Python; only the hash is asked of the engine."""
    plain = docs.select("doc_id", "text", "lang", "source", F.expr("case when doc_id % 3 = 0 then 'm' else 'n' end").alias("topic"))
    targets = {"source": {"s": 0.4, "t": 0.4, "(none)": 0.2}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.1, "es": 0.1, "(none)": 0.1}, "topic": {"m": 0.5, "n": 0.3, "(none)": 0.2}}
    rows = plain.withColumn("u", mixing.uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), 9)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    cell = lambda r: tuple("(none)" if r[m] is None else r[m] for m in mixing.MARGINS)
    cells = collections.Counter()
    for r in rows:
        cells[cell(r)] += words(r["text"])
    have = [{c[k] for c, n in cells.items() if n} for k in range(3)]
    shares = [{v: x / sum(y for u, y in t.items() if u in h) for v, x in t.items() if v in h} for t, h in zip(targets.values(), have, strict=True)]
    raked = brute_rake(cells, shares, 400)
    spend, low, high = 0.5 * sum(cells.values()), 0.0, 1e12
    for _ in range(300):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(cells[c], raked[c] * s) for c in cells) < spend else (low, s)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = mixing.mix(plain, targets).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for g in got:
        by[g["doc_id"], g["text"]].append(g)
    for r in rows:
        g, n, c = by[r["doc_id"], r["text"]].pop(), words(r["text"]), cell(r)
        rate = min(1.0, raked[c] * low / cells[c]) if n else 0.0
        assert g["n_tokens"] == n and g["rate"] == pytest.approx(rate, abs=1e-4) and g["weight"] == pytest.approx(raked[c] * n / cells[c] if n else 0.0, abs=1e-5)
        assert g["sampled"] == (r["u"] < g["rate"])


def test_rake_reports_margins_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "m", 10), ("b", "y", "m", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off by up to 0.4"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"m": 1.0}}).collect()


# --- the whole ---
@need
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        if name != names[-1]:
            assert out.columns == docs.columns
        before, after = dict(pairs_of(docs)), dict(pairs_of(out))
        assert set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {i for i, v in brute_near(list(before.items()), 5, 80).items() if v[2]}
        elif name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {x[0] for x in brute_decontam(list(before.items()), bench) if not x[5]}
        elif name == "pii":
            assert set(after) == set(before) and all(t == pii.redact(before[i], pii.spans_of(before[i])[1]) for i, t in after.items())
            assert not any(plain_pii(t) for t in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        docs = out
    assert docs.count() > 0


CLASHING = ["_n", "_t", "_w", "_c", "_topic", "_salt", "_hits", "_items", "row", "hits", "items", "key", "score", "predicted", "lang_pred", "n_words", "n_hit", "contaminated", "topic", "weight", "rate", "sampled", "spans", "n_email", "component_id", "kept", "n_shingles", "block", "c1", "label", "a.b", "a`b", "doc_id.x", "with space"]


def with_clashes(docs):
    """docs with a column of each name that an operator may use, of values that tell the row."""
    own = F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[own.alias(c) for c in CLASHING])


def test_stages_return_clashing_columns_unchanged(spark, docs, empty):
    odd = common.materialize(with_clashes(docs), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        rows = out.collect()
        assert len(rows) <= odd.count()
        for r in rows:
            assert {r[c] for c in CLASHING} == {f"mine {r['doc_id'] if r['doc_id'] is not None else '?'}"}, name
        assert stage(spark, empty, SF).count() == 0


def test_operators_keep_or_ignore_clashing_columns(spark, docs):
    odd = with_clashes(docs)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, "loop " * 14)], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (28, 0), (40, 0), (41, 1)], "doc_id long, quality int")
    model = langid.fit(docs, docs)
    for run, results in [
        (lambda d: quality.score_quality(d, labels), {"score", "predicted"}),
        (lambda d: langid.identify(d, model), {"lang_pred", "score"}),
        (lambda d: decontam.decontaminate(d, bench, block_bytes=20), {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}),
        (pii.find_pii, {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
        (lambda d: mixing.mix(d, topic=F.lit("t")), {"topic", "n_tokens", "weight", "rate", "sampled"}),
        (tokens.attribute, set()), (lm.score, set()), (substring.repeated_passages, set()), (lambda d: neardup.near_duplicates(d, 3, 0.85), set()),
    ]:
        a, b = run(odd), run(plain)
        if results:
            mine = [c for c in CLASHING if c not in results]
            assert set(mine) <= set(a.columns) and all({r[c] for c in mine} == {f"mine {r['doc_id'] if r['doc_id'] is not None else '?'}"} for r in a.collect())
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_top_k_ignores_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], "q", 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string, part int, rank int")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, 3).collect())) == sorted(map(tuple, topk.top_k(df.select("vec_id", "embedding"), F.col("vec_id") % 10 == 0, 3).collect()))


def test_the_sample_is_bounded(spark):
    """However often rows repeat; labels that clash and long texts are left out; neither layout nor order matters."""
    docs = spark.createDataFrame([(1, f"copy {k % 3}") for k in range(3000)] + [(k, f"text {k}") for k in range(2, 60)] + [(60, "x" * 500)], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, 1)] * 50 + [(k, k % 2) for k in range(2, 58)] + [(58, 0), (58, 1), (60, 1)], "doc_id long, label int")
    got = [sorted(map(tuple, common.fit_sample(d, labelled.repartition(n), 10, 100).collect())) for n, d in ((1, docs.repartition(7)), (5, docs.orderBy(F.rand())))]
    assert got[0] == got[1] and len(got[0]) == len({r[0] for r in got[0]}) == 20
    assert not {58, 60} & {r[0] for r in got[0]}


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


@need
def test_queries_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entries.oracle_sql().items():
        got = __spark_entry__.queries()[name](spark, SF)
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(names)
        assert sorted(got.columns) == order
        assert sorted(repr([r[n] for n in order]) for r in got.collect()) == sorted(repr([dict(zip(names, r, strict=True))[n] for n in order]) for r in cur.fetchall()), name
    assert len([n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]) == 13 and "pipeline" in __spark_entry__.queries()


def test_packing():
    for x in (np.array([], np.uint64), np.array([5], np.uint64), np.array([1, 1, 2**63, 2**64 - 1], np.uint64)):
        assert (common.unpack(common.pack(x)) == x).all() and (common.unpack_sorted(common.pack_sorted(x)) == x).all()


def test_occupied_buckets():
    key = np.sort(np.random.default_rng(3).integers(0, 1 << 40, 500, dtype=np.uint64))
    for buckets in (1, 2, 64, 1 << 20):
        runs = list(common.occupied(key, 40, buckets))
        assert [b for b, i, j in runs for _ in range(i, j)] == [int(k) * buckets >> 40 for k in key] and len(runs) == len({b for b, *_ in runs})
    assert list(common.occupied(key[:0], 40, 64)) == []
