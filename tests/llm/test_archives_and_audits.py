"""The manifest of a dataset, the audit of sources and the converter of archives, each against brute force."""

import base64
import collections
import gzip
import hashlib
import io
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, divergence, merkle, warc


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest ---
def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(hashes, fanout):
    """Root, and for each leaf its (place, siblings) level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        at, level = [i // fanout for i in at], [sha(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text), tampered where 5 divides the CRC."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        now = leaf_of([*r[:4], r[4].translate(low) if bad and r[4] is not None else r[4]])
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), now, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(groups[s])], fanout) for s in names}
    root, above = tree_of([trees[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for x, own in zip(sorted(groups[s]), trees[s][1], strict=True):
            h = x[3]
            for at, sibs in own + up:
                h = sha(*sibs[:at], h, *sibs[at:])
            out.append((x[4], x[2], trees[s][0], root, sha(*[b for _, sibs in own + up for b in sibs]), h, h == root))
    return sorted(out, key=repr)


def manifest_of(docs, fanout=16):
    return sorted([tuple(r) for r in merkle.manifest(docs, common.crc_mod("doc_id", 5) == 0, fanout).collect()], key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(docs, fanout):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert manifest_of(docs, fanout) == brute_manifest(rows, fanout)


def test_manifest_of_one_hot_source_and_many_small_ones(spark):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(400)] + [(1000 + i, f"s{i}", None, None, "A") for i in range(40)] + [(7, "hot", "en", 7, "Text 7")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert manifest_of(docs) == brute_manifest(rows, 16)


def test_manifest_of_one_row_and_of_none(spark, empty):
    assert manifest_of(empty) == []
    docs = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = manifest_of(docs)
    assert row[1] == row[2] == row[3] == row[5] == sha("1:5----") and row[4] == sha("") and row[6]


def test_manifest_finds_each_change(spark):
    rows = [(i, f"s{i % 3}", "en", 4, "Text") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, F.col("doc_id") == 17).where(~F.col("verified")).collect()
    assert [r["doc_id"] for r in got] == [17]


def test_index_is_the_place_in_the_order(spark):
    rows = [(f"g{i % 4}" if i % 2 else "hot", (i * 37) % 500, i) for i in range(500)]
    got = merkle.indexed(common.materialize(spark.createDataFrame(rows, "g string, a long, b long"), "t"), ["a"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((a, b) for x, a, b in rows if x == g)
        want |= {b: (g, k, len(own)) for k, (_, b) in enumerate(own)}
    assert {r["b"]: (r["g"], r["i"], r["n"]) for r in got} == want


# --- audit of sources ---
def brute_audit(rows, min_docs, top):
    """rows: (lang, source, text)."""
    seen, counts, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.decode() for t in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode().lower())]
        groups.add((lang, source))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        own = sorted(s for g, s in groups if g == lang)
        counts[lang, None] = sum((counts[lang, s] for s in own), collections.Counter())
        total = {s: sum(counts[lang, s][t] for t in kept) for s in [*own, None]}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in [*own, None]}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[None][t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            order = lambda x: (x[0], x[1].encode())
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs, key=order), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(terms, key=order)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(1, 3), (2, 50), (8, 5), (10**6, 50)])
def test_audit(docs, min_docs, top):
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=min_docs, top=top).collect())
    assert got == brute_audit(rows, min_docs, top)


def test_audit_of_few_groups_and_none(spark, empty):
    assert divergence.audit(empty).collect() == []
    one = spark.createDataFrame([("en", "a", "x y"), ("de", None, None), ("de", "b", "")], "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.audit(one, min_docs=1).collect())
    assert got == [("de", "", "pair", "b", 0, 1), ("de", "b", "pair", "", 0, 1)]


def test_audit_terms(spark):
    """A-Z only are lower-cased; what is no letter of ASCII and not beyond it parts terms."""
    rows = [("en", "a", "École ÉCOLE d'été Don't x1y ½ 語"), ("en", "b", "don T")] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {r["term"] for r in divergence.term_counts(df).collect()} == {"", "École", "ÉcolE".replace("colE", "cole"), "d", "été", "don", "t", "x", "y", "½", "語"}
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=1).collect())
    assert got == brute_audit(rows, 1, 50)


def test_counts_of_long_texts_and_many_terms(spark, monkeypatch):
    """Pieces are cut between terms, and full tables are handed on; counts stay whole."""
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 50)
    assert b"".join(divergence._pieces(b"abc def " * 99)) == b"abc def " * 99
    assert all(not p or p[:1] == b" " for p in list(divergence._pieces(b"abcdefgh " * 99))[1:])
    assert list(divergence._pieces(b"a" * 500)) == [b"a" * 500] and list(divergence._pieces(b"")) == [b""]
    import pyarrow as pa

    monkeypatch.setattr(divergence, "MOST_TERMS", 5)
    texts = [" ".join(f"{a}{b}" for a in "abcdefg" for b in "hijk") for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 10), pa.array(["s"] * 10), pa.array(texts)], ["lang", "source", "text"])
    got = collections.Counter()
    for b in divergence._counted(iter([batch])):
        for r in b.to_pylist():
            got[r["term"], "n"] += r["n"]
            got[r["term"], "docs"] += r["docs"]
    assert len({t for t, _ in got}) == 29 and {v for (t, _), v in got.items() if t} == {10}


# --- archives ---
def arc(version, *records, name="x-0"):
    out = warc.arc_block(version, name, "20010203040506")
    for url, content in records:
        out += warc.arc_record(version, name, len(out), url, "1.2.3.4", "20010203040506", "text/html", "200", content)
    return out + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_go_by_declared_lengths(version):
    """Contents that look like header lines, blank lines or nothing do not move the reader."""
    trap = warc.arc_record(version, "y", 0, b"http://trap/", "1.2.3.4", "20010203040506", "text/html", "200", b"no")
    contents = [b"", b"\n\n", trap, b"HTTP/1.1 200 OK\r\n\r\n" + trap, b"\x00\xff" * 50]
    data = arc(version, *[(b"http://a/%d" % i, c) for i, c in enumerate(contents)])
    for stream in (io.BytesIO(data), warc.opened(gzip.compress(data)), warc.opened(warc.member(data[:100]) + warc.member(data[100:]) + warc._EMPTY)):
        got = list(warc.arc_records(stream))
        assert [r["content"] for r in got[1:]] == contents and {r["problem"] for r in got} == {None}
        assert {r["version"] for r in got} == {version} and got[0]["url"].startswith("filedesc://")
        assert all(data[r["offset"] :].startswith(r["url"].encode()) for r in got[1:])


def test_arc_header_lines_differ_by_version():
    plain = b"http://a/b c 1.2.3.4 20010203040506 text/html 3\nabc\n"
    (r,) = warc.arc_records(io.BytesIO(plain))  # without a block at the start: version 1
    assert (r["url"], r["ip"], r["content"], r["version"]) == ("http://a/b c", "1.2.3.4", b"abc", 1)
    of_two = warc.arc_block(2, "n", "20010203040506")
    got = list(warc.arc_records(io.BytesIO(of_two + b"\n" + plain)))
    assert [r["problem"] for r in got] == [None, "bad-header"]


def test_arc_that_breaks_off_or_is_damaged():
    data = arc(1, (b"http://a/", b"one"), (b"http://b/", b"two"))
    for cut in range(len(data)):
        got = list(warc.arc_records(io.BytesIO(data[:cut])))
        assert all(r["content"] in (b"one", b"two") for r in got if r["problem"] is None and not r["url"].startswith("filedesc"))
        assert len([r for r in got if r["problem"]]) <= 1
    got = list(warc.arc_records(io.BytesIO(data.replace(b"http://b/", b"rubbish\nmore rubbish\nhttp://b/"))))
    assert [r.get("content") for r in got[1:]] == [b"one", None, b"two"] and [r["problem"] for r in got[1:]] == [None, "bad-header", None]
    whole = gzip.compress(data)
    assert list(warc.arc_records(warc.opened(whole[:-9])))[-1]["problem"] == "truncated"


def test_warc_records_go_by_declared_lengths():
    blocks = [b"", b"WARC/1.1\r\n\r\n", b"\r\n\r\n", b"x" * 1000]
    data = b"".join(warc.warc_record([("WARC-Type", "resource"), ("X", None)], b) for b in blocks)
    assert [r["block"] for r in warc.warc_records(io.BytesIO(data))] == blocks
    assert [r["problem"] for r in warc.warc_records(io.BytesIO(data[:-500]))] == [None] * 3 + ["truncated"]
    assert [r["problem"] for r in warc.warc_records(io.BytesIO(b"rubbish\r\n" + data))] == ["bad-header"] + [None] * 4


def test_dates_and_urls():
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.arc_url("http://a/b c\né?x=%20") == b"http://a/b%20c%0A%C3%A9?x=%20"
    assert warc.arc_url(None) == warc.arc_url("") == b"about:blank"


def brute_archive(rows, min_bytes=0):
    """rows: (page_id, html)."""
    groups = collections.defaultdict(list)
    for i, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for p, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out += [(i, len(p), digest, *(("response", None) if k == 0 or len(p) < min_bytes else ("revisit", ids[0]))) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


PAGES = [(i, f"http://s/{i % 3} x", f"<p>{i % 40} é</p>") for i in range(150)] + [(200 + i, None, "hot") for i in range(120)]
PAGES += [(None, "http://n/", "hot"), (500, "", None), (501, "u", ""), (502, "u", "y" * 300_000), (2**63 - 1, "u", "z"), (-5, "u", "z"), (-5, "u", "z"), (600, "u", "HTTP/1.1 200 OK\r\n\r\nx"), (601, "u", "WARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(5)
    got = sorted([tuple(r) for r in warc.archived(pages, least).collect()], key=repr)
    assert got == brute_archive([(i, h) for i, _, h in PAGES], least)


def test_archives_of_no_page(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_sound_files(spark, tmp_path):
    """What is written is plain multi-member gzip, closed at the size asked for; ids and digests hold; types follow the content."""
    rows = [("http://a/" + str(i), "1.2.3.4", "20010203", "text/html", "200", b"HTTP/1.1 200 OK\r\nK: %d\r\n\r\nbody %d" % (i, i % 5) + b"." * 3000, 1 + i % 2) for i in range(60)]
    rows += [("dns:a", None, None, "text/dns", None, b"a 1.2.3.4", None), ("http://empty/", None, None, None, None, None, 2)]
    df = spark.createDataFrame(rows, "url string, ip string, date string, mime string, status string, content binary, version int").coalesce(2)
    at = [str(tmp_path / k) for k in ("arc", "warc")]
    warc.write_arc(df, at[0], archive_bytes=20_000)
    files = [tmp_path / "arc" / f for f in os.listdir(at[0]) if f.startswith("part-")]
    assert len(files) > 4 and {gzip.decompress(f.read_bytes())[:11] for f in files} == {b"filedesc://"}
    back = warc.read_arc(spark, at[0]).collect()
    plain = lambda r: (r["url"], (r["headers"] or b"") + r["payload"])
    assert sorted(map(plain, back)) == sorted((r[0], r[5] or b"") for r in rows) and {r["version"] for r in back} == {1, 2}
    warc.convert(spark, *at, "K")
    got = warc.read_warc(spark, at[1], "K").collect()
    assert all(r["sound"] and r["problem"] is None for r in got) and len({r["record_id"] for r in got}) == len(got) == 62
    kinds = collections.Counter(r["warc_type"] for r in got)
    assert kinds == {"response": 5, "revisit": 55, "resource": 2}
    ids = {r["record_id"]: r for r in got}
    assert all(ids[r["refers_to"]]["key"] == 55 + r["key"] % 5 and ids[r["refers_to"]]["digest"] == r["digest"] for r in got if r["warc_type"] == "revisit")
    assert {r["date"] for r in got} == {"2001-02-03T00:00:00Z", "1970-01-01T00:00:00Z"}


def test_join_dealt_by_salt(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)] + [(None, 900)], "k long, a long")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (7, "z")], "k long, b string")
    for how in ("inner", "left"):
        got = sorted([tuple(r) for r in common.dealt(left, right, ["k"], how).collect()], key=repr)
        assert got == sorted([tuple(r) for r in left.join(right, ["k"], how).collect()], key=repr)
