"""One query for each operator of this subpackage, with production parameters over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontam, divergence, langid, lm, merkle, mixing, neardup, pii, quality, substring, tokens, topk, warc
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.fold(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, similarity=0.85)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attribute(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "rate", "sampled")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=crc_mod("doc_id", 5) == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_minhash_neardup, op3_exact_topk, op4_token_counts, op5_substring_dedup, op6_lm_scoring, op7_decontamination, op8_language_id, op9_source_mixing, op10_pii, op11_merkle_manifest, op12_source_divergence, op13_warc_archive)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_ONLY_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PART = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join([*[_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")], _PART]) + ")"
_FOLD = "sha256(array_to_string(list_concat({r}.hs[:{f}.i % 16], [{f}.h], {r}.hs[{f}.i % 16 + 2:]), '')), {f}.proof || array_to_string(list_concat({r}.hs[:{f}.i % 16], {r}.hs[{f}.i % 16 + 2:]), '')"
#: CRC-32 of a text of ASCII, a bit at a time: each byte is followed by seven zeros, and every step shifts by one.
_CRC = "xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split({}, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))]), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(c.low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(1024 * CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
        "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM h WHERE n > 1),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS gone
      FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
        "op6_lm_scoring": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS b FROM w),
q AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM p),
c AS (SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others,
             count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS one,
             count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) AS two FROM q),
d AS (SELECT *, lag(one) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
s AS (SELECT doc_id, CASE WHEN a IS NOT NULL AND two > 0 AND before > 0 THEN ln(two / before)
             ELSE ln(greatest(one, 1) / greatest(others, 1)) + CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END END AS x FROM d),
t AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(x, 0.0), 4) AS log_score, round(x / len(ws), 6) AS mean_log_score
FROM w LEFT JOIN t USING (doc_id)""",
        "op7_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN.format(_LOW)} AS ws FROM benchmark),
f AS (SELECT item, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
x AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM f),
w AS (SELECT doc_id, {_PLAIN.format(_LOW)} AS ws FROM documents),
y AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, ws FROM w CROSS JOIN (SELECT DISTINCT m FROM x) WHERE len(ws) >= m),
o AS (SELECT doc_id, item, y.m, i FROM (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM y) y JOIN x ON x.m = y.m AND x.g = y.g),
h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM o) GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(z.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN z USING (doc_id)""",
        "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT *, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS bad FROM documents),
e AS (SELECT doc_id, coalesce('+' || source, '') AS g, {_LEAF.format("text")} AS leaf, CASE WHEN bad THEN {_LEAF.format(_ONLY_LOW)} END AS now FROM d),
l AS (SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
t AS (SELECT g, 0 AS k, i, n, leaf AS h FROM l
      UNION ALL SELECT g, k + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 16),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, i, n, h FROM s UNION ALL SELECT k + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 16),
tr AS (SELECT g, k, i // 16 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
ur AS (SELECT k, i // 16 AS p, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
f AS (SELECT id, g, 0 AS k, i, n, coalesce(now, leaf) AS h, '' AS proof FROM l
      UNION ALL SELECT f.id, f.g, f.k + 1, f.i // 16, (f.n + 15) // 16, {_FOLD.format(r="tr", f="f")}
      FROM f JOIN tr ON tr.g = f.g AND tr.k = f.k AND tr.p = f.i // 16 WHERE f.n > 1),
v AS (SELECT f.id, 0 AS k, s.i, s.n, f.h, f.proof, s.h AS subroot FROM f JOIN s USING (g) WHERE f.n = 1
      UNION ALL SELECT v.id, v.k + 1, v.i // 16, (v.n + 15) // 16, {_FOLD.format(r="ur", f="v")}, v.subroot
      FROM v JOIN ur ON ur.k = v.k AND ur.p = v.i // 16 WHERE v.n > 1)
SELECT l.doc_id, l.leaf, v.subroot, r.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = r.h AS verified
FROM l JOIN v USING (id) CROSS JOIN (SELECT h FROM u WHERE n = 1) r WHERE v.n = 1""",
        "op12_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format(_LOW)} AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 5) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM a JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 5) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q
      FROM (SELECT lang, term, sum(c) AS c FROM a GROUP BY lang, term) JOIN v USING (lang)),
x AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b USING (lang) LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source WHERE a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(n AS INTEGER) AS rank FROM r WHERE part = 'pair' OR n <= 50""",
        "op13_warc_archive": """
WITH p AS (SELECT row_number() OVER () AS id, page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, first_value(page_id) OVER w AS page, row_number() OVER w = 1 AS own FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN own THEN NULL ELSE page END AS refers_to
FROM o""",
    }
