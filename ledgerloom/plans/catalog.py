"""The registered queries: each applies an operator to the tables, with the SQL that gives the same rows where there is one.

Stand-ins: documents for records and their bodies, embeddings for vectors, page addresses for paths, events for log lines
and ledgers, conversations for prompts, orders and lineitem for topics and their links, nation and region for concepts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions import text as X
from ..operators import governance, lint, logs, postings, rank
from ..session import scratch, ship
from ..sources import code
from ..streaming import sessions

Q = ["ananble", "atshsh", "anlyes", "aterth", "aielle", "asci"]
PATH = r"regexp_replace(url, '^[a-z]+://[^/]*/?', '')"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(_Tables(ship(spark), sf_dir))
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


class _Tables:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401  its queries are registered as it is read

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(_sql)


def _values(data: list[tuple], names: str) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data) + f") AS t({names})"


def _for_each(t, data: list[tuple], *names: str) -> DataFrame:
    """Rows of a template for each supplier, KEY in them being its number."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in data])
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("_key"), F.inline(rows)).select(*[F.replace(n, F.lit("KEY"), F.col("_key")).alias(n) for n in names])


def _for_each_sql(data: list[tuple], names: str, strings: str) -> str:
    """The same in SQL: the columns of `strings` with KEY replaced, the others as they are."""
    own = strings.split(", ")
    return "SELECT " + ", ".join(f"replace({n}, 'KEY', CAST(s_suppkey AS VARCHAR)) AS {n}" if n in own else n for n in names.split(", ")) + f" FROM {_values(data, names)}, supplier"


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- ranking ---------------------------------------------------------------------------------------------------------
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_TF = f"""tok AS (SELECT doc_id, lang, source, n_chars, {_TOK} AS t FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, (SELECT unnest([{_in(Q)}]) AS term)),
hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)"""
_BM25 = f"""{_TF}, st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
bm AS (SELECT hit.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / a))) AS score
       FROM hit JOIN df USING (term) JOIN tok USING (doc_id), st GROUP BY hit.doc_id)"""


def _index(t) -> postings.Index:
    return postings.of_files(t.documents, "doc_id", "text")


@query(f"""WITH {_TF}, s AS (SELECT doc_id, sum(tf * (ln(((SELECT count(*) FROM tok) + 1) / (df + 1)) + 1)) AS score FROM hit JOIN df USING (term) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""")
def kw_tfidf_topk(t):
    """From the index of the table, as the next ones; it is built when the first of them runs."""
    scored = _index(t).tfidf(Q).withColumnRenamed("key", "doc_id")
    return rank.top_k(scored, [F.desc("score"), F.asc("doc_id")], 20).select("doc_id", r6(F.col("score"), "score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_topk(t):
    return _index(t).bm25_top(Q, 20).select(F.col("key").alias("doc_id"), r6(F.col("score"), "score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_scan(t):
    """The same without an index: terms are counted where documents are read."""
    docs = t.documents.where("text is not null")
    return rank.top_k(rank.bm25(docs, "doc_id", F.col("text"), Q), [F.desc("score"), F.asc("doc_id")], 20).select("doc_id", r6(F.col("score"), "score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND source <> 'src0' ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_filtered(t):
    """Metadata filters inside the channel; statistics of the whole table."""
    keep = t.documents.where((F.col("lang") == "en") & (F.col("source") != "src0")).select(F.col("doc_id").alias("key"))
    return _index(t).bm25_top(Q, 20, keep).select(F.col("key").alias("doc_id"), r6(F.col("score"), "score"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, min(doc_id) AS first_doc FROM w GROUP BY term""")
def index_postings(t):
    """A whole index, built anew: of every term its documents and occurrences, as the postings have them."""
    path = scratch(t.spark, "index")
    postings.build(t.documents.where("text is not null"), "doc_id", F.col("text"), path)
    rows = t.spark.read.parquet(f"{path}/postings")
    return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tf"), F.min(F.array_min("keys")).alias("first_doc"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) AS score FROM embeddings JOIN q ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 20""")
def vector_cosine_topk(t):
    """Every row whose id is divisible by 50, against all others."""
    out = rank.nearest_of_each(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 20)
    return out.select("query_id", "vec_id", r6(F.col("score"), "score"), "rank")


_CHANNELS = f"""{_BM25},
f AS (SELECT source AS family, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM bm JOIN documents USING (doc_id)),
fr AS (SELECT family, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE k = 1),
g AS (SELECT source AS family, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
gr AS (SELECT family, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM g WHERE k = 1)"""


def _channels(t) -> tuple[DataFrame, DataFrame]:
    found = _index(t).bm25(Q).withColumnRenamed("key", "doc_id").join(t.documents.select("doc_id", F.col("source").alias("family")), "doc_id")
    order = [F.desc("score"), F.asc("doc_id")]
    fts = rank.ranked(rank.top_k(rank.collapse(found, "family", order), order, rank.FTS_CAP), order)
    by_length = [F.desc("n_chars"), F.asc("doc_id")]
    second = rank.collapse(t.documents.select("doc_id", F.col("source").alias("family"), "n_chars"), "family", by_length)
    return fts, rank.ranked(rank.top_k(second, by_length, rank.FTS_CAP), by_length)


@query(f"""WITH {_CHANNELS}, u AS (SELECT * FROM fr UNION ALL SELECT * FROM gr), s AS (SELECT family, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY family)
SELECT family, round(CAST(score AS DOUBLE), 6) AS score FROM s ORDER BY s.score DESC, family LIMIT 10""")
def rrf_hybrid(t):
    out = rank.rrf(list(_channels(t)), "family")
    return out.orderBy(F.desc("score"), "family").limit(10).select("family", r6(F.col("score"), "score"))


@query(f"""WITH {_CHANNELS}, u AS (SELECT family, 'fts' AS channel, doc_id, rank FROM (SELECT f.family, f.doc_id, fr.rank FROM f JOIN fr ON fr.family = f.family AND f.k = 1) UNION ALL
SELECT g.family, 'length', g.doc_id, gr.rank FROM g JOIN gr ON gr.family = g.family AND g.k = 1)
SELECT family, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 6) AS score, string_agg(rank || ':' || channel || ':' || doc_id, ',' ORDER BY rank, channel) AS contributors FROM u GROUP BY family""")
def rrf_contributors(t):
    """Each family's fused score, and the documents that each channel ranked for it."""
    fts, second = _channels(t)
    who = rank.contributors({"fts": fts, "length": second}, "family", "doc_id")
    text = F.array_join(F.transform("contributors", lambda c: F.concat_ws(":", c["rank"], c["channel"], c["item"])), ",")
    return rank.rrf([fts, second], "family").join(who, "family").select("family", r6(F.col("score"), "score"), text.alias("contributors"))


_BEST = "b AS (SELECT text FROM bm JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 1)"


@query(f"""WITH {_CHANNELS}, {_BEST}, u AS (SELECT * FROM fr UNION ALL SELECT * FROM gr), fused AS (SELECT family, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY family),
asked AS (SELECT unnest([{_in(Q)}]) AS w), c AS (SELECT count(*) FILTER (WHERE list_contains({_TOK}, w)) / count(*) >= 0.25 AS sure FROM asked, b)
SELECT 'sure' AS question, family, round(CAST(score AS DOUBLE), 6) AS score FROM fused, c WHERE sure
UNION ALL SELECT 'sure', family, round(CAST(1.0 / (60 + rank) AS DOUBLE), 6) FROM gr, c WHERE NOT sure
UNION ALL SELECT 'unsure', family, round(CAST(1.0 / (60 + rank) AS DOUBLE), 6) FROM gr""")
def hybrid_step_aside(t):
    """Fusion where the best full-text hit shares enough of the question; where it does not (longer by words that no text has), the other channel alone."""
    fts, second = _channels(t)
    docs = t.documents.where("text is not null")
    best = rank.top_k(rank.bm25(docs, "doc_id", F.col("text"), Q), [F.desc("score"), F.asc("doc_id")], 1).join(docs.select("doc_id", "text"), "doc_id")
    out = None
    for name, question in (("sure", Q), ("unsure", Q + [f"qqq{k}zzz" for k in range(60)])):
        row = best.select(rank.confident(F.lit(" ".join(question)), F.col("text")).alias("sure")).first()
        one = rank.hybrid(fts, second, "family", bool(row and row[0])).select(F.lit(name).alias("question"), "family", r6(F.col("score"), "score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def family_collapse(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank.collapse(rows, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")])


@query(f"""WITH {_BM25}, r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm)
SELECT doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 50 AND (rank = 1 OR score >= 2.5)""")
def second_hit_floor(t):
    order = [F.desc("score"), F.asc("doc_id")]
    found = rank.bm25(t.documents.where("text is not null"), "doc_id", F.col("text"), Q)
    hits = rank.second_hit_floor(rank.ranked(rank.top_k(found, order, 50), order), 2.5)
    return hits.select("doc_id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


# --- text functions --------------------------------------------------------------------------------------------------
_TERMS = f"list_filter({_TOK}, lambda x: len(x) > 1 AND x NOT IN ({_in(fixed.STOPWORDS)}))"


@query(f"SELECT doc_id, CAST(len(list_distinct({_TERMS})) AS BIGINT) AS n_terms, array_to_string(list_sort(list_distinct({_TERMS})), ' ') AS terms FROM documents WHERE text IS NOT NULL")
def content_terms(t):
    terms = X.content_terms(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(F.array_sort(terms), " ").alias("terms"))


@query(f"SELECT doc_id, round(len(list_intersect(list_distinct({_TERMS}), [{_in(Q)}])) / {len(Q)}.0, 6) AS coverage, len(list_intersect(list_distinct({_TERMS}), [{_in(Q)}])) / {len(Q)}.0 >= 0.25 AS confident FROM documents WHERE text IS NOT NULL")
def query_coverage(t):
    q = F.lit(" ".join(Q))
    share = values.coverage(X.content_terms(q), X.content_terms(F.col("text")))
    return t.documents.where("text is not null").select("doc_id", F.round(share, 6).alias("coverage"), rank.confident(q, F.col("text")).alias("confident"))


_STEM = f"CASE WHEN contains(regexp_extract({PATH}, '[^/]*$'), '.') THEN regexp_replace({PATH}, '\\.[^./]*$', '') ELSE {PATH} END"
_PTOK = rf"list_filter(regexp_split_to_array(lower(regexp_replace(translate({_STEM}, '/\_.-', '     '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '\s+'), lambda x: len(x) >= 3 AND x NOT IN ({_in(fixed.GENERIC_STEMS)}))"


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct({_PTOK})), ' ') AS tokens FROM pages")
def path_tokens(t):
    return t.pages.select("page_id", F.array_join(F.array_sort(X.path_tokens(F.expr(PATH), 1000)), " ").alias("tokens"))


@query("SELECT conv_id, turn, role, starts_with(text, '<task-notification>') AS machine FROM conversations")
def machine_prompts(t):
    return t.conversations.select("conv_id", "turn", "role", X.is_machine_prompt(F.col("text")).alias("machine"))


_GATE = f"list_filter(list_distinct(list_filter({_TOK}, lambda x: len(x) >= 3 AND x NOT IN ({_in(fixed.STOPWORDS)}) AND x NOT IN ({_in(fixed.PROMPT_FILLER)}))), lambda x: true)"


@query(f"SELECT conv_id, turn, CAST(least(12, len({_GATE})) AS BIGINT) AS n_terms, len({_GATE}) >= 4 AS opens FROM conversations WHERE role = 'user'")
def prompt_gate(t):
    n = F.size(X.prompt_terms(F.col("text")))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", n.cast("long").alias("n_terms"), (n >= 4).alias("opens"))


@query(f"SELECT doc_id, sha256(text) AS sha, 'link:' || sha256(text) AS key, substr(sha256(doc_id || chr(10) || source || chr(10)), 1, 12) AS short, regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9._-]', '', 'g') AS logged, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def text_keys(t):
    x = F.col("text")
    return t.documents.where("text is not null").select("doc_id", F.sha2(x, 256).alias("sha"), X.link_key(x).alias("key"), X.short_hash(F.col("doc_id").cast("string"), F.col("source")).alias("short"), X.log_query(x).alias("logged"), F.octet_length(x).cast("long").alias("bytes"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, array_to_string(string_split(text, chr(10))[1:25], chr(10)) AS excerpt, 'T' || chr(10) || chr(10) || substr(text, 1, 1500) AS embedded FROM documents WHERE text IS NOT NULL")
def text_shapes(t):
    x = F.col("text")
    none = F.lit(None).cast("string")
    return t.documents.where("text is not null").select("doc_id", X.squeezed(x).alias("squeezed"), X.excerpt(x).alias("excerpt"), X.embedding_text(F.lit("T"), x, none, none, F.lit(False)).alias("embedded"))


# --- governance ------------------------------------------------------------------------------------------------------
_REFS = [("T1", "docs"), ("T2", "blog/"), ("T3", "*/1*"), ("T4", "#Foo"), ("T5", ""), ("T6", "article/7#x"), ("T7", "news/*.html")]
_RSQL = _values(_REFS, "topic, ref")


@query(rf"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), r AS (SELECT topic, regexp_replace(string_split(ref, '#')[1], '/+$', '') AS r FROM {_RSQL})
SELECT page_id, topic FROM p JOIN r ON r <> '' AND (path = r OR starts_with(path, r || '/') OR starts_with(r, path || '/') OR path GLOB r OR (contains(r, '*') AND regexp_full_match(path, replace(replace(r, '.', '\.'), '*', '.*'))))""")
def path_governance(t):
    refs = t.rows(_REFS, "topic string, ref string")
    return governance.govern(t.pages.select("page_id", F.expr(PATH).alias("path")), refs).select("page_id", "topic")


@query(rf"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), c AS (SELECT page_id, path, regexp_full_match(path, '.*/1.*') AS by_topic, starts_with(path, 'docs/') AS by_concept FROM p)
SELECT page_id, CASE WHEN contains(path, '.png') THEN 'ignored' WHEN by_topic THEN 'mapped_topic' WHEN by_concept THEN 'mapped_concept_only' ELSE 'unmapped' END AS class FROM c""")
def unmapped_paths(t):
    topic, concept = t.rows([("T", "*/1*")], "topic string, ref string"), t.rows([("C", "docs")], "concept string, ref string")
    paths = t.pages.select("page_id", F.expr(PATH).alias("path"))
    return governance.unmapped(paths, topic, concept, F.contains("path", F.lit(".png"))).select("page_id", "class")


_HITS = [("src/KEY/a.py", "f", "A.f"), ("src/KEY/a.py", "g", "g"), ("lib/KEY/z.py", "h", "h")]
_CONCEPTS = [("C1-KEY", "src/KEY"), ("C2-KEY", "src/KEY/a.py#A.f"), ("C3-KEY", "src/KEY/a.py#q")]
_ATTACHED = [("src/KEY/a.py", "f", "C2-KEY"), ("src/KEY/a.py", "g", "C1-KEY"), ("lib/KEY/z.py", "h", None)]


@query(_for_each_sql(_ATTACHED, "path, symbol, concept_id", "path, concept_id"))
def concept_attach(t):
    """Each supplier has a folder with symbols, and concepts that name the folder, a symbol of it, and one that is not there."""
    hits, concepts = _for_each(t, _HITS, "path", "symbol", "qualified_name"), _for_each(t, _CONCEPTS, "concept_id", "ref")
    return governance.attach_concepts(hits, concepts).select("path", "symbol", "concept_id")


def _links(t) -> DataFrame:
    """Line items as the links of their order; of items with one number, the largest values."""
    each = t.lineitem.groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("seq")).agg(F.max("l_linestatus").alias("s"), F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"))
    status = F.when(F.col("s") == "O", "active").when(F.col("flag") == "R", "declined").otherwise("superseded")
    return each.select("path", F.concat(F.lit("L"), "seq").alias("link"), "seq", status.alias("status"), "flag", "part", "quantity")


_EACH = "(SELECT l_orderkey AS path, l_linenumber AS seq, max(l_linestatus) AS s, max(l_returnflag) AS flag, max(l_partkey) AS part, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"
_LINKS = f"SELECT path, 'L' || seq AS link, seq, CASE WHEN s = 'O' THEN 'active' WHEN flag = 'R' THEN 'declined' ELSE 'superseded' END AS status, flag, part, quantity FROM {_EACH}"


@query(f"WITH l AS ({_LINKS}) SELECT path, arg_min(link, seq) AS current FROM l WHERE status = 'active' GROUP BY path")
def current_link(t):
    return governance.current_links(_links(t), "path")


@query(f"WITH l AS ({_LINKS}) SELECT path, link, CAST(row_number() OVER (PARTITION BY path ORDER BY seq) AS BIGINT) AS place FROM l")
def chain_order(t):
    return _links(t).select("path", "link", F.row_number().over(Window.partitionBy("path").orderBy("seq")).cast("long").alias("place"))


@query("""WITH w AS (SELECT doc_id, strlen(text) + 1 AS b, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(s AS BIGINT) AS bytes_so_far, s <= 4800 AS fits FROM w""")
def running_byte_cap(t):
    out = governance.running_bytes(t.documents.where("text is not null"), F.col("text"), [F.asc("doc_id")], ["source"])
    return out.select("doc_id", "bytes_so_far", (F.col("bytes_so_far") <= 4800).alias("fits"))


@query("""WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (WHERE k = 1 OR s <= 2000) AS BIGINT) AS shown, CAST(count(*) FILTER (WHERE k > 1 AND s > 2000) AS BIGINT) AS omitted FROM w GROUP BY conv_id""")
def hydrate_budget(t):
    """The newest entry in full, older ones while they fit into 2,000 bytes."""
    rows = t.conversations.withColumn("text", F.coalesce("text", F.lit("")))
    out = governance.running_bytes(rows, F.col("text"), [F.desc("turn")], ["conv_id"])
    shown = (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1) | (F.col("bytes_so_far") <= 2000)
    return out.withColumn("s", shown).groupBy("conv_id").agg(F.count_if("s").alias("shown"), F.count_if(~F.col("s")).alias("omitted"))


@query(r"""WITH r AS (SELECT n_regionkey, 'T' || n_nationkey AS topic, 'L' || n_nationkey AS link, n_name AS text, n_nationkey FROM nation),
d AS (SELECT n_regionkey, 'Standing rulings:' || chr(10) || string_agg('- ' || topic || ' ' || link || ': ' || text, chr(10) ORDER BY topic, n_nationkey) AS t, count(*) AS n FROM r GROUP BY n_regionkey
      UNION ALL SELECT -1, 'Standing rulings:' || chr(10) || string_agg('- ' || topic || ' ' || link || ': ' || text, chr(10) ORDER BY topic, n_nationkey), count(*) FROM r)
SELECT CAST(n_regionkey AS BIGINT) AS store, CASE WHEN n <= 24 THEN t END AS text, CAST(n AS BIGINT) AS links, strlen(t) AS bytes, sha256(t) AS sha256, CASE WHEN n > 24 THEN 'over-cap' END AS reason FROM d""")
def standing_digest(t):
    """The rulings of each region as a store, and all of them as one (-1), which is over the cap of links."""
    rows = t.nation.select(F.col("n_regionkey").cast("long").alias("store"), F.concat(F.lit("T"), "n_nationkey").alias("topic"), F.concat(F.lit("L"), "n_nationkey").alias("link"), F.col("n_name").alias("text"))
    out = governance.standing_digest(rows, by=["store"]).unionByName(governance.standing_digest(rows).withColumn("store", F.lit(-1).cast("long")))
    return out.select("store", "text", F.col("links").cast("long").alias("links"), "bytes", "sha256", F.col("reason").cast("string").alias("reason"))


_INV = [("I1", "no-bypass", "ERROR|error", "", ["nothing"], "CONSTRAINT"), ("I2", "pattern-absent", "zzzqqq", "", [], "HOLD"), ("I3", "must-call", "the", "", [], "HOLD"), ("I4", "single-definition", "the ", "", [], "HOLD")]


@query(r"""WITH l AS (SELECT source AS path, unnest(string_split(text, chr(10))) AS text FROM documents),
h AS (SELECT count(*) FILTER (WHERE regexp_matches(text, 'ERROR|error')) AS e, count(*) FILTER (WHERE regexp_matches(text, 'zzzqqq')) AS z, count(*) FILTER (WHERE regexp_matches(text, 'the ')) AS d FROM l)
SELECT 'I1' AS inv_id, CASE WHEN e > 0 THEN 'violation' ELSE 'ok' END AS state FROM h UNION ALL SELECT 'I2', CASE WHEN z > 0 THEN 'hold_violation' ELSE 'ok' END FROM h
UNION ALL SELECT 'I3', 'skipped' FROM h UNION ALL SELECT 'I4', CASE WHEN d <> 1 THEN 'hold_violation' ELSE 'ok' END FROM h""")
def drift_invariants(t):
    lines = t.documents.select(F.col("source").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    inv = t.rows(_INV, "inv_id string, kind string, pattern string, scope string, allowed array<string>, tier string")
    return governance.drift(inv, lines).select("inv_id", "state")


# --- quality and history ---------------------------------------------------------------------------------------------
@query(f"""WITH l AS ({_LINKS}) SELECT CAST(path AS VARCHAR) AS path, link, 'superseded' AS rule FROM l WHERE status = 'superseded' UNION ALL SELECT CAST(path AS VARCHAR), link, 'kind-enum' FROM l WHERE flag = 'N'""")
def link_quality(t):
    none = F.lit(None).cast("string")
    cols = {"kind": F.when(F.col("flag") == "N", "neither").otherwise("adopted"), "authority": F.lit("code-derived"), "ruling_text": F.lit("x"), "source": F.lit("y"), "reverses": none, "reason_for_change": none, "superseded_by": none}
    return lint.link_rules(_links(t).withColumns(cols)).select("path", "link", "rule")


def _sides(t) -> tuple[DataFrame, DataFrame]:
    old = _links(t).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("promoted_by", F.lit(None).cast("string"))
    new = old.where(F.col("part") % 11 != 0).withColumn("quantity", F.when(F.col("part") % 7 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")))
    return old, new.withColumn("status", F.when((F.col("part") % 5 == 0) & (F.col("status") == "active"), "historical").when((F.col("part") % 13 == 0) & (F.col("status") == "declined"), "active").otherwise(F.col("status")))


@query(f"""WITH l AS ({_LINKS}), k AS (SELECT *, part % 7 = 0 AS body, CASE WHEN part % 5 = 0 AND status = 'active' THEN 'historical' WHEN part % 13 = 0 AND status = 'declined' THEN 'active' ELSE status END AS now FROM l WHERE part % 11 <> 0)
SELECT CAST(path AS VARCHAR) AS path, link, 'removed' AS rule FROM l WHERE part % 11 = 0 UNION ALL SELECT CAST(path AS VARCHAR), link, 'body-frozen' FROM k WHERE body
UNION ALL SELECT CAST(path AS VARCHAR), link, 'status-move' FROM k WHERE now <> status AND status <> 'active' UNION ALL SELECT CAST(path AS VARCHAR), link, 'status-not-alone' FROM k WHERE now <> status AND status = 'active' AND body""")
def history_frozen_fields(t):
    old, new = _sides(t)
    return lint.history(old, new, ["flag", "part", "quantity"]).select("path", "link", "rule")


@query(f"""WITH l AS ({_LINKS}), k AS (SELECT path, link, seq, CASE WHEN path % 9 = 0 THEN 100 - seq ELSE seq END AS now FROM l), b AS (SELECT *, lag(seq) OVER (PARTITION BY path ORDER BY now) AS before FROM k)
SELECT CAST(path AS VARCHAR) AS path, link, 'order' AS rule FROM b WHERE before > seq""")
def order_preserved(t):
    old = _links(t).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("promoted_by", F.lit(None).cast("string"))
    new = old.withColumn("seq", F.when(F.col("path") % 9 == 0, 100 - F.col("seq")).otherwise(F.col("seq")))
    return lint.history(old, new, ["flag"]).where("rule = 'order'").select("path", "link", "rule")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o_totalprice <> p THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n USING (o_orderkey)""")
def drift_full_outer(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice")
    new = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return lint.snapshot_diff(old, new, "o_orderkey", "o_totalprice")


@query("""WITH d AS (SELECT CAST(n_regionkey AS VARCHAR) AS path, n_name AS id FROM nation WHERE n_nationkey % 2 = 0) SELECT path, id AS link, 'pairing' AS rule FROM d WHERE id < 'M'
UNION ALL SELECT CAST(n_regionkey AS VARCHAR), n_name, 'pairing' FROM nation WHERE n_nationkey % 2 = 1 AND n_name >= 'M'""")
def pairing_exactly_one(t):
    all_of = t.nation.select(F.col("n_regionkey").cast("string").alias("path"), F.col("n_name").alias("id"), "n_nationkey")
    old, new = all_of.where("n_nationkey % 2 = 1").drop("n_nationkey"), all_of.drop("n_nationkey")
    marks = all_of.where("id >= 'M'").select("path", "id", F.lit("add").alias("action"))
    return lint.pairing(old, new, marks).select("path", "link", "rule")


# --- logs and sessions -----------------------------------------------------------------------------------------------
@query("SELECT event_type, CAST(coalesce(value, 0) >= 50 AS VARCHAR) AS outcome, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def log_outcome_counts(t):
    return logs.counts(t.events.withColumn("outcome", (F.coalesce("value", F.lit(0.0)) >= 50).cast("string")), "event_type", "outcome")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def log_percentiles(t):
    return logs.nearest_rank(t.events.where("value is not null"), "value", "event_type")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def top_topics(t):
    return logs.top_topics(t.events, "user_id")


@query("""SELECT nudges, appends, prompts, lookups, kills, nudges >= 3 AND appends = 0 AS write_silent, prompts >= 10 AND lookups = 0 AS read_silent, kills >= 3 AS watchdog FROM
(SELECT count(*) FILTER (WHERE event_type = 'view') AS nudges, count(*) FILTER (WHERE event_type = 'none') AS appends, count(*) FILTER (WHERE event_type = 'click') AS prompts, count(*) FILTER (WHERE event_type = 'purchase') AS lookups, count(*) FILTER (WHERE event_type = 'error' AND value > 99) AS kills FROM events)""")
def health_flags(t):
    e = F.col("event_type")
    return logs.health(t.events, e == "view", e == "none", e == "click", e == "purchase", (e == "error") & (F.col("value") > 99))


@query("SELECT CAST(count(l.doc_id) AS BIGINT) AS fresh, CAST(count(*) AS BIGINT) AS total, CASE WHEN count(l.doc_id) = 0 THEN 'none' WHEN count(l.doc_id) = count(*) THEN 'full' ELSE 'partial' END AS mode FROM documents d LEFT JOIN labels l USING (doc_id)")
def embedding_mode_coverage(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return logs.embedding_mode(joined, F.col("has").isNotNull())


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def ledger_growth(t):
    w = t.events.withColumn("at", F.struct("ts", "event_id"))
    return logs.ledger_growth(w, "user_id", "event_type", "props", "at").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM events) WHERE b IS NOT NULL AND epoch_us(ts) - epoch_us(b) <= 3600000000")
def redelivery_dedupe(t):
    return logs.redelivered(t.events, ["user_id", "event_type"], "ts", 3600).select("event_id")


def _session_events(t) -> DataFrame:
    """Events as those of sessions: a run of one sort of prompts is one prompt and its redeliveries, every third of which is lost."""
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type").isin("click", "error"), "edit").otherwise("prompt")
    value = F.when(kind != "prompt", F.coalesce("props", F.lit(""))).when(F.col("event_id") % 3 == 0, sessions.LOST).otherwise("")
    return t.events.select(F.col("user_id").cast("string").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("kind"), F.col("event_type").alias("key"), value.alias("value"))


@query("""WITH RECURSIVE raw AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(ts) / 1e6 AS "at", CASE WHEN event_type = 'purchase' THEN 'commit' WHEN event_type IN ('click', 'error') THEN 'edit' ELSE 'prompt' END AS kind, event_type AS key,
    CASE WHEN event_type IN ('purchase', 'click', 'error') THEN coalesce(props, '') WHEN event_id % 3 = 0 THEN 'lost' ELSE '' END AS value FROM events),
  ev AS (SELECT *, row_number() OVER w AS n, kind = 'edit' AND lag(value) OVER (PARTITION BY session, kind, key ORDER BY "at", value) IS DISTINCT FROM value AS news FROM raw WINDOW w AS (PARTITION BY session ORDER BY "at", kind, key, value)),
  st AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS "at", '' AS kind, '' AS verdict, 0 AS turn, 0 AS grown, CAST(NULL AS VARCHAR) AS prompt, FALSE AS opened, CAST(NULL AS INT) AS last_turn, CAST(NULL AS DOUBLE) AS last_at, 0 AS look_turn, CAST(NULL AS DOUBLE) AS look_at, CAST([] AS VARCHAR[]) AS commits FROM ev
  UNION ALL SELECT session, n, "at", kind, verdict, turn, CASE WHEN verdict = 'coverage' THEN 0 WHEN verdict = 'grown' THEN grown + 1 ELSE grown END, CASE WHEN kind = 'prompt' THEN key ELSE prompt END,
    CASE WHEN kind = 'prompt' AND verdict <> 'repeat' THEN verdict = 'open' ELSE opened END,
    CASE WHEN verdict IN ('coverage', 'look-back') THEN turn ELSE last_turn END, CASE WHEN verdict IN ('coverage', 'look-back') THEN "at" ELSE last_at END,
    CASE WHEN verdict IN ('coverage', 'look-back') THEN turn ELSE look_turn END, CASE WHEN verdict IN ('coverage', 'look-back') THEN "at" ELSE look_at END,
    CASE WHEN verdict = 'commit' THEN list_append(commits, value)[-20:] ELSE commits END
  FROM (SELECT *, CASE WHEN kind = 'edit' THEN CASE WHEN news THEN 'grown' ELSE 'same' END WHEN kind = 'commit' THEN CASE WHEN list_contains(commits, value) THEN 'same' ELSE 'commit' END
      WHEN again AND NOT opened THEN 'repeat' WHEN value = 'lost' THEN 'open' WHEN grown > 0 AND (last_turn IS NULL OR turn - last_turn >= 3 OR "at" - last_at >= 900) THEN 'coverage'
      WHEN turn - look_turn >= 5 OR "at" - look_at >= 1200 THEN 'look-back' ELSE 'quiet' END AS verdict
    FROM (SELECT ev.session, ev.n, ev."at", ev.kind, ev.key, ev.value, ev.news, st.grown, st.prompt, st.opened, st.last_turn, st.last_at, st.look_turn, st.commits, ev.key IS NOT DISTINCT FROM st.prompt AS again,
        st.turn + CASE WHEN ev.kind = 'prompt' AND ev.key IS DISTINCT FROM st.prompt THEN 1 ELSE 0 END AS turn, CASE WHEN ev.kind = 'prompt' THEN coalesce(st.look_at, ev."at") ELSE st.look_at END AS look_at
      FROM st JOIN ev ON ev.session = st.session AND ev.n = st.n + 1)))
SELECT session, "at", kind, verdict, turn, grown FROM st WHERE n > 0""")
def nudge_cooldown(t):
    """Verdicts of the session rules over a batch, with redeliveries and retries."""
    return sessions.verdicts(_session_events(t))


# --- metrics ---------------------------------------------------------------------------------------------------------
_EXPECT = "[doc_id % 4, doc_id % 7 + 10]"
_RECALL = ", ".join(f"round(len(list_intersect(hits[1:{k}], expect)) / len(list_distinct(expect)), 6) AS recall_{k}" for k in (1, 3, 10))


@query(f"""SELECT id, {_RECALL}, round(coalesce(1.0 / list_min(list_filter(list_transform(expect, lambda e: list_position(hits, e)), lambda p: p > 0)), 0), 6) AS mrr
FROM (SELECT doc_id AS id, {_EXPECT} AS expect, [doc_id % 5, doc_id % 4, doc_id % 9 + 10] AS hits FROM documents)""")
def recall_mrr(t):
    d = F.col("doc_id")
    rows = t.documents.select(d.alias("id"), F.array(d % 4, d % 7 + 10).alias("expect"), F.array(d % 5, d % 4, d % 9 + 10).alias("hits"))
    return rows.select("id", *[F.round(c, 6).alias(n) for n, c in rank.evaluate(F.col("expect"), F.col("hits")).items()])


@query("SELECT round(avg(d), 6) AS gain, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, CAST(count(d) AS BIGINT) AS n, avg(d) > 2 * stddev_samp(d) / sqrt(count(d)) AS passed FROM (SELECT quality - toxic AS d FROM labels)")
def negative_control(t):
    out = rank.negative_control(t.labels, "quality", "toxic")
    return out.select(F.round("gain", 6).alias("gain"), F.round("se", 6).alias("se"), "n", "passed")


@query("SELECT n_name AS id, n_regionkey AS kind, partner FROM (SELECT *, lead(n_name, 2) OVER w AS x, count(*) OVER (PARTITION BY n_regionkey) AS c, row_number() OVER w AS r FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)) a JOIN (SELECT n_regionkey AS k, n_name AS partner, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS j FROM nation) b ON a.n_regionkey = b.k AND b.j = (a.r - 1 + 2) % a.c + 1 WHERE a.c = 5")
def derangement_pairs(t):
    ids = t.nation.withColumn("c", F.count("*").over(Window.partitionBy("n_regionkey"))).where("c = 5")
    return rank.derangement(ids.select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("kind")), "id", "kind")


@query("""WITH r AS (SELECT doc_id, [doc_id % 5] AS expect, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE [doc_id % 5, doc_id % 2] END AS fts, [doc_id % 7, doc_id % 2] AS vector FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN fts ELSE vector END AS hybrid FROM r), u AS (SELECT *, hybrid = vector AND fts <> vector AS aside, list_contains(expect, fts[1]) AS f, list_contains(expect, vector[1]) AS v FROM s WHERE fts IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS queries, CAST(count(*) FILTER (WHERE aside) AS BIGINT) AS stepped_aside, CAST(count(*) FILTER (WHERE aside AND f AND NOT v) AS BIGINT) AS regressions, CAST(count(*) FILTER (WHERE aside AND v AND NOT f) AS BIGINT) AS improvements FROM u""")
def step_aside_report(t):
    d = F.col("doc_id")
    runs = t.documents.select(F.array(d % 5).alias("expect"), F.when(d % 11 != 0, F.array(d % 5, d % 2)).alias("fts"), F.array(d % 7, d % 2).alias("vector"), d)
    return rank.step_aside_report(runs.withColumn("hybrid", F.when(d % 3 == 0, F.col("fts")).otherwise(F.col("vector"))))


# --- sets, unions and spans ------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT l_suppkey AS path, l_orderkey AS a, l_orderkey + l_linenumber * 3 AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT path, min(a) AS a, max(b) AS b, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY path, k""")
def merged_spans(t):
    s = t.lineitem.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("b"))
    return code.merged_intervals(s, "path", "a", "b")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def keep_newest(t):
    return logs.newest(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 20).select("event_type", "event_id")


_SOURCES = [("mKEY.py", "class AKEY:\n    def __init__(self, x: int = 1): pass\n    @property\n    def p(self):\n        'Doc.'\n        return 1\n    async def q(self, *a): pass\ndef f():\n    def g(): pass\n"), ("badKEY.py", "def ("), ("xKEY.rs", "fn main() {}")]
_CHUNKS = [("mKEY.py", "constructor", "AKEY.__init__", "def __init__(self, x: int = 1)", 2, "ok"), ("mKEY.py", "accessor", "AKEY.p", "def p(self)", 3, "ok"), ("mKEY.py", "method", "AKEY.q", "async def q(self, *a)", 7, "ok"), ("mKEY.py", "function", "f", "def f()", 8, "ok"), ("mKEY.py", "function", "f.g", "def g()", 9, "ok"), ("badKEY.py", None, None, None, None, "failed"), ("xKEY.rs", None, None, None, None, "not-indexed: no parser")]


@query("SELECT path, kind, qualified_name, signature, CAST(coalesce(start_line, 0) AS INTEGER) AS start_line, status FROM (" + _for_each_sql(_CHUNKS, "path, kind, qualified_name, signature, start_line, status", "path, qualified_name, signature") + ")")
def py_chunks(t):
    """A module for each supplier, with a file that cannot be parsed and one in another language."""
    files = _for_each(t, _SOURCES, "path", "content").withColumn("length", F.octet_length("content").cast("long")).withColumn("content", F.col("content").cast("binary"))
    return code.chunks(files).select("path", "kind", "qualified_name", "signature", F.coalesce("start_line", F.lit(0)).alias("start_line"), "status")


_SWIFT = """struct VecKEY {
    init?(x: Int) { self.x = x }
    static func == (a: VecKEY, b: VecKEY) -> Bool { return "{" == "\\(a.map { $0 })" }
    lazy var kept: Int = { 5 }()
    var size: Int { get { 1 } }
    var seen: Int = 0 { didSet { } }
}
}
public func after<T>(
    _ t: T
) -> Int where T: P { /* } */ return 1 }
"""
_SWIFT_CHUNKS = [("constructor", "VecKEY.init", "init?(x: Int)", 2, 2, "partial"), ("method", "VecKEY.==", "func == (a: VecKEY, b: VecKEY) -> Bool", 3, 3, "partial"), ("accessor", "VecKEY.size", "var size: Int", 5, 5, "partial"), ("function", "after", "func after<T>( _ t: T ) -> Int where T: P", 9, 11, "partial")]


@query("SELECT kind, qualified_name, signature, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, status FROM (" + _for_each_sql(_SWIFT_CHUNKS, "kind, qualified_name, signature, start_line, end_line, status", "qualified_name, signature") + ")")
def swift_chunks(t):
    """A file for each supplier."""
    files = _for_each(t, [("vKEY.swift", _SWIFT)], "path", "content").withColumn("length", F.octet_length("content").cast("long")).withColumn("content", F.col("content").cast("binary"))
    return code.chunks(files).select("kind", "qualified_name", "signature", "start_line", "end_line", "status")


# --- code and packs --------------------------------------------------------------------------------------------------
@query("""WITH d AS (SELECT l_suppkey AS path, l_orderkey AS line FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY path ORDER BY line), -1) AS before FROM d),
m AS (SELECT l_suppkey AS path, l_orderkey AS line FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT b.path, b.line, m.line AS mark FROM b JOIN m ON b.path = m.path AND m.line BETWEEN b.line - 3 AND b.line - 1 AND m.line > before""")
def nearest_marks(t):
    from ..operators import code_links

    rows = t.lineitem.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("line"), "l_returnflag")
    decl = rows.where("l_returnflag = 'A'").select("path", "line").distinct().withColumn("symbol", F.lit("s"))
    marks = rows.where("l_returnflag = 'R'").select("path", "line").distinct().select("path", "line", F.col("line").alias("topic"), F.lit("L").alias("link"))
    return code_links.nearest_marks(decl, marks).select("path", "line", F.col("topic").alias("mark"))


@query("""WITH w AS (SELECT source, doc_id, 'D' || doc_id || ' ' || lang AS t FROM documents WHERE lang IS NOT NULL), s AS (SELECT *, sum(strlen(t) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS b FROM w),
p AS (SELECT source, coalesce(string_agg(t, chr(10) ORDER BY doc_id) FILTER (WHERE b <= 120), '') || chr(10) AS body, count(*) FILTER (WHERE b <= 120) AS parts, count(*) FILTER (WHERE b > 120) AS omitted FROM s GROUP BY source)
SELECT source, body || 'pack sha256=' || sha256(body) || ' bytes=' || strlen(body) AS text, parts, omitted FROM p""")
def context_pack(t):
    from ..operators import code_links

    docs = t.documents.where("lang is not null")
    return code_links.context_pack(docs, "source", [F.asc("doc_id")], F.concat(F.lit("D"), "doc_id", F.lit(" "), "lang"), 120)
