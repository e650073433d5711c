"""Ranking: TF-IDF, BM25, cosine, reciprocal rank fusion, families, and the gate between them.

A document's counts of the query's terms are taken where it is read. Corpus statistics, of the unfiltered table, are one
pre-aggregated row that is broadcast, so scores need no shuffle; only ranks and caps do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .order import placed

K1, B = 1.2, 0.75
FLOOR = 1e-6
FTS_CAP = 200
STORE_K, CODE_K = 60, 30
STEP_ASIDE = 0.25
SECOND_FLOOR = 0.0314


def term_counts(docs: DataFrame, key: str, text: Column, terms: list[str], tokenize=X.tokens, keep: Column | None = None) -> DataFrame:
    """(key, kept, length, tf): a row a document with the counts of the given terms, in their order. No shuffle.

    A text is cut into tokens once: the counts are taken of a bound variable, and come out of a generator, through which no
    filter on them is pushed to be computed a second time.
    """

    def count(toks: Column, term: str) -> Column:
        return F.size(F.filter(toks, lambda x: x == term)).cast("long")

    def counted(toks: Column) -> Column:
        return F.struct(F.size(toks).cast("long").alias("length"), F.array(*[count(toks, t) for t in terms]).alias("tf"))

    return docs.select(key, (keep if keep is not None else F.lit(True)).alias("kept"), F.inline(F.transform(F.array(tokenize(text)), counted)))


def _statistics(counts: DataFrame, n_terms: int) -> DataFrame:
    """One row: number of documents, average length, documents that have each term. Pre-aggregated by task."""
    has = [F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(n_terms)]
    return counts.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"), F.array(*has).alias("_df"))


def _scored(counts: DataFrame, key: str, part) -> DataFrame:
    """Sum part(tf, df, i) over terms for documents that have one; the statistics are one broadcast row."""
    n = len(part)
    both = counts.where("kept").where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(_statistics(counts, n)))
    total = F.lit(0.0)
    for i, f in enumerate(part):
        tf, df = F.get("tf", F.lit(i)), F.get("_df", F.lit(i))
        total = total + F.when(tf > 0, f(tf, df)).otherwise(0.0)
    return both.select(key, total.alias("score"))


def tfidf(docs: DataFrame, key: str, text: Column, query: list[str]) -> DataFrame:
    """(key, score): sum over the query's tokens, repeats counted, of tf * (ln((N + 1) / (df + 1)) + 1)."""
    terms = list(dict.fromkeys(query))

    def part(times: int):
        return lambda tf, df: times * tf * (F.log((F.col("_n") + 1) / (df + 1)) + 1)

    return _scored(term_counts(docs, key, text, terms), key, [part(query.count(t)) for t in terms])


def bm25(docs: DataFrame, key: str, text: Column, query: list[str], keep: Column | None = None, tokenize=X.tokens) -> DataFrame:
    """(key, score), higher is better: the sum over distinct query terms of max(ln((N - n + .5) / (n + .5)), 1e-6) * tf * 2.2 / (tf + 1.2 (.25 + .75 len / avg)).

    N, n and the average length are of all docs; `keep` filters rows within the channel, before ranks and caps.
    """
    terms = list(dict.fromkeys(query))

    def part(tf: Column, df: Column) -> Column:
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(FLOOR))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("_avg")))

    return _scored(term_counts(docs, key, text, terms, tokenize, keep), key, [part] * len(terms))


def ranked(scored: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 over a whole channel. The channel is cut to its cap first (top_k), so one task sees a bounded list."""
    return scored.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    return scored.orderBy(*order).limit(k)


def collapse(rows: DataFrame, family: str, order: list[Column]) -> DataFrame:
    """The best row of each family, before any cap."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def rrf(channels: list[DataFrame], family: str, k: int = STORE_K) -> DataFrame:
    """(family, score): the sum of 1 / (k + rank) over channels of (family, rank)."""
    out = None
    for c in channels:
        part = c.select(family, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(family).agg(F.sum("part").alias("score"))


def contributors(channels: dict[str, DataFrame], family: str, item: str) -> DataFrame:
    """(family, contributors): for each family what of it each channel ranked, as (rank, channel, item) by rank. Channels are collapsed, so a family has
    one row in each at most."""
    out = None
    for name, c in channels.items():
        part = c.select(family, F.struct(F.col("rank").cast("int").alias("rank"), F.lit(name).alias("channel"), F.col(item).alias("item")).alias("c"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(family).agg(F.sort_array(F.collect_list("c")).alias("contributors"))


def hybrid(fts: DataFrame, vector: DataFrame, family: str, confident: bool, k: int = STORE_K) -> DataFrame:
    """Fused channels, or the vector channel alone if the best full-text hit does not share enough of the query."""
    if not confident:
        return vector.select(family, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))
    return rrf([fts, vector], family, k)


def confident(query: Column, document: Column, least: float = STEP_ASIDE) -> Column:
    """Whether a document shares at least `least` of the query's content terms (the bound itself is enough)."""
    from ..functions.values import coverage

    return F.coalesce(coverage(X.content_terms(query), X.content_terms(document)) >= least, F.lit(False))


def step_aside_report(runs: DataFrame, expected: str = "expect", fts: str = "fts", vector: str = "vector", hybrid: str = "hybrid") -> DataFrame:
    """One row over queries with their expected ids and three ranked lists: queries where the hybrid list is the vector list though
    the channels differ, those of them that lost a right first hit, and those that gained one. Queries without all lists are out."""
    aside = (F.col(hybrid) == F.col(vector)) & (F.col(fts) != F.col(vector))
    right = {name: F.coalesce(F.array_contains(expected, F.get(name, F.lit(0))), F.lit(False)) for name in (fts, vector)}
    return runs.where(F.col(fts).isNotNull() & F.col(vector).isNotNull() & F.col(hybrid).isNotNull()).agg(
        F.count("*").alias("queries"), F.count_if(aside).alias("stepped_aside"),
        F.count_if(aside & right[fts] & ~right[vector]).alias("regressions"), F.count_if(aside & right[vector] & ~right[fts]).alias("improvements"),
    )


def second_hit_floor(hits: DataFrame, floor: float = SECOND_FLOOR) -> DataFrame:
    """The first hit always, others only from `floor` up."""
    return hits.where((F.col("rank") == 1) | (F.col("score") >= floor))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int | None = None) -> DataFrame:
    """(key, score) by cosine with a query vector, exact over all rows; unusable vectors are left out."""
    from ..functions.values import cosine

    out = vectors.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score")).where("score is not null")
    return top_k(out, [F.desc("score"), F.asc(key)], k) if k else out


#: Rows that a task multiplies with its queries at a time, and by how much a product may differ from the sum of its terms in their order.
_SLICE, _SLACK = 512, 2e-9


def _best_of(k: int):
    """Of a block of rows (id, u) the k best for each of some queries (id, u), by the score to nine places, ties by id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, asked = left.num_rows, right.num_rows
        if not n or not asked:  # the empty side has no columns
            none = (left if n else right).column("id").slice(0, 0)
            return pa.table([none, none, pa.array([], pa.float64())], names=["query_id", "id", "score"])
        ids = pa.chunked_array([*left.column("id").chunks, *right.column("id").chunks], left.schema.field("id").type)
        coded = ids.combine_chunks().dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(place.size)
        code = place[coded.indices.to_numpy()]
        own, asking = code[:n], code[n:]
        u, v = (pc.list_flatten(t.column("u")).to_numpy().reshape(t.num_rows, -1) for t in (left, right))
        least = np.full(asked, -np.inf)
        q, r, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, n, _SLICE):
            products = v @ u[at : at + _SLICE].T
            if at == 0 and products.shape[1] > k + 1:  # one of these may be the query itself
                least = np.partition(products, -k - 1, axis=1)[:, -k - 1]
            new_q, new_r = np.nonzero(products >= (least - _SLACK)[:, None])
            other = own[new_r + at] != asking[new_q]
            new_q, new_r = new_q[other], new_r[other] + at
            score = np.zeros(new_q.size)
            for j in range(u.shape[1]):  # term by term, so equal vectors have equal scores in any block
                score += v[new_q, j] * u[new_r, j]
            q, r, s = np.concatenate([q, new_q]), np.concatenate([r, new_r]), np.concatenate([s, np.round(score, 9) + 0.0])
            order = np.lexsort((own[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.searchsorted(q, np.arange(asked))
            rank = np.arange(q.size) - first[q]
            kth = rank == k - 1
            least[q[kth]] = np.maximum(least[q[kth]], s[kth])
            q, r, s = q[rank < k], r[rank < k], s[rank < k]
        return pa.table([right.column("id").take(pa.array(q)), left.column("id").take(pa.array(r)), pa.array(s)], names=["query_id", "id", "score"])

    return run


def nearest_of_each(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int, block: int = 256) -> DataFrame:
    """(query_id, key, score, rank): the k nearest other rows by cosine (to nine places, ties by key) of each row that is a query.

    Exact over all rows: blocks of 64 * `block` unit vectors of one length meet turns of 32 * `block` queries, each pair in a group of its own, so
    the work is dealt over as many tasks as there are pairs. A group multiplies them as matrices, sums up those anew that can be among the k best, in the order
    of the components, and gives k rows a query. Vectors that are null or hold null or non-finite components take no part; one of norm 0 scores 0.
    """
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~odd).select(F.col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), x.alias("v"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    rows = rows.select("id", "q", F.size("v").alias("dim"), "v", norm.alias("norm")).withColumn("u", F.transform("v", lambda e: F.when(F.col("norm") > 0, e / F.col("norm")).otherwise(0.0)))
    own = F.xxhash64("id")

    def dealt(side: DataFrame, name: str, blocks: int, other: str, times: int) -> DataFrame:
        """Each row in one block, and once for each of the blocks of the other side. Columns get identities of their own, for those that both sides of a
        cogroup share are passed to the left one alone."""
        all_of = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias(other)
        return side.select(F.pmod(own, F.lit(blocks)).alias(name), "dim", F.col("id").alias("id"), F.col("u").alias("u"), all_of).select("block", "turn", "dim", "id", "u")

    blocks, turns = max(1, -(-n // (64 * block))), max(1, -(-asked // (32 * block)))
    left, right = dealt(rows, "block", blocks, "turn", turns), dealt(rows.where("q"), "turn", turns, "block", blocks)
    kind = rows.schema["id"].dataType
    made = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    pair = ["block", "turn", "dim"]
    lists = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_best_of(k), made)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return lists.withColumnRenamed("id", key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evaluate(expected: Column, hits: Column, ks: tuple[int, ...] = (1, 3, 10)) -> dict[str, Column]:
    """Recall at each k and the reciprocal rank of the first expected id, for lists of ids."""
    out = {f"recall_{k}": F.size(F.array_intersect(F.slice(hits, 1, k), expected)) / F.size(F.array_distinct(expected)) for k in ks}
    first = F.array_min(F.transform(F.filter(expected, lambda e: F.array_contains(hits, e)), lambda e: F.array_position(hits, e)))
    out["mrr"] = F.coalesce(F.lit(1.0) / first, F.lit(0.0))
    return out


def negative_control(pairs: DataFrame, real: str, control: str) -> DataFrame:
    """Mean gain of real over control scores against its sample standard error; a near tie fails."""
    d = F.col(real) - F.col(control)
    out = pairs.agg(F.avg(d).alias("gain"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count(d).alias("n"))
    return out.withColumn("passed", F.coalesce(F.col("gain") > 2 * F.col("se"), F.lit(False)))


def derangement(ids: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, partner): each id with another of its kind, by one rotation a kind; kinds of one member have no partner."""
    from ..functions.values import coprime_column

    at = placed(ids.select(key, kind), [kind], [key]).where("_n > 1")
    at = at.withColumn("_to", F.pmod(F.col("_i") + coprime_column(F.col("_n")), F.col("_n")))
    other = at.select(F.col(kind).alias("_k"), F.col("_i").alias("_j"), F.col(key).alias("partner"))
    return at.join(other, (F.col(kind) == F.col("_k")) & (F.col("_j") == F.col("_to"))).select(key, kind, "partner")


def benchmark_scores(runs: DataFrame, slices: str = "kind") -> DataFrame:
    """Means of recall and reciprocal rank over queries (expect, hits, a slice), a row a slice and one, `all`, over all queries."""
    each = runs.select(F.col(slices).alias("slice"), *[c.alias(n) for n, c in evaluate(F.col("expect"), F.col("hits")).items()])
    both = each.unionByName(each.withColumn("slice", F.lit("all")))
    return both.groupBy("slice").agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in each.columns[1:]])
