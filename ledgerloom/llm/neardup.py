"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document has COORDINATES minima of independent hashes of its shingle set; two sets of Jaccard similarity s agree
in each with probability s. Documents are posted under their (coordinate, value) pairs. A pair that agrees in at least
`matches` coordinates agrees in one of any COORDINATES - matches + 1 of them, so only that prefix is posted; the other
coordinates are skipped in the merge and only probed: two bits of each travel with the posting and bound the collision count
from above. Of pairs that pass, the collisions of all coordinates are counted, those with at least `matches` are retained
and confirmed on full sets.

Copies of one set form a class from the start and only its first document is posted. Pairs inside a connected component
need no check, so lists are met with few members at a time: first with their smallest document, then, while lists hold
documents of several components and all pairs across would be many, with some members of their commonest component, others and
more of them from round to round. What is left is met across components by a prefix join on full sets. So a group of
near-duplicates costs its size, not its square, even where half of its pairs are below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, constants, discard, hot_keys, materialize, mix64, quoted, salted, spread, text_bytes

COORDINATES = 64
#: Pairs of the prefix join for each of its postings up to which it is made, and pairs that pass its bounds for each document up to
#: which they are confirmed: beyond either, a round joins components first. The result is the same.
PAIRS_A_ROW, PAIRS_A_DOCUMENT = 1000, 16


def miss_probability(similarity: float, matches: int, coordinates: int = COORDINATES) -> float:
    """That a pair of this similarity agrees in fewer than `matches` coordinates."""
    return sum(math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k) for k in range(matches))


@cache
def matches_for(similarity: float, miss: float = 1e-6) -> int:
    return max(m for m in range(1, COORDINATES + 1) if m == 1 or miss_probability(similarity, m) <= miss)


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of text; the whole sequence if it has fewer words, nothing without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k, c = min(k, len(words)), constants(k + 1, 11)
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - k + 1, c[k] * np.uint64(k), np.uint64)
        for j in range(k):
            acc += h[j : len(h) - k + 1 + j] * c[j]
        return np.unique(mix64(acc))


def _signature(hashes: np.ndarray, mul: np.ndarray, xor: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            np.minimum(best, ((hashes[None, i : i + 512] ^ xor) * mul).min(axis=1), out=best)
    return best


_SIGNED = "doc_id long, n int, c1 long, c2 long, s1 long, s2 long, keys array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, xor = constants(COORDINATES, 21)[:, None], constants(COORDINATES, 22)[:, None]
        bit, salt = np.arange(COORDINATES, dtype=np.uint64), constants(COORDINATES, 23)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n = np.zeros(len(texts), np.int32)
            four = np.zeros((len(texts), 4), np.uint64)
            keys = np.zeros((len(texts), COORDINATES), np.uint64)
            for i, t in enumerate(texts):
                if (h := shingle_hashes(t, k)).size:
                    n[i] = h.size
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    sig = mix64(_signature(h, mul, xor))
                    four[i] = d >> 64, d & (1 << 64) - 1, ((sig & np.uint64(1)) << bit).sum(), ((sig >> np.uint64(1) & np.uint64(1)) << bit).sum()
                    with np.errstate(over="ignore"):
                        keys[i] = mix64(sig ^ salt)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1).view(np.int64)))
            cols = [batch.column(0), pa.array(n), *(pa.array(np.ascontiguousarray(four[:, j]).view(np.int64)) for j in range(4)), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "c1", "c2", "s1", "s2", "keys"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in by_bytes(texts):
                sets = [shingle_hashes(t, k) for t in texts[a:b]]
                offsets = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reached. Large-star and small-star rounds.

    Minima are pre-aggregated before their shuffle and joined back over salted keys, so a hub is no hot task.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None  # a sum of hashes of the edges: rounds end when they no longer change
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted(both, least, ["u"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            # v = u never occurs; the centre itself keeps its link to the minimum
            least.where("u <> m").select("u", F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, "star")
        discard(before)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = sign


def _alike(similarity: float, matches: int) -> Column:
    """Sizes that allow the similarity, and enough agreeing coordinates as far as two bits of each tell."""
    agree = COORDINATES - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")).bitwiseOR(F.col("x.s2").bitwiseXOR(F.col("y.s2"))))
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * F.lit(round(similarity * 100))
    return sized & (agree >= matches)


def _confirmed(pairs: DataFrame, keys: DataFrame, sets: DataFrame, similarity: float, matches: int) -> DataFrame:
    """The materialised pairs (a, b) that collide in at least `matches` coordinates and whose full shingle sets are similar enough.

    The rows of hot first members are dealt over several tasks.
    """
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", "n")
    counted = spread(pairs, keys.select(F.col("doc_id").alias("a"), F.col("keys").alias("xk")), ["a"], hot).join(keys.select(F.col("doc_id").alias("b"), F.col("keys").alias("yk")), "b")
    retained = counted.where(F.size(F.array_intersect("xk", "yk")) >= matches).select("a", "b")
    joined = spread(retained, sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xs")), ["a"], hot).join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("ys")), "b")
    size = F.size(F.array_intersect("xs", "ys"))
    return joined.where(size * 100 >= (F.size("xs") + F.size("ys") - size) * F.lit(round(similarity * 100))).select("a", "b")


def _rounds(lists: DataFrame, found: DataFrame, keys: DataFrame, sets: DataFrame, similarity: float, matches: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Lists that still hold documents of several components. As long as their prefix join makes many pairs, and a round
    halves them, their documents are met with some members of the commonest component of each list. Gives the components
    and the pairs (materialised) that are left to confirm."""
    last = math.inf
    for turn in count():
        member = lists.join(found, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", "s1", "s2", F.coalesce("component", "doc_id").alias("c"))
        member = materialize(member, "member")
        of = member.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("cs"), F.sum("m").alias("m")).where("cs > 1")
        of = materialize(of.select("key", "top", "m"), "open")
        hot = hot_keys(of, "key", "m")
        torn = materialize(spread(member, of.select("key", "top"), ["key"], hot), "torn")
        # A similar document of another component is met in at least as many lists, and those are open.
        apart = torn.groupBy("doc_id", "c").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("doc_id", "c")
        apart = materialize(apart, "apart")
        discard(member, of)
        if apart.isEmpty():
            discard(torn, apart)
            return found, None
        posted, mixed = _prefixes(sets.join(apart, "doc_id"), similarity)
        rows, pairs = mixed.agg(F.sum("m"), F.sum("pairs")).first()
        settled = not rows or pairs > last / 2
        if settled or pairs <= PAIRS_A_ROW * rows:
            across = _across(posted, mixed, similarity)
            if settled or across.count() <= PAIRS_A_DOCUMENT * apart.count():
                discard(torn, apart, posted, mixed)
                return found, across
            discard(across)
        last = pairs
        order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id", "key", F.lit(turn)), "doc_id")
        pivot = torn.where("c = top").withColumn("place", F.row_number().over(order)).where(F.col("place") <= 8 * 4**turn).select("key", F.struct("doc_id", "n", "s1", "s2").alias("y"))
        met = spread(torn.where("c <> top").select("key", F.struct("doc_id", "n", "s1", "s2").alias("x")), pivot, ["key"], hot).where(_alike(similarity, matches))
        met = materialize(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "met")
        links = materialize(_confirmed(met, keys, sets, similarity, matches), "more")
        if not links.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        discard(torn, apart, posted, mixed, met, links)


def _prefixes(torn: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of torn (doc_id, c, shingles) with different c: the shingles under which documents are met, (doc_id, c, n, at, t), and those of
    them that hold several components, (t, top, m, pairs). No similar pair of different c gets lost.

    A prefix join on the full sets: with its shingles in the order of their frequency, a document of n shingles shares with a
    similar one a shingle among its first n - ceil(similarity n) + 1, and the places of the first shared one bound the
    overlap. Shingles of one document only need no row.
    """
    s = round(similarity * 100)
    every = torn.select("doc_id", F.explode("shingles").alias("t"))
    known = materialize(every.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "known")
    ranked = spread(every, known, ["t"], hot_keys(known, "t", "df")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("own"))
    ranked = ranked.join(torn.select("doc_id", "c", F.size("shingles").alias("n")), "doc_id")
    prefix = F.col("n") - F.floor((F.col("n") * s + 99) / 100).cast("int") + 1
    alone = F.col("n") - F.size("own")
    ranked = ranked.select("doc_id", "c", "n", alone.alias("alone"), F.slice("own", F.lit(1), F.greatest(F.lit(0), prefix - alone)).alias("own"))
    posted = ranked.select("doc_id", "c", "n", "alone", F.posexplode("own").alias("k", "e")).select("doc_id", "c", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("e.t").alias("t"))
    posted = materialize(posted, "posted")
    mixed = posted.groupBy("t", "c").agg(F.count("*").alias("m")).groupBy("t").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("cs"), F.sum("m").alias("m"), F.sum(F.col("m").cast("double") * F.col("m")).alias("q")).where("cs > 1")
    mixed = materialize(mixed.select("t", "top", "m", ((F.col("m").cast("double") * F.col("m") - F.col("q")) / 2).alias("pairs")), "mixed")
    discard(known)
    return posted, mixed


def _across(posted: DataFrame, mixed: DataFrame, similarity: float) -> DataFrame:
    """Materialised pairs (a, b) of different components that meet under a shingle of _prefixes() and may be similar. Of the
    documents under a shingle, those of its commonest component are not met with each other, so a large group with a few
    strays costs the strays times the group."""
    s = round(similarity * 100)
    hot = hot_keys(mixed, "t", "m")
    all_of = materialize(spread(posted, mixed.select("t", "top"), ["t"], hot), "meeting")
    x = all_of.where("c <> top").select("t", F.struct("doc_id", "c", "n", "at").alias("x"))
    y = all_of.select("t", F.struct("doc_id", "c", "n", "at", "top").alias("y"))
    once = (F.col("y.c") == F.col("y.top")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * s
    overlap = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = overlap * (100 + s) >= (F.col("x.n") + F.col("y.n")) * s
    met = spread(y, x, ["t"], hot).where((F.col("x.c") != F.col("y.c")) & once & sized & fits)  # of a hot shingle the many are dealt, the strays copied
    out = materialize(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "across")
    discard(all_of)
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links), kept.

    Documents are linked if the Jaccard similarity of their sets of `shingle_words`-word shingles (A-Z lower-cased, words
    split at ASCII white space) is at least `similarity`, given in hundredths. Texts with fewer words have one shingle, the
    whole sequence. Null or wordless texts have none and link with nothing. Rows that share a doc_id are one node with the
    links of each, and n_shingles is of the row; a null doc_id links with nothing, has a null component and is kept. Further columns are ignored, an
    empty table gives an empty result; very long texts are read whole. Of the pairs at just `similarity`, 1.3 in a million
    may be missed, fewer above it: 6.3e-7 by too few collisions of all coordinates (miss_probability), 6.4e-7 by too few of
    the posted ones; no pair below it is linked.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = _signed(docs, shingle_words)
    text = F.struct("c1", "c2")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return _near(docs, signed, shingle_words, similarity)
    return _near_by_row(docs, shingle_words, similarity)


def _signed(docs: DataFrame, shingle_words: int) -> DataFrame:
    return materialize(docs.mapInArrow(_sign(shingle_words), _SIGNED), "signed")


def _near_by_row(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """near_duplicates() where a doc_id has several texts: rows are linked under numbers of their own, then the components that share a doc_id are united."""
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
    near = materialize(_near(numbered, _signed(numbered, shingle_words), shingle_words, similarity), "near")
    of = rows.where("doc_id is not null").select("row", "doc_id").join(near.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("c")), "row")
    of = materialize(of, "of")
    first = of.groupBy("doc_id").agg(F.min("c").alias("first"))
    found = components(salted(of.select("doc_id", "c").distinct(), first, ["doc_id"]).select(F.col("c").alias("a"), F.col("first").alias("b")))
    of = salted(of, found.withColumnRenamed("node", "c"), ["c"], "left").select("doc_id", "n_shingles", F.coalesce("component", "c").alias("c"))
    of = materialize(of, "united")
    out = salted(of, of.groupBy("c").agg(F.min("doc_id").alias("component_id")), ["c"]).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(near.where("doc_id is null"))


def _near(docs: DataFrame, signed: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """near_duplicates() of docs whose doc_ids have one text each, though perhaps in several rows."""
    matches = matches_for(similarity)
    prefix = COORDINATES - matches + 1
    known = signed.where("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    large = hot_keys(classes, "c1", "copies")
    classes = classes.drop("copies")
    later = spread(known.select("doc_id", "c1", "c2"), classes, ["c1", "c2"], large).where("doc_id <> rep").select("doc_id").distinct()
    own = known.join(later, "doc_id", "left_anti").select("doc_id", "n", "s1", "s2", F.slice("keys", 1, prefix).alias("keys"))
    own = materialize(own, "own")
    posted = own.select("doc_id", F.explode("keys").alias("key"))  # narrow: most postings are alone in their list and end here
    shared = materialize(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    hot = hot_keys(shared, "key", "size")
    # A document that has a similar one meets it in most of its coordinates: others are out before any pair is made.
    least = max(m for m in range(1, prefix + 1) if m == 1 or miss_probability(similarity, m, prefix) <= 1e-6)
    met_at = materialize(spread(posted, shared.select("key"), ["key"], hot), "met_at")
    close = materialize(met_at.groupBy("doc_id").count().where(F.col("count") >= least).select("doc_id"), "close")
    lists = materialize(met_at.join(own.drop("keys").join(close, "doc_id", "left_semi"), "doc_id").select("key", "doc_id", "n", "s1", "s2"), "lists")
    discard(shared, met_at)
    pivot = lists.groupBy("key").agg(F.min(F.struct("doc_id", "n", "s1", "s2")).alias("y"))
    keys = materialize(known.join(close, "doc_id", "left_semi").select("doc_id", "keys").dropDuplicates(["doc_id"]), "keys")
    sets = materialize(docs.join(close, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(shingle_words), "doc_id long, shingles array<long>"), "sets")
    met = spread(lists.select("key", F.struct("doc_id", "n", "s1", "s2").alias("x")), pivot, ["key"], hot).where("x.doc_id <> y.doc_id").where(_alike(similarity, matches))
    stars = materialize(met.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct(), "stars")
    links = materialize(_confirmed(stars, keys, sets, similarity, matches), "links")
    found, across = _rounds(lists, components(links), keys, sets, similarity, matches, least)
    if across is not None:
        more = materialize(_confirmed(across, keys, sets, similarity, matches), "more")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        discard(across, more)
    discard(own, close, lists, keys, sets, stars, links)
    # Copies of a class end up with one label.
    label = classes.join(found, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("by_class"))
    out = salted(signed.select("doc_id", "n", "c1", "c2"), label, ["c1", "c2"], "left").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("n") > 0, F.least(F.coalesce("by_class", "component", "doc_id"), F.coalesce("component", "by_class", "doc_id"))).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without documents that have a linked one of smaller doc_id reachable; one document of each group stays."""
    gone = near_duplicates(docs, shingle_words, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
