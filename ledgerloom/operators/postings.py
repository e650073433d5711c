"""A full-text index that is built once and searched many times: postings by term, in blocks of documents.

Tables below the index's folder:
  postings    a row a (term, block): the documents of the block that have the term, with their counts and lengths in packed arrays, and the
              largest part of a score that any of them can get from the term; in a folder for each bucket of terms, sorted by term
  terms       (term, df), in buckets and sorted likewise
  statistics  one row: documents, average length, blocks, what the index was built of

A block holds documents of like length, about BLOCK of them, so that its maxima say something. A search reads the buckets of its terms, and of
those the row groups that can hold them: first terms, blocks and maxima only, then the blocks that can still reach the k best. Nothing
reads the documents again.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import drop, scratch
from .rank import B, FLOOR, K1

#: Documents of a block, about. Blocks are cut by LENGTHS quantiles of the length, and by a hash of the key within them.
BLOCK, LENGTHS = 1024, 64
#: Postings of a query's terms up to which all of its blocks are read at once: finding out which could be left out would take longer.
PLAIN = 1 << 20
#: Folders of terms.
BUCKETS, LANES = 32, 8


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


#: Tokens, or terms of documents, that a task takes apart at a time.
SLICE = 1 << 20
#: A document's distinct terms one behind the other, their sizes in bytes and their counts (32 bits each).
_COUNTED = ["words", "sizes", "tfs"]


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of n tokens each with about SLICE in all; a longer one stands alone."""
    ends, start = np.cumsum(n, dtype=np.int64), 0
    while start < n.size:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        yield start, end
        start = end


def _binary(cuts: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, pa.py_buffer(cuts.astype(np.int32)), data if data is not None else pa.py_buffer(b"")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the terms of documents (key, toks)."""
    for batch in batches:
        toks = batch.column("toks")
        n = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
        for start, end in _slices(n):
            own = toks.slice(start, end - start).flatten().dictionary_encode()
            pair, tf = np.unique(np.repeat(np.arange(end - start), n[start:end]) * len(own.dictionary) + own.indices.to_numpy(), return_counts=True)
            cuts = np.searchsorted(pair, np.arange(end - start + 1) * len(own.dictionary))
            word = own.dictionary.take(pa.array(pair % max(1, len(own.dictionary))))
            at = np.frombuffer(word.buffers()[1], np.int32, len(word) + 1) if len(word) else np.zeros(1, np.int32)
            columns = [_binary(at[cuts], word.buffers()[2]), *(_binary(cuts * 4, pa.py_buffer(x.astype(np.int32))) for x in (np.diff(at), tf))]
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, end - start), pa.array(n[start:end], pa.int32()), *columns], names=["key", "length", *_COUNTED])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _lists(avg: float):
    """The postings of one block out of its counted documents: a row a term, with everything that build() states of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, words, docs, terms, tfs, seen, known = [], [], [], [], [], [], 0, 0
        for batch in batches:
            block = batch.column("block")[:1]
            keys.append(batch.column("key"))
            lengths.append(batch.column("length").to_numpy())
            n = pc.binary_length(batch.column("sizes")).to_numpy() // 4
            for start, end in _slices(n):
                data, sizes, tf = (batch.column(c).slice(start, end - start) for c in _COUNTED)
                at = np.concatenate([[0], np.cumsum(_numbers(sizes))]).astype(np.int32)
                own = pa.Array.from_buffers(pa.string(), at.size - 1, [None, pa.py_buffer(at), pa.py_buffer(b"".join(data.to_pylist()))]).dictionary_encode()
                docs.append(np.repeat(np.arange(start, end) + seen, n[start:end]))
                terms.append(own.indices.to_numpy().astype(np.int64) + known)
                tfs.append(_numbers(tf))
                words.append(own.dictionary)
                known += len(own.dictionary)
            seen += batch.num_rows
        # Slices number their terms by themselves: one numbering for all, and documents in the order of their keys.
        word = pa.chunked_array(words).combine_chunks().dictionary_encode()
        key = pa.chunked_array(keys).combine_chunks().dictionary_encode()
        length = np.concatenate(lengths).astype(np.int64)
        place = np.empty(len(key.dictionary), np.int64)
        place[pc.sort_indices(key.dictionary).to_numpy()] = np.arange(place.size)
        _, row, number = np.unique(place[key.indices.to_numpy()] * (length.max() + 1) + length, return_index=True, return_inverse=True)
        pair = word.indices.to_numpy().astype(np.int64)[np.concatenate(terms)] * row.size + number[np.concatenate(docs)]
        order = np.argsort(pair, kind="stable")
        pair, tf = pair[order], np.concatenate(tfs)[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, tf = pair[new], np.add.reduceat(tf, new)
        term, at = pair // row.size, row[pair % row.size]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        most = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / avg)), first)
        cuts = pa.array(np.append(first, pair.size), pa.int32())
        columns = [key.dictionary.take(key.indices.take(pa.array(at))), pa.array(tf, pa.int32()), pa.array(length[at], pa.int32())]
        rows = [block.take(pa.array(np.zeros(first.size, np.int64))), word.dictionary.take(pa.array(term[first])), pa.array(np.diff(np.append(first, pair.size)), pa.int32()), pa.array(most), *(pa.ListArray.from_arrays(cuts, c) for c in columns)]
        yield pa.RecordBatch.from_arrays(rows, names=["block", "term", "n", "most", "keys", "tfs", "lengths"])

    return run


def build(docs: DataFrame, key: str, text: Column, path: str, tokenize: Callable[[Column], Column] = X.tokens, source: str = "", block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Write the index of docs below path. key is unique and not null; a null text is an empty one. `source` is kept with the statistics.

    Terms are counted where a document is read, and packed: a row a document is shuffled, to its block, whose postings are then made as whole lists, so
    no row of a (document, term) is ever shuffled, sorted or spilled; a second shuffle brings the lists to the files of their terms, a common term's over as many keys as there are lanes.
    """
    spark = docs.sparkSession
    # Cutting texts is most of the work, so it is done once; what comes of it is deleted when the postings are made.
    cut = scratch(spark, "counted")
    toks = docs.select(F.col(key).alias("key"), tokenize(text).alias("toks"))
    kind = toks.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("length", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in _COUNTED)])
    toks.mapInArrow(_counted, schema).write.parquet(cut)
    docs = spark.read.schema(schema).parquet(cut)
    n, avg, cuts = docs.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0)), F.percentile_approx("length", [i / LENGTHS for i in range(1, LENGTHS)], 10_000)).first()
    cuts = sorted(set(cuts)) if n > block else []
    parts = max(1, -(-n // (block * (len(cuts) + 1))))
    lane = sum((F.when(F.col("length") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = docs.where("length > 0").withColumn("block", (lane * parts + F.pmod(F.xxhash64("key"), F.lit(parts))).cast("int"))
    whole = T.ArrayType(T.IntegerType())
    fields = {"block": T.IntegerType(), "term": T.StringType(), "n": T.IntegerType(), "most": T.DoubleType(), "keys": T.ArrayType(kind), "tfs": whole, "lengths": whole}
    made = T.StructType([T.StructField(*f) for f in fields.items()])
    lists = rows.groupBy("block").applyInArrow(_lists(float(avg) or 1.0), made)
    lists = lists.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "block", "n", "most", "keys", "tfs", "lengths")
    # A common term's rows go to LANES files of its bucket; files are sorted, so their row groups have narrow ranges of terms.
    spread = lists.repartition("bucket", F.col("block") % LANES).sortWithinPartitions("bucket", "term", "block")
    spread.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    drop(cut)
    made = spark.read.schema(lists.schema).parquet(f"{path}/postings")
    terms = made.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    # Written last: an index without statistics is none.
    spark.createDataFrame([(n, float(avg), parts * (len(cuts) + 1), buckets, source, lists.schema.json(), terms.schema.json())], "n long, avg double, blocks int, buckets int, source string, postings string, terms string").coalesce(1).write.parquet(f"{path}/statistics")


class Index:
    """Searches over the tables of build()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.n, self.avg, self.blocks, self.buckets, self.source, *schemas = spark.read.parquet(f"{path}/statistics").first()
        # Folders are listed once; a search then starts at once.
        self._postings, self._terms = (spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(f"{path}/{name}") for s, name in zip(schemas, ("postings", "terms"), strict=True))

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        own = sorted({zlib_bucket(t, self.buckets) for t in terms})
        return table.where(F.col("bucket").isin(own) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Of terms that occur, the number of documents that have them."""
        return {r["term"]: r["df"] for r in self._of(self._terms, terms).select("term", "df").collect()} if terms else {}

    def _parts(self, postings: DataFrame, weight: dict[str, float], part: Callable[[Column, Column], Column]) -> DataFrame:
        """(key, score) of the documents in postings rows."""
        rows = postings.select("term", F.inline(F.arrays_zip("keys", "tfs", "lengths")))
        return rows.select(F.col("keys").alias("key"), (_chosen(weight) * part(F.col("tfs"), F.col("lengths"))).alias("p")).groupBy("key").agg(F.sum("p").alias("score"))

    def tfidf(self, query: list[str]) -> DataFrame:
        """(key, score) as rank.tfidf()."""
        df = self.frequencies(list(dict.fromkeys(query)))
        weight = {t: query.count(t) * (math.log((self.n + 1) / (n + 1)) + 1) for t, n in df.items()}
        return self._parts(self._of(self._postings, list(weight)), weight, lambda tf, _: tf.cast("double"))

    def _idf(self, df: dict[str, int]) -> dict[str, float]:
        return {t: max(math.log((self.n - n + 0.5) / (n + 0.5)), FLOOR) for t, n in df.items()}

    def _bm25(self, postings: DataFrame, weight: dict[str, float]) -> DataFrame:
        return self._parts(postings, weight, lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.avg))))

    def bm25(self, query: list[str], keep: DataFrame | None = None) -> DataFrame:
        """(key, score) as rank.bm25() of every document that has a term. keep: (key) of the documents that a filter lets through."""
        weight = self._idf(self.frequencies(list(dict.fromkeys(query))))
        scored = self._bm25(self._of(self._postings, list(weight)), weight)
        return scored if keep is None else scored.join(keep, "key", "left_semi")

    def bm25_top(self, query: list[str], k: int, keep: DataFrame | None = None, first: int = 4) -> DataFrame:
        """(key, score): the k best by bm25(), ties to the smaller key; exactly those of the whole channel.

        What a block's documents can reach at most is the sum of its terms' maxima. The `first` blocks that reach furthest are scored, and give
        a k-th score to beat; of the others only those are read that can still reach it.
        """
        df = self.frequencies(list(dict.fromkeys(query)))
        weight = self._idf(df)
        order = [F.desc("score"), F.asc("key")]
        own = self._of(self._postings, list(weight))
        if self.blocks <= 2 * first or sum(df.values()) <= PLAIN:
            return self.bm25(query, keep).orderBy(*order).limit(k)
        reach = own.groupBy("block").agg(F.sum(_chosen(weight) * F.col("most")).alias("reach"))
        head = reach.orderBy(F.desc("reach")).limit(first)
        best = self._bm25(own.join(F.broadcast(head.select("block")), "block", "left_semi"), weight)
        best = best if keep is None else best.join(keep, "key", "left_semi")
        low = best.orderBy(*order).limit(k).agg(F.min("score"), F.count("*")).first()
        if low[1] == k:  # a sum in another order may differ in its last places
            own = own.join(reach.where(F.col("reach") >= low[0] * (1 - 1e-9)).select("block"), "block", "left_semi")
        rest = self._bm25(own, weight)
        rest = rest if keep is None else rest.join(keep, "key", "left_semi")
        return rest.orderBy(*order).limit(k)


def zlib_bucket(term: str, buckets: int) -> int:
    """_bucket() of one term, in the driver."""
    return zlib.crc32(term.encode()) % buckets


def _chosen(weight: dict[str, float]) -> Column:
    """The weight of the column term."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term")) if weight else F.lit(0.0)


_open: dict[tuple, Index] = {}


def of_files(docs: DataFrame, key: str, text: str, tokenize: Callable[[Column], Column] = X.tokens) -> Index:
    """The index of a table of files, built when it is first asked for and again whenever its files have changed (names, sizes or times)."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    sign = files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("*")))), 256)).first()[0]
    own = (spark.sparkContext.applicationId, sign, key, text, tokenize.__name__)
    if own not in _open:
        path = scratch(spark, "index")
        build(docs.where(F.col(text).isNotNull()), key, F.col(text), path, tokenize, source=sign)
        _open[own] = Index(spark, path)
    return _open[own]
