"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

Documents are dealt into blocks by a hash of their id and text. Each block is exploded into its distinct n-grams of each order
with their counts; these rows, packed by (block, hash bucket), go to their bucket, where the count table of the bucket is
built from all blocks and joined back to the rows it came from; the counts return to the block, whose documents sum
the logarithms of their scores. An n-gram is one entry a block however often it occurs, so frequent n-grams make no hot
task, and a bucket holds a bounded share of the table. Both passes read one exchange of the documents. A block sends rows to
the buckets that it has n-grams for, at most one an n-gram: with more buckets than a block has n-grams, packing gains nothing
and the work is that of single rows, still in proportion to the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, mix64, occupied, pack_sorted, power_of_two, text_bytes, unpack_sorted

ALPHA = 0.4
#: Text in a block and packed n-grams in a bucket, in bytes; their numbers follow from the size of the input.
BLOCK_BYTES, BUCKET_BYTES = 5 << 20, 16 << 20
#: Text for each task of a shuffle.
TASK_BYTES = 12 << 20
_PACKED = "block long, bucket long, ord int, grams binary, counts binary"


def _grams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for n = 1 to order, the hashes of the n-grams and the position of the last word of each."""
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(n.sum()))
    local = np.arange(h.size) - np.repeat(np.cumsum(n) - n, n)
    out, c = [], constants(order + 1, 41)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            at = np.flatnonzero(local >= k - 1)
            acc = np.full(at.size, c[order] * np.uint64(k), np.uint64)
            for j in range(k):
                acc += h[at - (k - 1 - j)] * c[j]
            out.append((mix64(acc), at))
    return n, out


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _restore(b: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _sorted_rows(table: pa.Table) -> pa.Table:
    """The order that makes both passes see a block alike; rows that tie are equal."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for t in texts if t)], pa.int64()), pa.array([sum(len(t.split()) for t in texts if t)], pa.int64())], names=["bytes", "words"])


def _explode(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        texts = text_bytes(_sorted_rows(table).column("text"))
        out = {"block": [], "bucket": [], "ord": [], "grams": [], "counts": []}
        _, grams = _grams(texts, order)
        block = table.column("block")[0].as_py()
        for k, (h, _) in enumerate(grams, 1):
            own, count = np.unique(h, return_counts=True)
            for b, i, j in occupied(own, 64, buckets):
                for name, x in zip(out, (block, b, k, pack_sorted(own[i:j]), _squeeze(count[i:j].astype(np.int64))), strict=True):
                    out[name].append(x)
        return pa.table({"block": pa.array(out["block"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()), "ord": pa.array(out["ord"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket: the totals over all blocks, for the n-grams of each row."""
    order, grams, counts = (table.column(c).to_pylist() for c in ("ord", "grams", "counts"))
    totals: list[bytes] = [b""] * len(order)
    for k in set(order):
        rows = [i for i, o in enumerate(order) if o == k]
        n = [_restore(counts[i]) for i in rows]
        keys, back = np.unique(np.concatenate([unpack_sorted(grams[i]) for i in rows]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(n), minlength=keys.size).astype(np.int64)[back]
        at = np.cumsum([0, *(x.size for x in n)])
        for j, i in enumerate(rows):
            totals[i] = _squeeze(total[at[j] : at[j + 1]])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ord": table.column("ord"), "totals": pa.array(totals, pa.binary())})


def _score(order: int, alpha: float, leave_one_out: bool, every: int):
    """every: the words of all documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted_rows(left)
        n, grams = _grams(text_bytes(left.column("text")), order)
        rows = sorted(zip(right.column("ord").to_pylist(), right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True))
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(n.size), n)
        seen = np.full((order + 1, int(n.sum())), 0.0)  # of the k-gram that ends at a word: its count elsewhere
        for k, (h, at) in enumerate(grams, 1):
            own, back = np.unique(h, return_inverse=True)
            total = np.concatenate([np.empty(0, np.int64), *(_restore(t) for o, _, t in rows if o == k)])[back].astype(float)
            if leave_one_out:
                both = doc[at] * np.int64(own.size) + back
                _, inner, times = np.unique(both, return_inverse=True, return_counts=True)
                total -= times[inner]
            seen[k, at] = total
        rest = np.maximum(every - (n[doc] if leave_one_out else 0), 1.0)
        logs = np.log(np.maximum(seen[1], 1.0) / rest) + (order - 1) * math.log(alpha)  # as if backed off from all orders
        start = np.repeat(ends - n, n)
        place = np.arange(doc.size) - start
        logs -= np.maximum(0, order - 1 - place) * math.log(alpha)  # at the start of a text there is less to back off from
        done = np.zeros(doc.size, bool)
        for k in range(order, 1, -1):
            before = np.concatenate([[0.0], seen[k - 1][:-1]])  # the context ends one word earlier
            good = ~done & (place >= k - 1) & (seen[k] > 0) & (before > 0)
            steps = np.minimum(order, place + 1) - k
            logs[good] = (np.log(seen[k][good] / before[good]) + steps[good] * math.log(alpha))
            done |= good
        total = np.bincount(doc, weights=logs, minlength=n.size)
        mean = [t / m if m else None for t, m in zip(total.tolist(), n.tolist(), strict=True)]
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(total if n.size else [], pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    return run


def score(docs: DataFrame, order: int = 2, alpha: float = ALPHA, leave_one_out: bool = True, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, log_score (sum over its words of the log of the stupid-backoff score), mean_log_score.

    Words are split at ASCII white space. S(w | context) is count(context w) / count(context) if both are above 0, else
    alpha times the score with a context one word shorter; a single word scores count / number of words, an unseen one as
    if it had been seen once. Counts are of all documents; with leave_one_out those of the document itself are taken off, or
    each text would be its own evidence. Very long texts are scored whole, in a block of their own size. Null and wordless texts have n_words 0, log_score 0 and a null mean. Repeated rows
    count as further documents. Rows with a null doc_id are scored too. Further columns are ignored; an empty table gives
    an empty result.
    """
    size, words = docs.select("text").mapInArrow(_size, "bytes long, words long").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    buckets = power_of_two(size * order / bucket_bytes)
    # Tasks follow the input, so the largest one does not.
    tasks = max(1, -(-size // TASK_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(tasks, "block")
    packed = dealt.groupBy("block").applyInArrow(_explode(order, buckets), _PACKED)
    counted = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_count, "block long, bucket long, ord int, totals binary")
    scored = dealt.groupBy("block").cogroup(counted.repartition(tasks, "block").groupBy("block"))
    return scored.applyInArrow(_score(order, alpha, leave_one_out, words), "doc_id long, n_words long, log_score double, mean_log_score double")
