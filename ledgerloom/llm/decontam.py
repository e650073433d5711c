"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Block shift tables skip positions at which no test string can end, buckets by the hash of the last block select the
test strings to try, and a direct comparison of word ids confirms each occurrence. The pointers of many stretches of
text advance together, so the search is a few array operations per step instead of a Python loop per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, by_bytes, discard, map_batches, materialize, mix64, place, text_bytes

WINDOW = 13
#: Bytes of benchmark text whose windows are held in memory at once; a larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20
STRETCH = 256
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and all characters from U+0080 on."""
    return text.translate(_KEEP).split() if text else []


class _Length:
    """Shift table and buckets for the test strings of one length.

    words: of the text that the strings come from, a bound on the distinct blocks; the shift table has eight entries each.
    """

    def __init__(self, strings: np.ndarray, words: int, vocabulary: int):
        self.strings, self.m = strings, strings.shape[1]
        self.block = min(2, self.m)
        self.radix = np.int64(vocabulary + 1)
        self.bits = max(12, int(words * 8).bit_length())
        self.coarse = self.bits - min(self.bits, max(12, int(len(strings) * 2).bit_length()))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, dtype=np.int16)
        for end in range(self.block - 1, self.m):
            at = self._hash(strings[:, end - 1] if self.block == 2 else None, strings[:, end])
            np.minimum.at(self.shift, at, np.int16(self.m - 1 - end))
        last = self._hash(strings[:, -2] if self.block == 2 else None, strings[:, -1]) >> self.coarse
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.first = np.searchsorted(last[self.order], np.arange((1 << (self.bits - self.coarse)) + 1)).astype(np.int32)

    def _hash(self, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        code = b if a is None else a * self.radix + b
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions and rows of `strings` of all occurrences in the documents ids[starts:ends]."""
        low, high = starts + self.m - 1, ends
        keep = low < high
        low, high = low[keep], high[keep]
        pieces = -(-(high - low) // STRETCH)
        at = np.repeat(low, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + STRETCH, np.repeat(high, pieces))
        found = []
        while at.size:
            skip = self.shift[self._hash(ids[at - 1] if self.block == 2 else None, ids[at])]
            if (hit := at[skip == 0]).size:
                found.append(hit)
            at = at + np.maximum(skip, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(found)
        where, which = [], []
        for k in range(0, at.size, 50_000):
            part = at[k : k + 50_000]
            bucket = self._hash(ids[part - 1] if self.block == 2 else None, ids[part]) >> self.coarse
            n = (self.first[bucket + 1] - self.first[bucket]).astype(np.int64)
            pos = np.repeat(part, n)
            row = self.order[np.repeat(self.first[bucket], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            same = np.ones(pos.size, bool)
            for j in range(self.m):
                same &= ids[pos - (self.m - 1 - j)] == self.strings[row, j]
            where.append(pos[same])
            which.append(row[same])
        return np.concatenate(where), np.concatenate(which)


class Patterns:
    """The windows of benchmark items: 13 consecutive words, or a shorter item as a whole."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        texts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
            if ids.size:
                texts.setdefault(min(window, ids.size), []).append((len(self.names), ids))
                self.names.append(item)
        self.vocabulary = vocabulary
        self.lengths = [self._of_length(m, own) for m, own in texts.items()]

    def _of_length(self, m: int, texts: list[tuple[int, np.ndarray]]) -> tuple[_Length, np.ndarray, np.ndarray]:
        """The distinct windows of m words; the items of window k are owners[offsets[k]:offsets[k + 1]]."""
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, m) for _, ids in texts])
        owner = np.repeat([i for i, _ in texts], [ids.size - m + 1 for _, ids in texts])
        h = np.zeros(len(windows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(m):
                h = mix64(h * np.uint64(3) + windows[:, j].astype(np.uint64))
        order = np.argsort(h, kind="stable")
        windows, owner = windows[order], owner[order]
        # Equal windows have equal hashes; where different ones share a hash, a window may stay twice, which changes no result.
        new = np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)])
        pairs = np.unique((np.cumsum(new) - 1) * np.int64(len(self.names)) + owner)
        group, owners = np.divmod(pairs, np.int64(len(self.names)))
        offsets = np.searchsorted(group, np.arange(int(new.sum()) + 1)).astype(np.int32)
        return _Length(windows[new], sum(ids.size for _, ids in texts), len(self.vocabulary)), offsets, owners.astype(np.int32)

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[str | None]]]:
        """For each text: its number of words, which of them are hit, the items found."""
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], dtype=np.int64)
        total = int(ends[-1]) if len(texts) else 0
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), np.int64, total)
        mark, items = np.zeros(total + 1, np.int32), {}
        for length, offsets, owners in self.lengths:
            where, which = length.occurrences(ids, starts, ends)
            np.add.at(mark, where - length.m + 1, 1)
            np.add.at(mark, where + 1, -1)
            rows = np.int64(len(length.strings))
            for pair in np.unique(np.searchsorted(ends, where, side="right") * rows + which).tolist():
                d, row = divmod(pair, int(rows))
                items.setdefault(d, set()).update(self.names[i] for i in owners[offsets[row] : offsets[row + 1]])
        hit = np.cumsum(mark[:total]) > 0
        for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            yield b - a, hit[a:b], items.get(d, set())


def _pass(patterns, first: bool, final: bool, only_clean: bool):
    """One pass over the documents, as they are (first) or as (row, hits, items) of the pass before; the last gives the results, or the rows that are clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = patterns.value.search
        for batch in batches:
            row = batch.to_struct_array() if first else batch.column(0)
            columns = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
            texts = text_bytes(columns[list(columns)[place(list(columns), "text")]])
            old_hits, old_items = (None, None) if first else (batch.column(k).to_pylist() for k in (1, 2))
            hits, items, count = [], [], []
            for a, b in by_bytes(texts):
                for i, (n, hit, found) in enumerate(search(texts[a:b]), a):
                    if not first:
                        hit = hit | np.unpackbits(np.frombuffer(old_hits[i], np.uint8), count=n).astype(bool)
                        found = found | set(old_items[i])
                    count.append(n)
                    hits.append(int(hit.sum()) if final else np.packbits(hit).tobytes())
                    items.append(found)
            if not final:
                yield pa.RecordBatch.from_arrays([row, pa.array(hits, pa.binary()), pa.array([list(x) for x in items], pa.list_(pa.string()))], names=["row", "hits", "items"])
                continue
            bad = pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, count, strict=True)], pa.bool_())
            if only_clean:
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pc.invert(bad))
                continue
            kept = {name: c for name, c in columns.items() if name.lower() not in _OUT}
            names = [",".join(sorted(x - {None})) for x in items]
            new = [pa.array(count, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()), bad]
            yield pa.RecordBatch.from_arrays([*kept.values(), *new], names=[*kept, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


_OUT = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, any other columns) with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is `window` consecutive words of an item, or a whole shorter item. A document is contaminated if a word of
    it is hit and the hit words are at least a twentieth of its words. Null and empty texts have no words and are clean; very
    long texts are searched whole; rows are judged one by one, so repeats repeat. Items without words have no window; repeated
    items count once per item_id; items with a null item_id hit like others, and together count as one item, without a name
    in items_sha256; an empty benchmark hits nothing, an empty table gives an empty result. Columns of docs that have the names
    of results are replaced, others, however named, come back unchanged. No shuffle: each document is judged where it is read. The
    windows are broadcast in blocks of about `block_bytes` of distinct benchmark texts (a longer text stands alone), whatever
    items they belong to; with more than one block, the documents pass once per block and carry their hits along.
    """
    return _searched(docs, benchmark, window, block_bytes, only_clean=False)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that decontaminate() calls contaminated; all columns, those named like results too, come back unchanged."""
    return _searched(docs, benchmark, window, block_bytes, only_clean=True)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, only_clean: bool) -> DataFrame:
    spark = docs.sparkSession
    result = docs.schema if only_clean else appended(docs.schema, RESULT)
    row = T.StructType([T.StructField("row", docs.schema), *T._parse_datatype_string("hits binary, items array<string>").fields])
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    items = materialize(items, "benchmark") if blocks > 1 else items
    before = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Patterns([(r["item"], bytes(r["text"])) for r in part], window))
        final = k == blocks - 1
        docs = map_batches(docs, _pass(shared, k == 0, final, only_clean), result if final else row)
        if not final:
            docs = materialize(docs, f"decontam{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
