"""Removal of repeated word passages with difference-cover anchors.

Anchors are short windows that start at cover positions modulo PERIOD. COVER is a perfect difference set: for any two
alignments i, j some shift k < PERIOD puts i + k and j + k at cover positions, so two equal windows of `window` words,
wherever they lie, share an anchor of window - PERIOD + 1 words inside them. Only anchors are counted over the corpus
(4 of 13 positions). Around anchors that occur twice the match is extended: the full windows that contain one are hashed
and grouped, and all but the first occurrence of each are marked.

What a worker can decide within its piece of the input (a repeat with an earlier start in sight) it decides; a passage that
a third of all documents share sends one entry a piece to its bucket, not one a document. Pieces are runs of rows
sorted by document, so a task that is run again makes the same ones. A piece sends rows to the buckets that it has entries
for, at most one an entry, so with many buckets the work still grows with the entries and not with pieces times buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, by_bytes, constants, followed, materialize, mix64, occupied, pack, pack_sorted, power_of_two, salted, text_bytes, unpack, unpack_sorted

PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
#: Words of the input for each bucket of the key space.
BUCKET_WORDS = 1 << 20
#: Words of the texts that one task sorts, and buckets that one task gets, at most: about 50 MB of text and 25 MB of packed entries.
TASK_WORDS, TASK_BUCKETS = 1 << 23, 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def _word_hashes(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the hashes of all of them one after the other, where each text ends."""
    words = [t.split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return words, np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(ends[-1])), ends


def _window_hash(h: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    c, acc = constants(length, seed), np.zeros(at.size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            acc += h[at + j] * c[j]
        return mix64(acc)


def _anchor_at(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of all documents (in the common numbering) and the document of each."""
    n = np.maximum(ends - starts - length + 1, 0)
    doc = np.repeat(np.arange(n.size), n)
    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    chosen = np.isin(local % PERIOD, COVER)
    return (starts[doc] + local)[chosen], doc[chosen]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fps, shas = [], [], []
        for t in text_bytes(batch.column(2)):
            words = t.split() if t else []
            whole = b" ".join(words)
            n.append(len(words))
            fps.append(xxhash.xxh3_128_digest(whole))
            shas.append(hashlib.sha256(whole).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(shas)], names=["doc_id", "th", "n", "fp", "sha"])


#: What goes through a shuffle is packed: entries (kind 0) of one piece of the input for one bucket of the key space, and
#: once a piece (kind 1) its documents, where each begins, and the offsets that it has decided itself.
_ROW = "bucket long, piece long, kind int, a binary, b binary, c binary, d binary"
_HIT = "piece long, kind int, a binary, b binary, c binary, d binary"
_PLACES = "doc_id long, th long, places binary"
_NAMES = ["bucket", "piece", "kind", "a", "b", "c", "d"]


class _Piece:
    """Entries and decided offsets of consecutive documents; an offset is a word's position in the whole piece."""

    def __init__(self, ids: np.ndarray, ths: np.ndarray, starts: np.ndarray, buckets: int):
        self.ids, self.ths, self.starts, self.buckets = ids, ths, starts, buckets
        self.name = xxhash.xxh3_64_intdigest(np.stack([ids, ths, starts]).tobytes()) >> 1

    def batch(self, key: np.ndarray, at: np.ndarray, more: list[np.ndarray], known: np.ndarray, keep_bits: int) -> pa.RecordBatch:
        """key: ascending; of its bits the upper keep_bits are kept. more: further columns of the entries."""
        key = key >> np.uint64(64 - keep_bits)
        out = [(b, self.name, 0, pack_sorted(key[i:j]), pack(at[i:j]), *[pack(m[i:j]) for m in more], *[None] * (2 - len(more))) for b, i, j in occupied(key, keep_bits, self.buckets)]
        out.append((self.name % self.buckets, self.name, 1, self.ids.tobytes(), self.ths.tobytes(), self.starts.tobytes(), pack_sorted(np.unique(known).astype(np.uint64))))
        kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of the input of a task joined to pieces of about 3 chunks, so that more is decided on the spot."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 2 * CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _pieces(batch: pa.RecordBatch, window: int):
    """Of each run of documents: its row range, the identity of its documents, words' hashes and the anchors with their keys."""
    texts = text_bytes(batch.column(2))
    ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for a, b in by_bytes(texts, 2 * CHUNK_BYTES):
        _, h, ends = _word_hashes(texts[a:b])
        starts = np.concatenate([[0], ends[:-1]])
        at, doc = _anchor_at(starts, ends, window - PERIOD + 1)
        yield a, b, ids[a:b], ths[a:b], h, starts, ends, at, doc, _window_hash(h, at, window - PERIOD + 1, 31)


def _anchors(window: int, buckets: int, keep_bits: int):
    """The first place of each anchor in a piece; what occurs twice in the piece is decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merged(batches):
            for _, _, ids, ths, _, starts, _, at, doc, key in _pieces(batch, window):
                order = np.lexsort((at, key))
                key, at, doc = key[order], at[order], doc[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])[: key.size]
                run_no = np.cumsum(new) - 1
                repeated = (np.bincount(run_no) > 1)[run_no] if key.size else np.empty(0, bool)
                once = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: key.size]  # a document needs one place of a key
                yield _Piece(ids, ths, starts, buckets).batch(key[new], at[new], [], at[repeated & once], keep_bits)

    return run


def _windows(window: int, buckets: int):
    """Extend: the windows around repeated anchors; the first place of each in a piece, and later ones as decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merged(batches):
            places = batch.column(3).to_pylist()
            for a, b, ids, ths, h, starts, ends, at, doc, key in _pieces(batch, window):
                hot = np.zeros(at.size, bool)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    lo, hi = cuts[i], cuts[i + 1]
                    found = np.searchsorted(at[lo:hi], starts[i] + _places(places[a + i]))
                    hot[lo:hi] = np.isin(key[lo:hi], key[lo:hi][found[found < hi - lo]])
                inside = np.zeros(h.size + 1, np.int32)
                low, high = np.maximum(at[hot] - PERIOD + 1, starts[doc[hot]]), np.minimum(at[hot], ends[doc[hot]] - window)
                fits = low <= high
                np.add.at(inside, low[fits], 1)
                np.add.at(inside, high[fits] + 1, -1)
                at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                doc = np.searchsorted(ends, at, side="right")
                key, key2 = _window_hash(h, at, window, 32), _window_hash(h, at, window, 33) >> np.uint64(32)
                order = np.lexsort((at, doc, ids[doc], key2, key))
                key, key2, doc, at = key[order], key2[order], doc[order], at[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])])[: key.size]
                origin = np.maximum.accumulate(np.where(new, np.arange(key.size), 0)) if key.size else np.empty(0, np.int64)
                again = np.concatenate([[False], doc[1:] == doc[:-1]])[: key.size] & ~new
                later = (ids[doc] > ids[doc[origin]]) | again
                yield _Piece(ids, ths, starts, buckets).batch(key[~later], at[~later], [key2[~later], ids[doc[~later]].view(np.uint64)], at[later], 64)

    return run


def _places(b: bytes) -> np.ndarray:
    return unpack_sorted(b).astype(np.int64)


def _bucket(decide):
    """Apply decide() to all entries of a bucket; its True ones go on as offsets of their pieces, and kind 1 as it is."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rows = {c: table.column(c).to_pylist() for c in ("a", "b", "c", "d")}
        entries = np.flatnonzero(kind == 0).tolist()
        key = [unpack_sorted(rows["a"][i]) for i in entries]
        more = [np.concatenate([unpack(rows[c][i]) for i in entries]) if entries and rows[c][entries[0]] is not None else None for c in ("c", "d")]
        chosen = decide(np.concatenate(key), *more) if entries else np.empty(0, bool)
        cut = np.cumsum([0, *(k.size for k in key)])
        for j, i in enumerate(entries):
            found = np.sort(unpack(rows["b"][i])[chosen[cut[j] : cut[j + 1]]])
            rows["a"][i] = rows["c"][i] = rows["d"][i] = None
            rows["b"][i] = pack_sorted(found)
        out = pa.table([table.column("piece"), table.column("kind"), *(pa.array(x, pa.binary()) for x in rows.values())], names=_NAMES[1:])
        return out.filter(pa.array([k == 1 or len(b) > 0 for k, b in zip(kind.tolist(), rows["b"], strict=True)]))

    return run


def _twice(key: np.ndarray, *_) -> np.ndarray:
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back] > 1


def _later(key: np.ndarray, key2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an equal key has a smaller doc_id."""
    doc = doc.view(np.int64)
    order = np.lexsort((doc, key2, key))
    k, k2, d = key[order], key2[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
    out = np.empty(key.size, bool)
    out[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(k.size), 0))]
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """The offsets found in a piece, as places in its documents."""
    kind = table.column("kind").to_pylist()
    a, b, c, d = (table.column(x).to_pylist() for x in ("a", "b", "c", "d"))
    k = kind.index(1)
    ids, ths, starts = (np.frombuffer(x[k], np.int64) for x in (a, b, c))
    found = np.unique(np.concatenate([unpack_sorted(d[i]) if n else unpack_sorted(b[i]) for i, n in enumerate(kind)])).astype(np.int64)
    # An empty document begins where the next one does: the last that begins there holds the word.
    doc = np.searchsorted(starts, found, side="right") - 1
    which, first = np.unique(doc, return_index=True)
    ends = np.append(first[1:], found.size)[: which.size]  # a piece without repeats has none
    places = [pack_sorted((found[i:j] - starts[x]).astype(np.uint64)) for x, i, j in zip(which.tolist(), first.tolist(), ends.tolist(), strict=True)]
    return pa.table([pa.array(ids[which]), pa.array(ths[which]), pa.array(places, pa.binary())], names=["doc_id", "th", "places"])


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = text_bytes(batch.column(2)), batch.column(3).to_pylist()
            removed, shas, kept = [], [], []
            for a, b in by_bytes(texts):
                words, h, ends = _word_hashes(texts[a:b])
                for i, ws in enumerate(words):
                    own = h[ends[i] - len(ws) : ends[i]]
                    at = _places(places[a + i])
                    gone = np.zeros(len(ws) + 1, np.int32)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    left = [w for w, g in zip(ws, (np.cumsum(gone[:-1]) > 0).tolist(), strict=True) if not g]
                    removed.append(own.size - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                    shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "th", "n_removed", "kept_sha", "kept_text"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text, where with_text and a word was removed).

    Words are split at ASCII white space and not changed. A word is removed if a window of `window` (13 to 64) consecutive
    words covers it whose word sequence also starts earlier: in a document of smaller doc_id, or earlier in the same one.
    Windows are judged on the input. Null, empty and short texts keep all words. Rows that share a doc_id are no earlier
    than each other; rows with a null doc_id are compared with nothing and keep all words. Further columns are ignored; an
    empty table gives an empty result; very long texts are read whole.
    """
    if not PERIOD <= window <= 64:
        raise ValueError("window must be 13 to 64 words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    heads = materialize(docs.mapInArrow(_heads, "doc_id long, th long, n long, fp binary, sha string"), "heads")
    whole = heads.where(F.col("n") >= window).where("doc_id is not null")
    # Later copies of a whole text go entirely, and the first copy stands for all of them. Hot groups are pre-aggregated.
    copied = whole.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = salted(whole, copied, ["fp"]).where("doc_id > first")
    copies = materialize(copies.select("doc_id", "th").distinct(), "copies")
    words = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = power_of_two(words / BUCKET_WORDS)
    # The texts are dealt as the ids that they meet are. A semi join is moved below a repartition of texts, which would shuffle them twice.
    firsts = followed(whole.join(copies, ["doc_id", "th"], "left_anti").select("doc_id", "th"), -(-words // TASK_WORDS), "doc_id", "th").distinct()
    texts = docs.join(firsts, ["doc_id", "th"], "left_semi")  # its exchange is written once and read three times
    texts = texts.select("doc_id", "th", "text")
    # Anchors are a filter: bits enough that one in a thousand meets another by chance.
    keep_bits = min(64, max(24, int(words).bit_length() + 10))

    def grouped(rows: DataFrame, decide) -> DataFrame:
        tasks = -(-buckets // TASK_BUCKETS)
        hits = followed(rows, tasks, "bucket").groupBy("bucket").applyInArrow(_bucket(decide), _HIT)
        return followed(hits, tasks, "piece").groupBy("piece").applyInArrow(_resolve, _PLACES)

    found = grouped(texts.mapInArrow(_anchors(window, buckets, keep_bits), _ROW), _twice)
    near = texts.join(found, ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    marked = grouped(near.mapInArrow(_windows(window, buckets), _ROW), _later)
    cut = texts.join(marked, ["doc_id", "th"]).select("doc_id", "th", "text", "places").mapInArrow(_kept(window), "doc_id long, th long, n_removed long, kept_sha string, kept_text string")
    cut = cut if with_text else cut.drop("kept_text")
    cut = cut.union(copies.select("doc_id", "th", F.lit(None).cast("long"), F.lit(_NOTHING), *([F.lit("")] if with_text else []))).dropDuplicates(["doc_id", "th"])
    out = heads.join(cut, ["doc_id", "th"], "left")
    gone = F.when(F.col("kept_sha").isNull(), 0).otherwise(F.coalesce("n_removed", "n")).cast("long")
    return out.select("doc_id", F.col("n").alias("n_words"), gone.alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept_text"] if with_text else []))
