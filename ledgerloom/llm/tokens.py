"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The character spans of its tokens are joined to the spans of its sections, and a
token that crosses a boundary is allocated by a stated rule: `start` (to the section of its first character, the
default), `end` (of its last) or `most` (of most of its characters, ties to the earlier). Each token counts once, so a
document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most")
#: A public vocabulary as ranks, and its pattern for pieces (both parameters of attribute()).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROW = "doc_id long, section int, start long, end long, n_tokens long"


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The encoder and the length in bytes of each token."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes


#: White space of this length is cut into pieces here: the encoder's pattern engine recurses over it and dies of a million.
LONG_SPACE = 1000
_LONG = regex.compile(rf"\s{{{LONG_SPACE},}}")


def encode(text: str, encoder) -> list[int]:
    """The encoder's tokens of text, of any text: what holds long white space is cut into the pattern's pieces by an engine
    that does not recurse, and the encoder merges the bytes of each piece."""
    if not _LONG.search(text):
        return encoder.encode_ordinary(text)
    out: list[int] = []
    for m in regex.finditer(encoder._pat_str, text):
        out += encoder._encode_single_piece(m[0].encode("utf-8", "replace"))
    return out


def token_spans(text: str, coder) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (inclusive) of every token; a token may hold a part of a character."""
    encoder, sizes = coder
    ids = np.array(encode(text, encoder), np.int64)
    ends = np.cumsum(sizes[ids])
    if text.isascii():
        return ends - sizes[ids], ends - 1
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[ends - sizes[ids]], char[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token: an interval join of sorted spans. starts: where sections begin, the first at 0."""
    a, b = (np.searchsorted(starts, x, side="right") - 1 for x in (first, last))
    if rule == "start":
        return a
    if rule == "end":
        return b
    best, most = a.copy(), np.where(a == b, last - first + 1, np.append(starts, np.iinfo(np.int64).max)[a + 1] - first)
    for k in np.flatnonzero(a != b):
        for s in range(a[k] + 1, b[k] + 1):
            size = min(last[k] + 1, starts[s + 1] if s + 1 < len(starts) else last[k] + 1) - starts[s]
            if size > most[k]:
                best[k], most[k] = s, size
    return best


def sections(text: str, split: str = "\n") -> np.ndarray:
    """Where the sections of text begin; the separator belongs to the section that it ends."""
    return np.array([0, *(m.end() for m in re.finditer(re.escape(split), text) if m.end() < len(text))], np.int64)


def attribute(docs: DataFrame, rule: str = "start", fields: list[str] | None = None, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, start, end (characters of the whole, end exclusive), n_tokens; a row for each section of each document.

    Sections are the lines of `text`, or the given fields (joined by line ends into the whole that is encoded; a null
    field is an empty one, and section k is the k-th field with its line end). A null or empty text has the section 0
    with no token. A section without a token is kept with 0; very long texts are encoded whole, runs of one character of any
    length included. Rows are taken one by one: repeats repeat, a null doc_id stays null, an empty table gives an empty
    result. Further columns, however named, are ignored. No shuffle: tokens and sections of a document meet where it is read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as f:  # on the driver; a vocabulary has a fixed size
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    whole = [F.col("text")] if fields is None else [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(shared.value, pattern)
        for batch in batches:
            parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for row in range(batch.num_rows):
                if fields is None:
                    text = batch.column(1)[row].as_py() or ""
                    starts = sections(text)
                else:
                    given = [batch.column(1 + k)[row].as_py() for k in range(len(fields))]
                    text = "\n".join(given)
                    starts = np.cumsum([0, *(len(g) + 1 for g in given[:-1])]).astype(np.int64)
                first, last = token_spans(text, coder) if text else (np.empty(0, np.int64),) * 2
                found = np.bincount(allocate(first, last, starts, rule), minlength=len(starts))
                parts.append((row, starts, np.append(starts[1:], len(text)), found))
                held += len(starts)
                if held > 100_000 or row == batch.num_rows - 1:
                    size = [len(p[1]) for p in parts]
                    ids = batch.column(0).take(pa.array(np.repeat([p[0] for p in parts], size)))
                    number = np.concatenate([np.arange(n, dtype=np.int32) for n in size])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(number), *(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in (1, 2, 3))], names=["doc_id", "section", "start", "end", "n_tokens"])
                    parts, held = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"f{k}") for k, c in enumerate(whole)]).mapInArrow(run, _ROW)


def count_tokens(docs: DataFrame, **how) -> DataFrame:
    """doc_id with n_tokens and n_sections, totals over the sections of attribute(); rows that share a doc_id are added up."""
    return attribute(docs, **how).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"))
