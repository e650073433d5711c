"""Audit of how the vocabularies of sources diverge within a language: wide term vectors, contributions of pairs, exact sums.

Each kept term of a language becomes one vector, indexed by the language's sources in order and ended by the language's own count.
Scaled probabilities are whole numbers, so sums do not depend on the order in which rows meet. Contributions of pairs are made by
JVM higher-order functions and summed before the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, materialize, place, quoted, salted, text_bytes

#: Letters A-Z and a-z, and all beyond ASCII: as bytes of UTF-8, those from 0x80.
_TERM, _GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
#: Different terms that a Python worker counts before it hands them on.
MOST_TERMS = 200_000
#: Rows handed to Spark at a time.
_ROWS = 20_000


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about CHUNK_BYTES, cut between terms."""
    at = 0
    while len(text) - at > CHUNK_BYTES and (gap := _GAP.search(text, at + CHUNK_BYTES)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of what this task has seen; a group's row of the empty term says that the group occurs."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for k in range(0, len(terms), _ROWS):
                some = terms[k : k + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            if (lang, source) not in found:
                found[lang, source] = Counter({b"": 0}), Counter()
            n, docs = found[lang, source]
            before, seen = len(n), set()
            for piece in _pieces(text.lower()):  # of bytes, lower() changes A-Z only
                terms = _TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
            if held > MOST_TERMS:
                yield from handed()
                held = 0
    yield from handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that have it. Every group has a row of
    the empty term with n 0. Null lang, source and text are ''."""
    plain = docs.select(*[F.coalesce(quoted(docs.columns[place(docs.columns, c)]).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _totals(vectors: DataFrame) -> DataFrame:
    """(lang, totals, v): for each place of the vectors the sum over terms, and the number of terms."""
    cells = vectors.select("lang", F.posexplode("counts").alias("at", "c")).groupBy("lang", "at").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("t"), F.max("v").alias("v"))
    return rows.select("lang", F.col("t.c").alias("totals"), "v")


def audit(docs: DataFrame, min_docs: int = 30, added: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group of (lang, source) is from the other sources of its language.

    A term is a run of letters and characters beyond ASCII, with A-Z lower-cased; a language keeps those in at least `min_docs` of its
    rows. p = 1 + floor(scale * (count + added) / (N + added * V)), N the group's occurrences of the V kept terms.
    Part "pair": item is another source of the language, value the sum of |p - q| over kept terms (0 without kept terms). Part "term":
    item is a kept term that occurs in the group more often than in its language by p, value the difference, the `top` largest only.
    rank counts from 1 in each group and part, by value descending and item (bytes of UTF-8) ascending.

    Null and empty texts have no terms, but their groups occur; null lang and source are ''. Texts of any length are counted in pieces.
    A row counts as a document, repeated rows as several. An empty table gives no rows. Columns other than lang, source and text are
    not read. Terms of a language meet in vectors as long as its number of sources, so a language with S sources costs S * S for each term,
    as many as the rows of "pair" that it gives.
    """
    counts = term_counts(docs)
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    wide = materialize(wide.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "terms")
    langs = wide.where("term = ''").select("lang", F.sort_array("by.source").alias("sources"))
    named = salted(wide.where("term <> ''"), langs, ["lang"]).withColumn("own", F.map_from_entries("by"))
    dense = named.select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.col("own")[s], F.lit(0).cast("long"))).alias("c"))
    vectors = materialize(dense.select("lang", "term", F.expr("concat(c, array(aggregate(c, 0L, (a, x) -> a + x)))").alias("counts")), "vectors")

    stats = materialize(langs.join(_totals(vectors), "lang", "left"), "totals")
    p = F.expr(f"transform(counts, (c, i) -> 1 + (cast({scale} as decimal(18, 0)) * cast(c + {added} as decimal(19, 0))) div cast(totals[i] + {added} * v as decimal(19, 0)))")
    scored = salted(vectors, stats, ["lang"]).withColumn("p", p).withColumn("places", F.expr("sequence(0, size(sources) - 1)"))

    pairs = "inline(flatten(transform(places, a -> transform(filter(places, b -> b > a), b -> struct(a, b, {} as f)))))"
    made = scored.select("lang", F.expr(pairs.format("abs(p[a] - p[b])")))
    none = langs.withColumn("places", F.expr("sequence(0, size(sources) - 1)")).select("lang", F.expr(pairs.format("0L")))  # a pair occurs without terms, too
    sums = salted(made.unionByName(none).groupBy("lang", "a", "b").agg(F.sum("f").alias("value")), langs, ["lang"])
    both = sums.select("lang", "value", F.expr("inline(array(struct(sources[a] as source, sources[b] as item), struct(sources[b] as source, sources[a] as item)))"))
    above = "inline(filter(transform(places, i -> struct(sources[i] as source, if(counts[i] > 0, p[i] - p[size(sources)], 0L) as value)), x -> x.value > 0))"
    terms = scored.select("lang", F.col("term").alias("item"), F.expr(above))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(both, "pair").unionByName(columns(terms, "term").where(F.col("rank") <= top))
