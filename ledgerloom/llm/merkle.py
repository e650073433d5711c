"""A Merkle manifest of a dataset: one tree for each source, one above their roots, and for each row the proof that it is in it.

Rows get their index by a range partitioning, with counts of partitions summed, so no source is ordered in one task. Each level is a
DataFrame: nodes are grouped by floor(index / fanout) and the ordered digests of a run are hashed into its parent. On the way
down, level by level, the runs of a level are joined to their parents' proofs, one row to one, and the siblings in the run are put before
them: a top node is met by the few nodes below it, never by all rows under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, place, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings, or arrays of strings, in a row."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row: of each value "-" if it is null, else its number of bytes in UTF-8, a colon and itself."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(*[one(v.cast("string")) for v in values])


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, their place in the order within their group g (from 0), and n, the rows of the group. Rows alike in the order follow
    one another in any way; they are dealt over partitions too, so rows should be a table that has been written."""
    by = [F.col(c).asc_nulls_first() for c in ["g", *order]]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "placed").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy("g")
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("n"))
    return placed.join(parts, ["g", "_part"]).withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The trees above nodes (g, i, n, h, x), one for each g: for each level its runs (g, p, n, kids, h). kids are the run's nodes in
    order, h is the parent's digest; of a group with one node left (n = 1) that node is the root and h its own digest."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        runs = nodes.groupBy("g", F.expr(f"i div {fanout}").alias("p")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "h", "x"))).alias("kids"))
        out.append(materialize(runs.withColumn("h", F.when(F.col("n") == 1, F.col("kids")[0]["h"]).otherwise(digest(F.col("kids.h")))), "runs"))
        if most <= 1:
            return out
        most = -(-most // fanout)
        nodes = out[-1].where("n > 1").select("g", F.col("p").alias("i"), F.expr(f"(n + {fanout} - 1) div {fanout}").alias("n"), "h", F.lit(0).alias("x"))


def roots(tree: list[DataFrame]) -> DataFrame:
    """(g, level, h): the root of each group, and the level at which it is alone."""
    out = None
    for k, runs in enumerate(tree):
        own = runs.where("n = 1").select("g", F.lit(k).alias("level"), "h")
        out = own if out is None else out.unionByName(own)
    return out


def proofs(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """For each node of the lowest level (g, x, h, path, ...): path has, for each level up, the siblings in the run and the node's place
    among them. tops: (g, level, path, ...), where each group's root stands, the path above it and what else goes down with it."""
    carried, above = [c for c in tops.columns if c not in ("g", "level", "path")], None
    for k in range(len(tree) - 1, -1, -1):
        parents = tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("p"), "path", *carried)
        parents = parents if above is None else parents.unionByName(above.select("g", F.col("i").alias("p"), "path", *carried))
        met = tree[k].select("g", "p", "n", "kids").join(parents, ["g", "p"])
        each = met.select("g", "n", F.col("kids.h").alias("hs"), "path", *carried, F.posexplode("kids").alias("at", "kid"))
        others = F.filter("hs", lambda h, i: i != F.col("at"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct(others.alias("sibs"), F.col("at"))), F.col("path")))
        above = each.select("g", F.col("kid.i").alias("i"), F.col("kid.x").alias("x"), F.col("kid.h").alias("h"), path.alias("path"), *carried)
    return above


def fold(start: Column | str, path: Column | str) -> Column:
    """The root that follows from a leaf's digest and its path."""
    start, path = (F.col(c) if isinstance(c, str) else c for c in (start, path))
    return F.aggregate(path, start, lambda h, e: digest(F.slice(e["sibs"], F.lit(1), e["at"]), F.array(h), F.slice(e["sibs"], e["at"] + 1, F.size(e["sibs"]))))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = 16) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs (doc_id, source, lang, n_chars, text).

    Rows of a source are ordered by doc_id, nulls first, then by leaf; sources by their bytes in UTF-8, null first. subroot is the root of the
    source's tree, root that above all. proof_sha256 is the digest of the siblings of each level up to the root. folded_root is recomputed
    from the row as it is found now and the proof; verified says whether it is root. tampered: an expression over docs, true
    where the text is found with A-Z lower-cased; without it nothing is tampered with.

    Null values are part of the leaf, and a null source is a source. Empty and long texts are hashed whole. Repeated rows have a place
    each, in any order, and differ by their proofs only. An empty table gives no rows. Other columns are not read.
    """
    own = {c: quoted(docs.columns[place(docs.columns, c)]) for c in FIELDS}
    bad = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lowered = {**own, "text": F.translate(own["text"].cast("string"), UPPER, LOWER)}
    g = F.when(own["source"].isNull(), "").otherwise(F.concat(F.lit("+"), own["source"].cast("string")))
    rows = docs.select(g.alias("g"), own["doc_id"].alias("doc_id"), leaf([*own.values()]).alias("h"), F.when(bad, leaf([*lowered.values()])).alias("now"))
    nodes = indexed(materialize(rows, "leaves"), ["doc_id", "h"])
    tree = levels(nodes.select("g", "i", "n", "h", F.struct("doc_id", "now").alias("x")), fanout)

    subroots = materialize(roots(tree), "subroots")
    above = indexed(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "level", "h"), ["source"])
    upper = levels(above.select("g", "i", "n", "h", F.struct("source", "level").alias("x")), fanout)
    tops = roots(upper).select("g", "level", F.array().cast("array<struct<sibs:array<string>,at:int>>").alias("path"), F.col("h").alias("root"))
    tops = proofs(upper, tops).select(F.col("x.source").alias("g"), F.col("x.level").alias("level"), "path", "root", F.col("h").alias("subroot"))

    out = proofs(tree, materialize(tops, "tops"))
    out = out.select("x.doc_id", F.col("h").alias("leaf"), "subroot", "root", digest(F.flatten("path.sibs")).alias("proof_sha256"), fold(F.coalesce("x.now", "h"), "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
