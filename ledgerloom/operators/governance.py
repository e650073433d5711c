"""Which decisions govern a path: path references, coverage, concepts, citation tiers, standing rulings.

A reference governs a path if it is equal, an ancestor or a descendant by whole segments, or a matching glob. The first
three are equi-joins, for references with and without glob characters: paths are exploded into their ancestors and met with
the references, and the other way round. Matches of globs are added: a path meets a glob by a gram of the longest part without a wildcard
that it has, wherever in the path that may stand, so globs without a directory are no exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions import text as X
from . import patterns


def ref_path(ref: Column) -> Column:
    """The path of a reference: before its fragment, without a slash at its end."""
    return F.regexp_replace(F.substring_index(ref, "#", 1), "/+$", "")


def is_named(ref: Column) -> Column:
    return ref_path(ref) != ""


def is_glob(ref: Column) -> Column:
    return ref_path(ref).rlike(r"[*?\[]")


def is_anchorable(ref: Column) -> Column:
    return is_named(ref) & ~is_glob(ref)


def matches(path: Column, ref: Column) -> Column:
    """Row-level predicate, for pairs that are already together."""
    r = ref_path(ref)
    return is_named(ref) & ((path == r) | path.startswith(F.concat(r, F.lit("/"))) | r.startswith(F.concat(path, F.lit("/"))) | F.rlike(path, X.glob_pattern(r)))


def ancestors(path: Column) -> Column:
    """The path and all directories above it."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != "")


def govern(paths: DataFrame, refs: DataFrame, path: str = "path", ref: str = "ref") -> DataFrame:
    """paths joined with the refs that govern them: each pair once. Columns of both."""
    named = refs.where(is_named(F.col(ref))).withColumn("_r", ref_path(F.col(ref)))
    # Equal, ancestor and descendant hold for globs as well: their characters count literally there.
    down = paths.withColumn("_p", F.explode(ancestors(F.col(path)))).join(named, F.col("_p") == F.col("_r"))
    up = paths.join(named.withColumn("_a", F.explode(ancestors(F.col("_r")))), F.col(path) == F.col("_a")).where(F.col("_a") != F.col("_r"))
    keep = [*paths.columns, *refs.columns]
    out = down.select(*keep).unionByName(up.select(*keep))
    pattern = named.where(is_glob(F.col(ref))).withColumn("_glob", X.glob_pattern(F.col("_r")))
    met = patterns.matched(paths, path, pattern, "_glob", patterns.glob_literals(F.col("_r")), least=1)
    return out.unionByName(met.select(*keep)).dropDuplicates()


def unmapped(paths: DataFrame, topic_refs: DataFrame, concept_refs: DataFrame, ignored: Column | None = None) -> DataFrame:
    """paths with class: mapped_topic, mapped_concept_only, unmapped or ignored."""
    by_topic = govern(paths.select("path"), topic_refs).select("path").distinct().withColumn("_t", F.lit(True))
    by_concept = govern(paths.select("path"), concept_refs).select("path").distinct().withColumn("_c", F.lit(True))
    skip = ignored if ignored is not None else F.lit(False)
    out = paths.join(by_topic, "path", "left").join(by_concept, "path", "left")
    return out.withColumn("class", F.when(skip, "ignored").when(F.col("_t"), "mapped_topic").when(F.col("_c"), "mapped_concept_only").otherwise("unmapped")).drop("_t", "_c")


def attach_concepts(hits: DataFrame, concept_refs: DataFrame) -> DataFrame:
    """hits (path, symbol, qualified_name) with concept_id: one that names the symbol before one that holds the file."""
    met = govern(hits.select("path").distinct(), concept_refs)
    fragment = F.nullif(F.substring_index(F.concat(F.col("ref"), F.lit("#")), "#", 2), F.col("ref"))
    named = F.when(F.contains(F.col("ref"), F.lit("#")), F.regexp_extract("ref", "#(.*)$", 1))
    met = met.select(F.col("path").alias("_path"), "ref", "concept_id", named.alias("_f"))
    both = hits.join(met, (F.col("path") == F.col("_path")) & (F.col("_f").isNull() | (F.col("_f") == F.col("symbol")) | (F.col("_f") == F.col("qualified_name"))), "left")
    best = Window.partitionBy(*hits.columns).orderBy(F.col("_f").isNull(), "concept_id", "ref")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*hits.columns, "concept_id")


def tier(status: Column, authority: Column, evidence: Column, has_invariant: Column | None = None) -> Column:
    """CONSTRAINT, HOLD or CONTEXT of a ruling; with has_invariant, an agent's inference also needs one to be a HOLD."""
    held = values.validated_evidence(evidence) & authority.isin(fixed.AUTHORITIES[2:])
    if has_invariant is not None:
        held = held & ((authority != "agent-inference") | has_invariant)
    return F.when(~F.coalesce(status == "active", F.lit(False)), "CONTEXT").when(authority.isin(fixed.OWNER_AUTHORITIES), "CONSTRAINT").when(held, "HOLD").otherwise("CONTEXT")


def standing_eligible(status: Column, authority: Column, text: Column) -> Column:
    single = ~text.rlike("[\\r\\n\\u0085\\u2028\\u2029]")
    return F.coalesce((status == "active") & authority.isin(fixed.OWNER_AUTHORITIES) & (text != "") & single, F.lit(False))


def promotable(status: Column, authority: Column, promoted_by: Column) -> Column:
    return F.coalesce(authority.isin(fixed.AUTHORITIES[2:]) & status.isin("active", "provisional"), F.lit(False)) & promoted_by.isNull()


def link_number(link: Column) -> Column:
    return F.regexp_extract(link, r"L(\d+)", 1).try_cast("int")


def current_links(links: DataFrame, topic: str = "topic_path") -> DataFrame:
    """The first active link of each topic in file order (seq), not by date."""
    return links.where("status = 'active'").groupBy(topic).agg(F.min_by("link", "seq").alias("current"))


def chain(links: DataFrame, edges: DataFrame, assumptions: DataFrame) -> DataFrame:
    """links newest first (seq) with their edges and broken assumptions."""
    e = edges.groupBy("topic_path", "link").agg(F.array_sort(F.collect_list(F.struct("rel", "to_ref"))).alias("edges"))
    a = assumptions.where("status = 'broken'").groupBy("topic_path", "link").agg(F.array_sort(F.collect_list("aid")).alias("broken"))
    return links.drop("edges", "broken").join(e, ["topic_path", "link"], "left").join(a, ["topic_path", "link"], "left").orderBy("topic_path", "seq")


def chain_line(link: Column, date: Column, kind: Column, reverses: Column, reason: Column, ruling: Column, authority: Column, rationale: Column) -> Column:
    """One line of a chain: what a link is, what it reverses and why, its ruling (in quotes if an owner's), authority and rationale."""
    back = F.concat(F.lit("<- reverses "), reverses, F.coalesce(F.concat(F.lit(" ("), reason, F.lit(")")), F.lit("")))
    words = X.flat_line(ruling)
    words = F.when(authority.isin(fixed.OWNER_AUTHORITIES), F.concat(F.lit('"'), words, F.lit('"'))).otherwise(words)
    return F.concat_ws(" ", link, date, kind, back, words, F.concat(F.lit("("), authority, F.lit(")")), F.concat(F.lit("because "), X.flat_line(rationale)))


def running_bytes(rows: DataFrame, text: Column, order: list[Column], partition: list[str]) -> DataFrame:
    """rows with the bytes of text, one more a row for its line end, summed up in order."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes_so_far", F.sum(F.octet_length(text).cast("long") + 1).over(w))


def standing_digest(rows: DataFrame, most_links: int = 24, most_bytes: int = 4800, by: list[str] | None = None) -> DataFrame:
    """One row a store (or `by`): text, sha256, bytes and links of the digest over rows (topic, link, text), or the reason to refuse.

    Numeric link order; the cap covers the whole text; nothing is cut to fit.
    """
    line = F.concat(F.lit("- "), F.col("topic"), F.lit(" "), F.col("link"), F.lit(": "), X.flat_line(F.col("text")))
    one = rows.select(*(by or []), F.struct("topic", link_number(F.col("link")).alias("n"), "link", line.alias("line")).alias("s"))
    all_of = one.groupBy(*(by or [])).agg(F.array_sort(F.collect_list("s")).alias("a"))
    text = F.concat(F.lit("Standing rulings:\n"), F.array_join(F.transform("a", lambda s: s.line), "\n"))
    out = all_of.select(*(by or []), text.alias("text"), F.size("a").alias("links"))
    out = out.select("*", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    over = (F.col("links") > most_links) | (F.col("bytes") > most_bytes)
    return out.withColumn("reason", F.when(over, "over-cap")).withColumn("text", F.when(~over, F.col("text")))


def capped_chain(links: DataFrame, text: Column, most_bytes: int = 2000, topic: str = "topic_path", order: str = "seq") -> DataFrame:
    """(topic, text, omitted): the newest link in full, older ones newest first while they fit, then a line that counts those left out."""
    w = Window.partitionBy(topic).orderBy(order)
    rows = links.select(topic, order, text.alias("_line"), F.row_number().over(w).alias("_k"), F.sum(F.octet_length(text).cast("long") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"))
    shown = (F.col("_k") == 1) | (F.col("_b") <= most_bytes)
    out = rows.groupBy(topic).agg(F.array_sort(F.collect_list(F.when(shown, F.struct(order, "_line")))).alias("_a"), F.count_if(~shown).alias("omitted"))
    body = F.array_join(F.transform("_a", lambda s: s["_line"]), "\n")
    mark = F.when(F.col("omitted") > 0, F.concat(F.lit("\n[... "), F.col("omitted").cast("string"), F.lit(" older link(s) omitted]"))).otherwise("")
    return out.select(topic, F.concat(body, mark).alias("text"), "omitted")


def fragment_status(fragment: Column, symbol: Column, qualified_name: Column, readable: Column) -> Column:
    """Whether a reference's fragment is declared: true, false, or null where the file could not be read for symbols."""
    return F.when(~F.coalesce(readable, F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.coalesce((fragment == symbol) | (fragment == qualified_name), F.lit(False)))


def drift(invariants: DataFrame, lines: DataFrame) -> DataFrame:
    """(invariant, state) where state is violation, hold_violation, skipped or ok.

    invariants: (inv_id, kind, pattern, scope, allowed, tier); lines: (path, line_no, text). Lines meet a pattern by a literal that
    it requires (patterns.matched()); hits outside `allowed` break no-bypass and pattern-absent, other than one site breaks
    single-definition, none under the scope breaks must-call, which is skipped without a scope.
    """
    hit = patterns.matched(lines, "text", invariants, "pattern")
    outside = ~F.exists(F.coalesce("allowed", F.array().cast("array<string>")), lambda r: matches(F.col("path"), r))
    in_scope = F.coalesce(matches(F.col("path"), F.col("scope")), F.lit(False))
    found = hit.groupBy("inv_id").agg(F.sum(outside.cast("long")).alias("outside"), F.count("*").alias("hits"), F.sum(in_scope.cast("long")).alias("scoped"))
    out = invariants.join(found, "inv_id", "left").fillna(0, ["outside", "hits", "scoped"])
    broken = (
        F.when(F.col("kind").isin("no-bypass", "pattern-absent"), F.col("outside") > 0)
        .when(F.col("kind") == "single-definition", F.col("hits") != 1)
        .when(F.col("kind") == "must-call", F.col("scoped") == 0)
    )
    state = F.when((F.col("kind") == "must-call") & (F.coalesce("scope", F.lit("")) == ""), "skipped").when(F.col("tier") == "CONTEXT", "skipped")
    state = state.when(broken & (F.col("tier") == "CONSTRAINT"), "violation").when(broken, "hold_violation").otherwise("ok")
    return out.select("inv_id", "kind", "tier", "hits", "outside", state.alias("state"))
