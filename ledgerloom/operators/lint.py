"""Record quality rules and history rules. Each gives findings (path, link, rule, severity, message); lint() is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions import text as X
from .governance import is_named, link_number, standing_eligible

FINDING = "path string, link string, rule string, severity string, message string"


def _found(rows: DataFrame, rule: str, severity: str, message: Column, link: str | None = "link") -> DataFrame:
    at = F.col(link).cast("string") if link else F.lit(None).cast("string")
    return rows.select(F.col("path").cast("string").alias("path"), at.alias("link"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def link_rules(links: DataFrame) -> DataFrame:
    """Rules on single links and on links of one topic. links: path, link, seq, status, kind, authority, ruling_text, source,
    reverses, reason_for_change, superseded_by, evidence."""
    c = F.col
    empty = lambda name: F.coalesce(F.trim(c(name)) == "", F.lit(True))
    rules = [
        (~c("status").isin(fixed.STATUSES), "status-enum", "error", F.concat(F.lit("unknown status "), c("status"))),
        (~c("kind").isin(fixed.KINDS), "kind-enum", "warning", F.concat(F.lit("unknown kind "), c("kind"))),
        (~c("authority").isin(fixed.AUTHORITIES), "authority-enum", "error", F.concat(F.lit("unknown authority "), c("authority"))),
        (c("authority").isin(fixed.OWNER_AUTHORITIES) & (empty("ruling_text") | empty("source")), "owner-ruling", "error", F.lit("an owner's ruling needs text and source")),
        ((c("status") == "superseded") & empty("superseded_by"), "superseded", "error", F.lit("superseded without superseded_by")),
        (~empty("reverses") & empty("reason_for_change"), "reason", "error", F.lit("reverses without reason_for_change")),
        ((c("authority") == "owner-verbatim") & c("status").isin("active", "provisional") & F.regexp_replace(c("ruling_text"), r"[ \t\r\n\"')\]}]+$", "").endswith("?"), "question", "warning", F.lit("a question is no ruling")),
    ]
    kinds = F.filter(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), msg.alias("message"))) for test, rule, sev, msg in rules]), lambda r: r.isNotNull())
    single = links.select(F.col("path").cast("string").alias("path"), "link", F.inline(kinds))
    known = links.select("path", F.col("link").alias("_target"), F.col("status").alias("_status")).distinct()
    out = single
    for name in ("reverses", "superseded_by"):
        pointed = links.where(~empty(name)).alias("l").join(known.alias("k"), (F.col("l.path") == F.col("k.path")) & (F.col(f"l.{name}") == F.col("_target")), "left_anti")
        out = out.unionByName(_found(pointed, f"{name}-target", "error", F.concat(F.lit("no link "), c(name))))
    open_target = links.where(c("kind") == "reversed").alias("l").join(known.alias("k"), (F.col("l.path") == F.col("k.path")) & (F.col("reverses") == F.col("_target"))).where(F.col("_status").isin("active", "provisional"))
    out = out.unionByName(_found(open_target.select("l.path", "link", "reverses"), "reversed-open", "error", F.concat(F.lit("reversed link is still open: "), c("reverses"))))
    twice = links.groupBy("path", "link").count().where("count > 1")
    return out.unionByName(_found(twice, "duplicate-link", "error", F.lit("link id used more than once")))


def topic_rules(topics: DataFrame, links: DataFrame) -> DataFrame:
    """Rules on whole topics: `current`, code references, references without a path. topics: path, area, current, code_refs."""
    newest = links.where("status = 'active'").groupBy("path").agg(F.min_by("link", "seq").alias("_now"))
    joined = topics.join(newest, "path", "left")
    wrong = joined.where(F.col("current").isNotNull() & ~F.col("current").eqNullSafe(F.col("_now")))
    out = _found(wrong, "current", "error", F.concat(F.lit("should be "), F.coalesce("_now", F.lit("none"))), None)
    bare = topics.where(F.col("area").rlike("^(processing|deletion)/") & (F.coalesce(F.size("code_refs"), F.lit(0)) <= 0))
    out = out.unionByName(_found(bare, "no-code-refs", "warning", F.lit("topic of this area has no code_refs"), None))
    unnamed = topics.select("path", F.explode("code_refs").alias("ref")).where(~is_named(F.col("ref")))
    return out.unionByName(_found(unnamed, "empty-ref", "error", F.concat(F.lit("names no path: "), F.col("ref")), None))


def rejections(links: DataFrame) -> DataFrame:
    """(path, link, num, sentence, reason, restored_num): rejected sentences, and the earliest later active link that restores theirs.

    links also: rationale_text, alternatives array<struct<option, rejected_because>>.
    """
    num = link_number(F.col("link"))
    base = links.withColumn("num", num).where("num is not null")
    own = base.where(((F.col("kind") == "declined") | (F.col("status") == "declined")) & F.col("ruling_text").isNotNull()).select("path", "link", "num", F.col("ruling_text").alias("sentence"), F.coalesce("rationale_text", F.lit("")).alias("reason"))
    alts = base.select("path", "link", "num", F.inline("alternatives")).where("option is not null").select("path", "link", "num", F.col("option").alias("sentence"), F.coalesce("rejected_because", F.lit("")).alias("reason"))
    back = base.where("status = 'active' and reverses is not null").select(F.col("path").alias("_p"), F.col("reverses").alias("_r"), F.col("num").alias("_n"))
    rows = own.unionByName(alts)
    joined = rows.join(back, (F.col("path") == F.col("_p")) & (F.col("link") == F.col("_r")) & (F.col("_n") > F.col("num")), "left")
    return joined.groupBy(*rows.columns).agg(F.min("_n").alias("restored_num"))


def readoptions(links: DataFrame, across_topics: bool = False) -> DataFrame:
    """Adopted links whose text is a rejected sentence, white space aside: of their own topic at a lower number, or of any other.

    Across topics, an adopted link meets one row for each sentence and name of a rejecting link, whatever number of topics rejects it: of these the
    smallest and the largest path say whether one is another than its own. So what is made and found grows with the links, not with their pairs.
    """
    rejected = rejections(links).withColumn("_want", X.squeezed(F.col("sentence"))).select(F.col("path").alias("_path"), F.col("link").alias("rejected_link"), F.col("num").alias("_num"), "_want", "restored_num")
    adopted = links.where(F.col("reverses").isNull() & F.col("kind").isin("adopted", "restored") & F.col("status").isin("active", "provisional") & (F.coalesce("ruling_text", F.lit("")) != ""))
    adopted = adopted.withColumn("_num_own", link_number(F.col("link"))).withColumn("_text", X.squeezed(F.col("ruling_text")))
    if across_topics:
        rejected = rejected.where("restored_num is null").groupBy("_want", "rejected_link").agg(F.min("_path").alias("_first"), F.max("_path").alias("_last"))
        both = adopted.join(rejected, (F.col("_text") == F.col("_want")) & ((F.col("path") != F.col("_first")) | (F.col("path") != F.col("_last"))))
    else:
        both = adopted.join(rejected, (F.col("_text") == F.col("_want")) & (F.col("path") == F.col("_path")))
        both = both.where((F.col("_num") < F.col("_num_own")) & (F.col("restored_num").isNull() | (F.col("restored_num") > F.col("_num_own"))))
    return _found(both, "readoption", "warning", F.concat(F.lit("re-adopts what "), F.col("rejected_link"), F.lit(" rejects")))


def duplicates(rows: DataFrame, key: str, rule: str = "duplicate-id") -> DataFrame:
    """Keys that more than one path claims."""
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n")).where("n > 1")
    return _found(many.withColumn("path", F.array_join("paths", ", ")), rule, "error", F.concat(F.lit("claimed more than once: "), F.col(key)), None)


def concept_rules(concepts: DataFrame, topic_ids: DataFrame, files: DataFrame) -> DataFrame:
    """Concept rules. concepts: path, id, implemented_by, tested_by, governed_by, body; topic_ids: id; files: file, lines."""
    gov = concepts.select("path", F.explode("governed_by").alias("id")).join(topic_ids, "id", "left_anti")
    out = _found(gov, "governed-by", "error", F.concat(F.lit("no topic "), F.col("id")), None)
    claims = concepts.select("path", F.explode("implemented_by").alias("ref"))
    out = out.unionByName(duplicates(claims, "ref", "duplicate-claim"))
    where = F.substring_index(F.col("ref"), "#", 1)
    out = out.unionByName(_found(claims.where(where.startswith("/")), "absolute-ref", "error", F.col("ref"), None))
    out = out.unionByName(_found(claims.where(where.rlike(r"(^|/)\.\.(/|$)")), "escaping-ref", "error", F.col("ref"), None))
    met = claims.withColumn("_f", where).join(files, F.col("_f") == F.col("file"), "left")
    out = out.unionByName(_found(met.where(F.col("file").isNull() & ~where.startswith("/")), "missing-ref", "error", F.col("ref"), None))
    out = out.unionByName(_found(met.where((F.col("lines") > 400) & ~F.contains("ref", F.lit("#"))), "large-file", "error", F.concat(F.lit("name a symbol: "), F.col("ref")), None))
    out = out.unionByName(_found(concepts.where(F.coalesce(F.size("tested_by"), F.lit(0)) <= 0), "untested", "warning", F.lit("no tested_by"), None))
    return out.unionByName(_found(concepts.where(~F.coalesce(F.col("body").rlike("(?i)not this concept"), F.lit(False))), "no-boundary", "warning", F.lit("says not what it is not"), None))


def standing_rules(pointers: DataFrame, links: DataFrame) -> DataFrame:
    """Standing pointers (path, link) must name an eligible link, once."""
    twice = pointers.groupBy("path", "link").count().where("count > 1")
    out = _found(twice, "standing-twice", "error", F.lit("pointer given more than once"))
    met = pointers.distinct().join(links.select("path", "link", "status", "authority", "ruling_text"), ["path", "link"], "left")
    out = out.unionByName(_found(met.where(F.col("status").isNull()), "standing-missing", "error", F.lit("no such link")))
    bad = met.where(F.col("status").isNotNull() & ~standing_eligible(F.col("status"), F.col("authority"), F.col("ruling_text")))
    return out.unionByName(_found(bad, "standing-ineligible", "error", F.lit("not an active, single-line owner ruling")))


def marker_rules(markers: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """Code marks (path, topic, link) and rulings must name each other. refs: (topic, link, ref)."""
    lost = markers.join(links.select(F.col("topic"), "link"), ["topic", "link"], "left_anti")
    out = _found(lost, "marker-unknown", "error", F.concat(F.lit("no ruling "), F.col("topic"), F.lit(" "), F.col("link")))
    where = F.substring_index(F.col("ref"), "#", 1)
    silent = refs.withColumn("path", where).join(markers.select("path", "topic", "link"), ["path", "topic", "link"], "left_anti")
    return out.unionByName(_found(silent, "marker-missing", "warning", F.concat(F.lit("no mark for "), F.col("topic"), F.lit(" "), F.col("link"))))


def citation_rules(citations: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """path:line citations (path, link, cited, line) must exist. files: file, lines."""
    met = citations.join(files, F.col("cited") == F.col("file"), "left")
    level = "error" if strict else "warning"
    out = _found(met.where(F.col("file").isNull()), "citation-file", level, F.concat(F.lit("no file "), F.col("cited")))
    return out.unionByName(_found(met.where(F.col("line") > F.col("lines")), "citation-line", level, F.concat(F.lit("past the end of "), F.col("cited"))))


BODY_FIELDS = ["date", "kind", "reverses", "reason_for_change", "ruling", "rationale", "alternatives", "evidence", "revisit_if", "edges", "assumptions", "invariant", "recorded_by", "recorded_at"]
_OPEN, _CLOSED = ["active", "provisional"], ["superseded", "historical", "declined"]


def _moves(f: str, alone: Column) -> list[tuple[Column, str, Column]]:
    """What a pointer that is set once may not do."""
    other, had = ~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.col(f"o_{f}").isNotNull()
    out = [(other & had, f"{f}-frozen", F.lit("fixed once set")), (other & ~had & ~alone, f"{f}-not-alone", F.lit("a move must be the only change"))]
    if f == "superseded_by":
        out.append((other & ~had & ~F.col("n_status").eqNullSafe(F.lit("superseded")), f"{f}-status", F.lit("status is not superseded")))
    return out


def history(old: DataFrame, new: DataFrame, body: list[str] = BODY_FIELDS) -> DataFrame:
    """Append-only rules between two sides of (path, link, seq, status, superseded_by, promoted_by, body fields).

    One full outer join by (path, link): removed links, changed body fields, lifecycle moves that go back or are not alone. Order
    rules, by windows over the joined rows: new links stand above old ones (seq is smaller), old ones keep their order.
    All rules of a row are one array, so the join is planned and run once.
    """
    fields = ["seq", "status", "superseded_by", "promoted_by", *body]
    o = old.select("path", "link", *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("o_"))
    n = new.select("path", "link", *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("n_"))
    both = o.join(n, ["path", "link"], "full_outer")
    kept = F.col("o_").isNotNull() & F.col("n_").isNotNull()
    topic = Window.partitionBy("path")
    above = topic.orderBy("n_seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_before": F.last(F.when(kept, F.col("o_seq")), ignorenulls=True).over(above), "_top": F.min(F.when(kept, F.col("n_seq"))).over(topic)})
    changed = F.filter(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in body]), lambda x: x.isNotNull())
    moved = ~F.col("o_status").eqNullSafe(F.col("n_status"))
    forward = F.coalesce(F.col("o_status").isin(_OPEN) & F.col("n_status").isin(_CLOSED), F.lit(False))
    alone = F.size(changed) == 0
    rules = [
        (F.col("n_").isNull(), "removed", F.lit("a recorded link is gone")),
        (kept & moved & ~forward, "status-move", F.concat_ws(" to ", "o_status", "n_status")),
        (kept & moved & forward & ~alone, "status-not-alone", F.lit("a move must be the only change")),
        *[(kept & test, rule, message) for f in ("superseded_by", "promoted_by") for test, rule, message in _moves(f, alone)],
        (kept & (F.col("_before") > F.col("o_seq")), "order", F.lit("recorded links changed their order")),
        (F.col("o_").isNull() & (F.col("n_seq") > F.col("_top")), "insert", F.lit("a new link stands below recorded ones")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), message.cast("string").alias("message"))) for test, rule, message in rules]), lambda r: r.isNotNull())
    frozen = F.when(kept, F.transform(changed, lambda f: F.struct(F.lit("body-frozen").alias("rule"), F.concat(f, F.lit(" changed")).alias("message"))))
    each = both.select(F.col("path").cast("string").alias("path"), F.col("link").cast("string").alias("link"), F.inline(F.concat(found, F.coalesce(frozen, F.slice(found, 1, 0)))))
    return each.select("path", "link", "rule", F.lit("error").alias("severity"), "message")


def recovered(links: DataFrame) -> DataFrame:
    """Of links (path, link, seq, …) of records that failed validation, those that stand as recorded history: of rows of one id the first by seq (ties by the
    other fields), rows without an id none."""
    named = links.where("link is not null and link <> ''")
    rest = ["seq", *[c for c in links.columns if c not in ("path", "link", "seq")]]
    return named.groupBy("path", "link").agg(F.min(F.struct(*rest)).alias("_r")).select("path", "link", "_r.*")


def repairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """What is said of records whose recorded side (path, type, valid, parsed, n_links, diagnostics) failed validation, against the new side; one row a path.

    parsed: the front matter was read as a mapping. A new side that fails is refused (`unreadable`), whatever the old one was. A
    valid new side is a note: `repaired` where the old one could not be parsed, so that nothing was recorded that could be frozen, and
    membership cannot be told; `recovered` where links were left to compare with; `no-history` where there were none, so that all links
    are new. Records that are not of links on either side are passed over.
    """
    of = lambda df, n: df.select("path", *[F.col(c).alias(f"{n}_{c}") for c in ("type", "valid", "parsed", "n_links", "diagnostics")], F.lit(True).alias(f"{n}_"))
    both = of(old, "o").join(of(new, "n"), "path", "right")
    said = lambda n: F.array_join(F.coalesce(f"{n}_diagnostics", F.array().cast("array<string>")), "; ")
    bare = F.col("n_type").isin("incident", "investigation", "concept") & (F.col("n_n_links") == 0) & (F.coalesce("o_n_links", F.lit(0)) == 0)
    failed = F.col("o_").isNotNull() & ~F.col("o_valid")
    rule = F.when(~F.col("n_valid"), "unreadable").when(failed & ~F.coalesce(bare, F.lit(False)), F.when(~F.col("o_parsed"), "repaired").when(F.col("o_n_links") > 0, "recovered").otherwise("no-history"))
    message = F.when(~F.col("n_valid"), said("n")).when(~F.col("o_parsed"), F.lit("could not be parsed before; membership not checked")).otherwise(said("o"))
    found = both.withColumn("rule", rule).where("rule is not null")
    return found.select("path", F.lit(None).cast("string").alias("link"), "rule", F.when(F.col("rule") == "unreadable", "error").otherwise("note").alias("severity"), message.alias("message"))


def pairing(old: DataFrame, new: DataFrame, marks: DataFrame) -> DataFrame:
    """Each member added or removed between two sides (path, id) needs exactly one new mark row (path, id, action)."""
    added = new.exceptAll(old).distinct().withColumn("action", F.lit("add"))
    gone = old.exceptAll(new).distinct().withColumn("action", F.lit("remove"))
    n = marks.groupBy("path", "id", "action").agg(F.count("*").alias("n"))
    both = added.unionByName(gone).withColumn("_due", F.lit(True)).join(n, ["path", "id", "action"], "full_outer")
    wrong = both.where(F.coalesce("n", F.lit(0)) != F.when(F.col("_due"), 1).otherwise(0))
    return _found(wrong, "pairing", "error", F.concat(F.lit("mark rows: "), F.coalesce(F.col("n"), F.lit(0)).cast("string")), "id")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, state): added, changed, removed or same between a stored and a walked side."""
    o = old.select(key, F.col(sha).alias("_o"), F.lit(True).alias("_in_o"))
    n = new.select(key, F.col(sha).alias("_n"), F.lit(True).alias("_in_n"))
    state = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def anchor_verdict(exists: Column, digest_then: Column, digest_now: Column, checked: Column) -> Column:
    """changed, missing, never (anchored), unchecked or silent, the first that applies."""
    return F.when(~checked, "unchecked").when(digest_then.isNull(), "never").when(~exists, "missing").when(~digest_then.eqNullSafe(digest_now), "changed").otherwise("silent")


def anchor_rules(anchors: DataFrame) -> DataFrame:
    """Anchor rows (path, ref, link, algo, digest, captured, captured_at) must be whole."""
    bad = anchors.where(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)) | (F.col("algo") != "sha256") | values.recorded_at_problem(F.col("captured"), F.col("captured_at")).isNotNull() | ~is_named(F.col("ref")))
    return _found(bad, "anchor", "error", F.concat(F.lit("incomplete anchor of "), F.col("ref")))


def enum_rules(links: DataFrame) -> DataFrame:
    """Enumerations beyond a link's own: rationale and alternative authorities, edge relations, invariant kinds. links also:
    rationale_authority, alternative_authorities and edge_rels (arrays), invariant_kind."""
    def odd(values_of: Column, known: list[str], rule: str) -> Column:
        bad = F.filter(F.coalesce(values_of, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin(known))
        return F.transform(bad, lambda x: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit("unknown value "), x).alias("message")))

    found = F.concat(
        odd(F.array("rationale_authority"), fixed.AUTHORITIES, "rationale-authority"), odd(F.col("alternative_authorities"), fixed.AUTHORITIES, "alternative-authority"),
        odd(F.col("edge_rels"), fixed.EDGE_RELS, "edge-rel"), odd(F.array("invariant_kind"), fixed.INVARIANT_KINDS, "invariant-kind"),
    )
    each = links.select(F.col("path").cast("string").alias("path"), "link", F.inline(found))
    return each.select("path", "link", "rule", F.lit("error").alias("severity"), "message")


def invariant_rules(links: DataFrame) -> DataFrame:
    """Invariants must compile, and below an owner's authority need evidence. links: path, link, authority, evidence,
    invariant_kind, invariant_pattern. A pattern is tried once by distinct text, in a task."""
    own = links.where("invariant_kind is not null or invariant_pattern is not null")
    weak = own.where(~F.coalesce(F.col("authority").isin(fixed.OWNER_AUTHORITIES), F.lit(False)) & ~values.validated_evidence(F.col("evidence")))
    out = _found(weak, "invariant-evidence", "error", F.lit("an invariant below an owner's authority needs evidence"))
    tried = own.select("invariant_pattern").where("invariant_pattern <> ''").distinct().withColumn("_bad", X.pattern_problem(F.col("invariant_pattern")))
    broken = own.join(tried.where("_bad is not null"), "invariant_pattern")
    return out.unionByName(_found(broken, "invariant-pattern", "error", F.concat(F.lit("does not compile: "), F.col("_bad"))))


def record_rules(records: DataFrame) -> DataFrame:
    """Status and authority of records that are no topics. records: path, status, authority."""
    out = None
    for field, known in (("status", fixed.STATUSES), ("authority", fixed.AUTHORITIES)):
        bad = _found(records.where(~F.col(field).isin(known)), f"record-{field}", "error", F.concat(F.lit(f"unknown {field} "), F.col(field)), None)
        out = bad if out is None else out.unionByName(bad)
    return out


def fence_rules(texts: DataFrame) -> DataFrame:
    """Canonical records (path, text) must open with a fence line and have a line that closes it."""
    canonical = texts.where(F.col("path").rlike("(^|/)(topics|incidents|investigations)/"))
    opened = F.col("text").rlike(r"^\x{FEFF}?---[ \t]*\r?(\n|$)")
    closed = F.col("text").rlike(r"^\x{FEFF}?---[ \t]*\r?\n(?s:.*?\n)?---[ \t]*\r?(\n|$)")
    out = _found(canonical.where(~F.coalesce(opened, F.lit(False))), "opening-fence", "error", F.lit("does not begin with a fence"), None)
    return out.unionByName(_found(canonical.where(opened & ~closed), "closing-fence", "error", F.lit("the fence is not closed"), None))


def stem_rules(records: DataFrame) -> DataFrame:
    """Records (path, id) without an id that share the stem of their file with another record."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    shared = records.where("id is null").withColumn("stem", stem).groupBy("stem").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)
    return _found(shared.withColumn("path", F.array_join("paths", ", ")), "shared-stem", "warning", F.concat(F.lit("no id, and the stem "), F.col("stem")), None)


def standing_cap_rule(digest: DataFrame) -> DataFrame:
    """The refusal of governance.standing_digest() as a finding of the store."""
    return _found(digest.where("reason = 'over-cap'").withColumn("path", F.lit("")), "standing-cap", "error", F.concat(F.lit("standing rulings over the cap: "), F.col("links").cast("string"), F.lit(" links, "), F.col("bytes").cast("string"), F.lit(" bytes")), None)


def summary(findings: DataFrame, changed: int | None = None) -> DataFrame:
    """One row: errors and other notes among findings, and the line that says so."""
    out = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("notes"))
    return out.withColumn("line", F.concat(F.lit(f"changed={changed} " if changed is not None else ""), F.lit("errors="), F.col("errors"), F.lit(" notes="), F.col("notes")))


def frozen_rows(old: DataFrame, new: DataFrame, keys: list[str], rule: str, prepended: bool = True) -> DataFrame:
    """Rows of an audit block (path, seq, raw, keys) that were recorded stay as they are, in their order; with `prepended`, new
    ones stand above them. A key may occur once on the new side."""
    o = old.select("path", *keys, F.col("seq").alias("o_seq"), F.col("raw").alias("o_raw"), F.lit(True).alias("o_"))
    n = new.select("path", *keys, F.col("seq").alias("n_seq"), F.col("raw").alias("n_raw"), F.lit(True).alias("n_"))
    both = o.join(n, ["path", *keys], "full_outer")
    kept = F.col("o_").isNotNull() & F.col("n_").isNotNull()
    topic = Window.partitionBy("path")
    above = topic.orderBy("n_seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({
        "_before": F.last(F.when(kept, F.col("o_seq")), ignorenulls=True).over(above), "_top": F.min(F.when(kept, F.col("n_seq"))).over(topic),
        "_twice": F.count("n_").over(Window.partitionBy("path", *keys)),
    })
    rules = [
        (F.col("n_").isNull(), "removed"), (kept & ~F.col("o_raw").eqNullSafe(F.col("n_raw")), "changed"), (F.col("n_").isNotNull() & (F.col("_twice") > 1), "twice"),
        *([(kept & (F.col("_before") > F.col("o_seq")), "order"), (F.col("o_").isNull() & (F.col("n_seq") > F.col("_top")), "not-prepended")] if prepended else []),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(f"{rule}-{name}")) for test, name in rules]), lambda r: r.isNotNull())
    each = both.select(F.col("path").cast("string").alias("path"), F.concat_ws("/", *keys).alias("link"), F.explode(found).alias("rule")).distinct()
    return each.select("path", "link", "rule", F.lit("error").alias("severity"), F.lit("recorded rows are append-only").alias("message"))


def type_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records (path, type, quarantined) delivered under a canonical type keep it; those that were quarantined or of another type may change."""
    was = old.where(F.col("type").isin(fixed.RECORD_TYPES) & ~F.col("quarantined")).select("path", F.col("type").alias("_was"))
    moved = was.join(new.select("path", F.col("type").alias("_is")), "path").where(~F.col("_was").eqNullSafe(F.col("_is")))
    return _found(moved, "type-change", "error", F.concat_ws(" to ", "_was", "_is"), None)


def current_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """`current` of topics (path, current, head: the newest active link) moves only with the head, or to repair an older disagreement; written, it names the head."""
    both = new.select("path", F.col("current").alias("_c"), F.col("head").alias("_h")).join(old.select("path", F.col("current").alias("_co"), F.col("head").alias("_ho"), F.lit(True).alias("_old")), "path", "left")
    wrong = F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("_h"))
    still = F.col("_h").eqNullSafe(F.col("_ho"))
    repair = ~F.col("_co").eqNullSafe(F.col("_ho")) & F.col("_c").eqNullSafe(F.col("_h"))
    moved = F.col("_old").isNotNull() & ~F.col("_c").eqNullSafe(F.col("_co")) & still & ~repair
    out = _found(both.where(wrong), "current-head", "error", F.concat(F.lit("should be "), F.coalesce("_h", F.lit("none"))), None)
    return out.unionByName(_found(both.where(moved), "current-moved", "error", F.lit("moved without a change of the newest active link"), None))


def deleted_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Canonical records (path, type) that are gone, renamed ones too."""
    gone = old.where(F.col("type").isin(fixed.RECORD_TYPES)).join(new.select("path"), "path", "left_anti")
    return _found(gone, "record-deleted", "error", F.lit("a recorded file is gone"), None)


def raw_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links (path, link, raw, status…) whose fields are all the same keep their raw text too. raw: null where it could not be told; such pairs are passed over."""
    fields = [c for c in old.columns if c not in ("path", "link", "raw", "seq")]
    o = old.select("path", "link", F.col("raw").alias("_o"), F.hash(*fields).alias("_fo"), F.to_json(F.struct(*fields)).alias("_jo"))
    n = new.select("path", "link", F.col("raw").alias("_n"), F.hash(*fields).alias("_fn"), F.to_json(F.struct(*fields)).alias("_jn"))
    bad = o.join(n, ["path", "link"]).where((F.col("_fo") == F.col("_fn")) & (F.col("_jo") == F.col("_jn")) & (F.col("_o") != F.col("_n")))
    return _found(bad, "raw-changed", "error", F.lit("the text of an unchanged link changed"))


def anchor_summary(anchors: DataFrame) -> DataFrame:
    """One row of counts over verdicts, and the one line that is shown: changed before missing before never captured."""
    n = {"changed": "changed", "missing": "missing", "never": "never", "not_checked": "unchecked"}
    out = anchors.agg(*[F.count_if(F.col("verdict") == v).alias(k) for k, v in n.items()])
    shown = [("changed", "Anchor changed since capture: "), ("missing", "Anchor missing: "), ("never", "Anchor never captured: ")]
    return out.withColumn("line", F.coalesce(*[F.when(F.col(k) > 0, F.concat(F.lit(t), F.col(k).cast("string"), F.lit("."))) for k, t in shown]))
