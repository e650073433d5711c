"""The questions that users put to a store, each composed of the operators; a store is a DataFrame of parsed records.

    store = Store(records.read_store(spark, root))
    store.search("why is the cache bounded", limit=5).show()
    store.for_path(["src/cache.py"]).show()
"""

from __future__ import annotations

import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import code_links, freshness, governance, lint, logs, rank
from .session import written
from .sources import records as R

DECISIONS = ["topic", "link", "incident", "investigation"]
EMPTY_STORE = "empty"


class Store:
    def __init__(self, records: DataFrame, vectors: DataFrame | None = None, fingerprint: str | None = None, dim: int | None = None):
        """vectors: (path, vector), by the path of a record or the key of a link row; made outside. With the columns embed_sha and
        embed_fp too, only those count that the model of this fingerprint made of a row's present content (its sha256), of `dim` components."""
        self.parsed, self.vectors, self.fingerprint, self.dim = records, vectors, fingerprint, dim
        if vectors is not None and "embed_sha" in vectors.columns and fingerprint is None:
            raise ValueError("vectors with embed_sha need the fingerprint of the present model")

    @property
    def spark(self) -> SparkSession:
        return self.parsed.sparkSession

    @cached_property
    def records(self) -> DataFrame:
        """The records as a table: they are parsed once, however many questions are asked."""
        return written(self.parsed, "records")

    @cached_property
    def good(self) -> DataFrame:
        return R.quarantine(self.records)[0]

    @cached_property
    def quarantined(self) -> DataFrame:
        return R.quarantine(self.records)[1]

    @cached_property
    def fresh(self) -> DataFrame:
        """(path, vector) of the searchable rows whose vector is of their present content."""
        if "embed_sha" not in self.vectors.columns:
            return self.vectors.select("path", "vector")
        return freshness.fresh_vectors(self.rows.select("path", "sha256"), self.vectors, self.fingerprint, self.dim).select("path", "vector")

    @cached_property
    def links(self) -> DataFrame:
        return R.links(self.records)

    @cached_property
    def rows(self) -> DataFrame:
        """Searchable rows: each record, and each link with a ruling or a reason, of its topic's family."""
        own = self.good.select("path", "type", "title", "body", "status", "authority", F.col("path").alias("family"), F.lit(None).cast("string").alias("link_id"))
        of = self.good.select(F.col("path").alias("family"), F.col("area"), F.col("id").alias("topic"), (F.col("type") == "inbox").alias("inbox"))
        content = F.sha2(F.concat_ws("\n", "title", "body"), 256)
        return own.unionByName(R.link_records(self.records)).withColumn("sha256", content).join(of, "family")

    @cached_property
    def topic_refs(self) -> DataFrame:
        return self.good.where("type = 'topic'").select(F.col("path").alias("topic_path"), F.col("id").alias("topic_id"), F.explode("code_refs").alias("ref"))

    @cached_property
    def concept_refs(self) -> DataFrame:
        return R.concept_paths(self.good).where("kind <> 'governed_by'").select("concept_id", "ref").distinct()

    @cached_property
    def governed(self) -> DataFrame:
        """(concept_id, topic_path, topic_id): the topics that concepts name."""
        named = R.concept_paths(self.good).where("kind = 'governed_by'").select("concept_id", F.substring_index("ref", "#", 1).alias("topic_id")).distinct()
        return named.join(self.good.where("type = 'topic'").select(F.col("path").alias("topic_path"), F.col("id").alias("topic_id")), "topic_id")

    @staticmethod
    def kept(status: list[str] | None, types: list[str] | None, area: list[str] | None, topic: list[str] | None, authority: list[str] | None, decisions_only: bool, include_inbox: bool) -> Column:
        """Values of one field are alternatives, fields all hold. Without a status: active or none; `any` takes all."""
        c = F.lit(True)
        if not status:
            c = F.col("status").isNull() | (F.col("status") == "active")
        elif "any" not in status:
            c = F.col("status").isin(status)
        if decisions_only:  # a type that is asked for narrows the decision types and never widens them
            types = [x for x in types if x in DECISIONS] if types else DECISIONS
            if not types:
                return F.lit(False)
        for name, values in (("type", types), ("area", area), ("topic", topic), ("authority", authority)):
            if values:
                c = c & F.col(name).isin(values)
        if not include_inbox and "inbox" not in (types or []):
            c = c & ~F.coalesce("inbox", F.lit(False))
        return F.coalesce(c, F.lit(False))

    def search(self, question: str, *, mode: str = "hybrid", query_vector: list[float] | None = None, status=None, types=None, area=None, topic=None, authority=None, decisions_only: bool = False, include_inbox: bool = False, limit: int = 10) -> DataFrame:
        """rank, family, score, fusion and the best row of each hit. mode: fts, vector or hybrid; without vectors, fts. contributing has, by
        channel, the rank and the link (null for the record itself) that the hit owes it.

        Filters hold within each channel, before caps and fusion. The vector channel counts in full: ranks of full-text hits in
        it are counted, not cut off.
        """
        keep = self.kept(status, types, area, topic, authority, decisions_only, include_inbox)
        with_vectors = self.vectors is not None and query_vector is not None
        mode = mode if with_vectors else "fts"
        order = [F.desc("score"), F.asc("path")]
        channels: list[DataFrame] = []
        hits = fts = None
        if mode != "vector":
            terms = [r["t"] for r in self.spark.range(1).select(F.explode(X.record_tokens(F.lit(question))).alias("t")).collect()]  # one question's terms
            scored = rank.bm25(self.rows, "path", F.concat_ws(" ", "title", "body"), terms, keep, X.record_tokens) if terms else self.rows.select("path", F.lit(0.0).alias("score")).where("false")
            fts = rank.collapse(scored.join(self.rows.select("path", "family"), "path"), "family", order)
            fts = rank.ranked(rank.top_k(fts, order, rank.FTS_CAP), order)
            channels.append(fts)
        if mode != "fts":
            met = rank.nearest(self.fresh, "path", "vector", query_vector).join(self.rows.where(keep).select("path", "family"), "path")
            met = rank.collapse(met, "family", order)
            top = rank.ranked(rank.top_k(met, order, rank.FTS_CAP + limit), order)
            if fts is not None:
                # Full-text hits further down: one more than the rows before each; the side broadcast is of FTS_CAP rows at most.
                far = met.join(F.broadcast(fts.select("family")), "family").join(top.select("family"), "family", "left_anti").select("family", F.col("score").alias("_s"), F.col("path").alias("_p"))
                before = met.join(F.broadcast(far.limit(rank.FTS_CAP)).withColumnRenamed("family", "_f"), (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("path") < F.col("_p"))))
                low = before.groupBy(F.col("_f").alias("family"), F.col("_p").alias("path"), F.col("_s").alias("score")).agg((F.count("*") + 1).cast("int").alias("rank"))
                top = top.select("family", "path", "score", "rank").unionByName(low)
            channels.append(top)
        fusion = mode
        if mode == "hybrid":
            first = fts.where("rank = 1").join(self.rows.select("path", F.concat_ws(" ", "title", "body").alias("_d")), "path").select(rank.confident(F.lit(question), F.col("_d")).alias("ok")).first()
            sure = bool(first and first["ok"])
            hits, fusion = rank.hybrid(fts, channels[1], "family", sure), "rrf" if sure else "vector"
        else:
            hits = channels[0].select("family", "score")
        best = None
        for n, ch in enumerate(channels):
            part = ch.select("family", "path", F.col("rank").alias("_r"), F.lit(n).alias("_c"))
            best = part if best is None else best.unionByName(part)
        of = self.rows.select("path", "link_id")
        names = {"fts": ["fts"], "vector": ["vector"], "hybrid": ["fts", "vector"]}[mode]
        owed = rank.contributors({n: c.join(of, "path") for n, c in zip(names, channels, strict=True) if mode != "hybrid" or fusion == "rrf" or n == "vector"}, "family", "link_id")
        best = best.groupBy("family").agg(F.min_by("path", F.struct("_r", "_c")).alias("path"), F.min("_r").alias("_r"))
        final = [F.desc("score"), F.asc("_r"), F.asc("family")]
        hits = rank.ranked(rank.top_k(hits.join(best, "family"), final, limit), final).drop("_r").join(owed.withColumnRenamed("contributors", "contributing"), "family", "left")
        shown = self.rows.select("path", "title", X.snippet(F.col("body"), F.lit(None).cast("string")).alias("snippet"), F.col("link_id").alias("matched_link_id"), F.when(F.col("link_id").isNotNull(), F.col("status")).alias("link_status"), F.when(F.col("link_id").isNotNull(), F.col("authority")).alias("link_authority"))
        return hits.join(shown, "path").select("rank", F.col("family").alias("path"), "score", F.lit(fusion).alias("fusion"), "title", "snippet", "matched_link_id", "link_status", "link_authority", "contributing").orderBy("rank")

    def paths(self, paths: list[str] | DataFrame) -> DataFrame:
        return paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")

    def for_path(self, paths: list[str] | DataFrame) -> DataFrame:
        """path, topic_path, topic_id, via, current and its ruling: topics that name a path, then those of its concepts; each once."""
        asked = self.paths(paths).select("path").distinct()
        direct = governance.govern(asked, self.topic_refs).select("path", "topic_path", "topic_id", F.lit("direct").alias("via"))
        by = governance.govern(asked, self.concept_refs).join(self.governed, "concept_id").select("path", "topic_path", "topic_id", F.lit("concept").alias("via"))
        both = direct.unionByName(by).groupBy("path", "topic_path", "topic_id").agg(F.max("via").alias("via"))
        now = governance.current_links(self.links).withColumnRenamed("current", "link")
        ruling = now.join(self.links.select("topic_path", "link", "ruling_text", "authority"), ["topic_path", "link"]).dropDuplicates(["topic_path", "link"]).withColumnRenamed("link", "current")
        return both.join(ruling, "topic_path", "left").select("path", "topic_path", "topic_id", "via", "current", "authority", "ruling_text")

    def chain(self, topic: str | None = None) -> DataFrame:
        """Links newest first, with their edges and broken assumptions; of one topic (id or path), or of all."""
        out = governance.chain(self.links, R.edges(self.records), R.assumptions(self.records))
        return out if topic is None else out.where((F.col("topic_id") == topic) | (F.col("topic_path") == topic))

    def why(self, name: str) -> DataFrame:
        """Chains, declined links included, behind a path or a symbol (topics and concepts that name it)."""
        found = self.for_path([name]).select("topic_path")
        fragment = F.regexp_extract("ref", "#(.*)$", 1)
        named = (fragment != "") & ((fragment == name) | F.endswith(fragment, F.lit(f".{name}")))
        found = found.unionByName(self.topic_refs.where(named).select("topic_path")).unionByName(self.concept_refs.where(named).join(self.governed, "concept_id").select("topic_path"))
        return self.chain().join(found.distinct(), "topic_path", "left_semi").orderBy("topic_path", "seq")

    def unmapped(self, paths: list[str] | DataFrame, ignored: Column | None = None) -> DataFrame:
        return governance.unmapped(self.paths(paths), self.topic_refs, self.concept_refs, ignored)

    def declined(self, topics: list[str], restored: bool = False, most_topics: int = 3, most_rows: int = 10) -> DataFrame:
        """Rejected sentences of the first few topics (paths) given, oldest first; those that a later link restored only if asked for."""
        rows = lint.rejections(self.links).where(F.col("path").isin(topics[:most_topics]))
        return (rows if restored else rows.where("restored_num is null")).orderBy("path", "num", "sentence").limit(most_rows)

    def propose_bindings(self, fallbacks: DataFrame, ledger: DataFrame, session: str, last: int = 20) -> tuple[DataFrame, DataFrame]:
        """Topics that a session's searches brought up for paths it edited and that do not govern them yet; and edited paths that
        nothing governs and no proposal names. fallbacks (session, seq, file, topic_id, hook), ledger (session, path, worktree_path,
        root, content_sha256, seen_at); both absolute paths."""
        own = fallbacks.where(F.col("session") == session)
        recent = own.orderBy(F.desc("seq")).limit(last)
        top = F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))
        real = F.coalesce("worktree_path", "path")
        rows = ledger.where((F.col("session") == session) & F.col("root").isNotNull()).withColumn("_file", real)
        rows = rows.withColumn("under", F.when(F.startswith(F.col("path"), top), F.substring(F.col("path"), F.length(top) + 1, F.length("path"))).otherwise(F.col("path")))
        met = recent.join(rows.drop("session"), F.col("file") == F.col("_file"))
        bound = governance.govern(rows.select(F.col("under").alias("path")).distinct(), self.topic_refs).select(F.col("path").alias("under"), "topic_id").distinct()
        proposals = met.join(bound, ["under", "topic_id"], "left_anti").select("topic_id", F.col("under").alias("path"), F.substring("content_sha256", 1, 12).alias("sha"), "seen_at", "hook").distinct()
        free = self.unmapped(rows.select(F.col("under").alias("path")).distinct()).where("class = 'unmapped'")
        return proposals, free.join(proposals.select("path"), "path", "left_anti").select("path")

    def check(self, walked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """State of each path against records walked now; and one row of counters."""
        drifted = lint.snapshot_diff(self.records, walked, "path", "sha256").where("state <> 'same'")
        searchable = self.rows.select("path")
        fresh = searchable.join(self.fresh.select("path").distinct(), "path", "left_semi") if self.vectors is not None else searchable.where("false")
        n = lambda df, name: df.agg(F.count("*").alias(name))
        parts = [n(self.good.where("type = 'topic'"), "source_topic_count"), n(searchable, "searchable_row_count"), n(fresh, "searchable_vector_count"), n(self.quarantined, "quarantined")]
        one = parts[0]
        for p in parts[1:]:
            one = one.crossJoin(p)  # one row each
        rows, vectors = F.col("searchable_row_count"), F.col("searchable_vector_count")
        return drifted, one.withColumn("vector_index_state", F.when(rows == 0, EMPTY_STORE).when(vectors == 0, "none").when(vectors < rows, "partial").otherwise("full"))

    def drift(self, lines: DataFrame) -> DataFrame:
        """State of each invariant of active links against lines (path, line_no, text) of code."""
        l = self.links.where("status = 'active' and invariant_kind is not null and invariant_pattern is not null")
        inv = l.select(F.concat_ws("/", "topic_id", "link").alias("inv_id"), F.col("invariant_kind").alias("kind"), F.col("invariant_pattern").alias("pattern"), F.col("invariant_scope").alias("scope"), F.col("invariant_allowed").alias("allowed"), governance.tier(F.col("status"), F.col("authority"), F.col("evidence")).alias("tier"))
        return governance.drift(inv, lines)

    @cached_property
    def pointers(self) -> DataFrame:
        return self.good.select("path", F.explode("standing").alias("link"))

    def standing(self) -> DataFrame:
        """The digest of standing rulings, or why there is none: over-cap, or pointers that name no eligible link."""
        met = self.pointers.distinct().join(self.links.select("path", "topic_id", "link", "status", "authority", "ruling_text"), ["path", "link"], "left")
        bad = met.agg(F.count_if(~governance.standing_eligible(F.col("status"), F.col("authority"), F.col("ruling_text"))).alias("_bad"))
        out = governance.standing_digest(met.select(F.col("topic_id").alias("topic"), "link", F.col("ruling_text").alias("text"))).crossJoin(bad)  # one row each
        return out.withColumn("reason", F.when(F.col("_bad") > 0, "ineligible").otherwise(F.col("reason"))).withColumn("text", F.when(F.col("reason").isNull(), F.col("text"))).drop("_bad")

    def lint(self, files: DataFrame | None = None, markers: DataFrame | None = None, strict: bool = False) -> DataFrame:
        """Findings of the record rules; with files (file, lines) of the code, those of concepts and of the citations of lines too; with markers
        (path, topic, link) of the code, those of marks. strict: a citation that leads nowhere is an error."""
        unread = self.quarantined.select("path", F.lit(None).cast("string").alias("link"), F.lit("unreadable").alias("rule"), F.lit("error").alias("severity"), F.array_join("diagnostics", "; ").alias("message"))
        topics = self.good.where("type = 'topic'")
        parts = [lint.link_rules(self.links), lint.topic_rules(topics, self.links), lint.standing_rules(self.pointers, self.links), lint.duplicates(self.good, "id")]
        parts += [lint.record_rules(self.good.where("type <> 'topic'")), lint.stem_rules(self.good), lint.standing_cap_rule(self.standing()), lint.invariant_rules(self.links)]
        own = self.links.withColumn("alternative_authorities", F.col("alternatives.authority")).withColumn("edge_rels", F.col("edges.rel"))
        parts += [lint.enum_rules(own), lint.readoptions(self.links), lint.readoptions(self.links, across_topics=True)]
        if files is not None:
            parts.append(lint.concept_rules(self.good.where("type = 'concept'"), topics.select("id"), files))
            said = F.concat(F.array("ruling_text", "rationale_text"), F.coalesce("evidence", F.array().cast("array<string>")))
            cites = self.links.select("path", "link", F.explode(said).alias("said")).where("said is not null").select("path", "link", F.explode(X.line_citations(F.col("said"))).alias("c"))
            cites = cites.select("path", "link", F.col("c.path").alias("cited"), F.col("c.line").alias("line")).distinct()
            parts.append(lint.citation_rules(cites, files, strict))
        if markers is not None:
            ruled = self.links.select(F.col("topic_id").alias("topic"), "link").distinct()
            refs = self.topic_refs.where(governance.is_anchorable(F.col("ref")) & F.contains("ref", F.lit("#"))).select("topic_path", F.col("topic_id").alias("topic"), "ref")
            refs = refs.join(governance.current_links(self.links).withColumnRenamed("current", "link"), "topic_path").select("topic", "link", "ref")
            parts.append(lint.marker_rules(markers, ruled, refs))
        return reduce(DataFrame.unionByName, parts, unread)


LINK_BODY = "date kind reverses reason_for_change ruling_text authority source rationale_text rationale_authority alternatives evidence revisit_if edges assumptions invariant_kind invariant_pattern invariant_scope invariant_allowed recorded_by recorded_at".split()


def against(sides: DataFrame) -> DataFrame:
    """Findings of the append-only rules over the two sides (side `old` or `new`, path, content) of changed records, as git.read_sides() gives them:
    links, their order and their raw text, lifecycle moves, types, `current`, deleted files; refused, repaired and recovered records.
    A new side that fails validation is refused and judged no further."""
    texts = {n: written(sides.where(F.col("side") == n).select("path", "content"), f"{n}_files") for n in ("old", "new")}
    old, new = (written(R.parse_records(texts[n]), f"{n}_records") for n in ("old", "new"))
    state = lambda df: df.select("path", "type", "valid", R.parsed(df).alias("parsed"), F.size("links").alias("n_links"), "diagnostics")
    good = new.where("valid")
    was = lint.recovered(R.recorded_links(old)).join(good.select("path"), "path", "left_semi")
    now = R.links(new)
    heads = lambda df, l: df.where(R.parsed(df)).select("path", "current").join(governance.current_links(l, "path").withColumnRenamed("current", "head"), "path", "left")
    # A record is judged by `current` where it has links; a null head of one without them is no fault.
    linked = good.where(F.size("links") > 0)
    parts = [lint.repairs(state(old), state(new)), lint.deleted_records(old.where("valid").select("path", "type"), new.select("path"))]
    parts.append(lint.type_changes(old.select("path", "type", (~F.col("valid")).alias("quarantined")), good.select("path", "type")))
    parts.append(lint.history(was, now, LINK_BODY))
    parts.append(lint.current_moves(heads(old, R.recorded_links(old)), heads(linked, now)))
    raw = {n: code_links.spans(texts[n]) for n in ("old", "new")}
    fields = ["path", "link", "status", "superseded_by", "promoted_by", *LINK_BODY]
    parts.append(lint.raw_changes(was.select(*fields).join(raw["old"], ["path", "link"], "left"), now.select(*fields).join(raw["new"], ["path", "link"], "left")))
    return reduce(DataFrame.unionByName, parts)


def code_search(chunks: DataFrame, question: str, *, role: str | None = "code", concept_refs: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = 10) -> DataFrame:
    """rank, path, qualified_name, lines, role, tested_by and concept_id of chunks (path, lang, kind, symbol, qualified_name, signature,
    doc, start_line, end_line, body) that answer a question: those of that very name first, then by full text, fused with
    vectors (path, qualified_name, start_line, vector) where there are any. role: code, test or None for both; the limit comes after it.
    """
    at = ["path", "qualified_name", "start_line"]
    key = F.sha2(F.to_json(F.struct(*at)), 256)
    own = chunks.where("symbol is not null").withColumn("key", key).withColumn("role", X.role_of(F.col("path"), F.col("lang")))
    keep = F.col("role") == role if role else F.lit(True)
    text = F.concat_ws(" ", "symbol", "qualified_name", X.split_symbol(F.col("symbol")), "signature", "doc", X.excerpt(F.col("body")))
    terms = [r["t"] for r in own.sparkSession.range(1).select(F.explode(X.code_tokens(F.lit(question))).alias("t")).collect()]  # one question's terms
    exact = (F.lower("symbol") == question.lower()) | (F.lower("qualified_name") == question.lower())
    named = own.where(keep & exact).select("key")
    scored = rank.bm25(own, "key", text, terms, keep, X.code_tokens) if terms else own.select("key", F.lit(0.0).alias("score")).where("false")
    both = scored.join(named.withColumn("named", F.lit(True)), "key", "full_outer").select("key", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("named", F.lit(False)).alias("named"))
    order = [F.desc("named"), F.desc("score"), F.asc("key")]
    fts = rank.ranked(rank.top_k(both, order, rank.FTS_CAP), order)
    hits = fts.select("key", "rank")
    if vectors is not None and query_vector is not None:
        by = [F.desc("score"), F.asc("key")]
        met = rank.nearest(vectors.withColumn("key", key), "key", "vector", query_vector).join(own.where(keep).select("key"), "key", "left_semi")
        near = rank.ranked(rank.top_k(met, by, rank.FTS_CAP + limit), by)
        # Of vectors further down only those of full-text hits can matter: their ranks are counted, at most FTS_CAP of them.
        far = met.join(F.broadcast(fts.select("key")), "key").join(near.select("key"), "key", "left_anti").select(F.col("key").alias("_k"), F.col("score").alias("_s"))
        before = met.join(F.broadcast(far.limit(rank.FTS_CAP)), (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("key") < F.col("_k"))))
        low = before.groupBy(F.col("_k").alias("key")).agg((F.count("*") + 1).cast("int").alias("rank"))
        fused = rank.rrf([fts, near.select("key", "rank").unionByName(low)], "key", rank.CODE_K).join(fts.select("key", "named"), "key", "left").withColumn("named", F.coalesce("named", F.lit(False)))
        hits = rank.ranked(rank.top_k(fused, order, limit), order).select("key", "rank")
    hits = own.join(hits.where(F.col("rank") <= limit), "key").select("rank", *at, "kind", "symbol", "end_line", "signature", "role")
    tests = own.where("role = 'test'").select("path", F.col("body").alias("text"))
    out = code_links.tested_by(hits, tests)
    if concept_refs is not None:
        out = governance.attach_concepts(out, concept_refs)
    return out.orderBy("rank")


def stats(lines: DataFrame, days: int, now: datetime.datetime) -> dict[str, DataFrame]:
    """Of a log's lines (line, file_name) within the last days: counts by kind and outcome, sessions, reasons, lookup times, hits
    of code searches, topics shown before edits and the most frequent of them."""
    parsed = logs.parse_lines(lines)
    recent = logs.within(parsed, "ts", days, now)
    shown = logs.injected_topics(recent.where("kind = 'pre-edit'"))
    return {
        "counts": logs.counts(recent, "kind", "outcome"),
        "reasons": logs.counts(recent.where("reason is not null"), "reason"),
        "sessions": recent.agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("lines")),
        "elapsed": logs.nearest_rank(recent.where("elapsed is not null").withColumn("elapsed", F.col("elapsed").try_cast("double")), "elapsed", "kind"),
        "hits": logs.counts(recent.where("kind = 'code-search'").select(X.log_field(F.col("line"), "hits").try_cast("int").alias("hits")), "hits"),
        "topics": shown.agg(F.count_distinct("line").alias("lines"), F.count_distinct("topic").alias("topics")),
        "top_topics": logs.top_topics(shown, "topic"),
        "untimed": parsed.agg(F.count_if(F.col("ts").isNull()).alias("untimed")),
    }
