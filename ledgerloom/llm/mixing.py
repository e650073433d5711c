"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed into cells (source, language, topic); the token weights of the cells are raked in turn to the target
share of each source, language and topic until they meet all three. A cell's raked weight over its tokens is the rate at
which its documents are drawn; rates are scaled to a token budget, at most 1 a document, and each document is drawn by a
hash of its id. Only the cells take part in the iterations.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, all_salts, as_row, discard, materialize

MARGINS = ("source", "lang", "topic")
#: Targets are shares of tokens to this power, normalised, where none are given.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 1.0}
BUDGET = 0.5
#: Rounds end when every margin is met to TOLERANCE, or when a round changes no share by as much: targets that contradict each
#: other, or cells that are missing, leave a rest, which is reported. MOST_ROUNDS is a guard only, and reported as well.
TOLERANCE, MOST_ROUNDS = 1e-6, 500
ROUNDS_A_JOB = 4
#: More cells than this are not broadcast.
MOST_CELLS = 50_000


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The form of a text, where the table names no topic: tabular, listing or prose, the last by length."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (
        F.when(F.coalesce(tokens, F.lit(0)) == 0, "empty")
        .when(F.contains(text, F.lit(" | ")), "tabular")
        .when(lines * 12 > tokens, "listing")
        .when(tokens < 100, "short prose")
        .when(tokens < 1000, "prose")
        .otherwise("long prose")
    )


def _targets(cells: DataFrame, name: str, given: dict[str, float] | None) -> DataFrame:
    """(name, target): shares that add up to 1 over the values that have tokens."""
    have = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is None:
        weight = F.pow(F.col("t").cast("double"), F.lit(TEMPER[name]))
    else:
        table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.element_at(table, F.col(name)), F.lit(0.0)) if given else F.lit(0.0)
    weighed = have.select(name, weight.alias("w"))
    whole = weighed.agg(F.sum("w")).first()[0] or 0.0
    return weighed.select(name, (F.col("w") / F.lit(whole) if whole > 0 else F.lit(0.0)).alias("target"))


def _off(cells: DataFrame) -> float:
    """How far the shares are from the targets at most, over all margins."""
    worst = 0.0
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("weight").alias("have"), F.max(f"_{m}").alias("want"))
        worst = max(worst, sums.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
    return worst


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, shares of 1 that meet the targets as far as the cells allow.

    A value with tokens but no target, or target 0, gets the weight 0; targets of values without tokens are passed over. Where
    the margins cannot all be met to `tolerance`, the topic's, raked last, are, and a warning says how far the others are off.
    """
    now = cells
    for m in MARGINS:
        now = now.join(_targets(cells, m, (targets or {}).get(m)).withColumnRenamed("target", f"_{m}"), m, "left")
    now = table = materialize(now.select(*MARGINS, "tokens", *[F.coalesce(f"_{m}", F.lit(0.0)).alias(f"_{m}") for m in MARGINS], F.col("tokens").cast("double").alias("weight")), "cells")
    rounds = 0
    while True:
        for k in range(ROUNDS_A_JOB):
            if k == ROUNDS_A_JOB - 1:
                now = now.withColumn("_old", F.col("weight"))
            for m in MARGINS:
                now = now.withColumn("_have", F.sum("weight").over(Window.partitionBy(m)))
                now = now.withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_{m}") / F.col("_have")).otherwise(0.0)).drop("_have")
        before, table = table, materialize(now, f"rake{rounds}")
        discard(before)
        now, rounds = table.drop("_old"), rounds + ROUNDS_A_JOB
        moved, off = table.agg(F.max(F.abs(F.col("weight") - F.col("_old")))).first()[0] or 0.0, _off(table)
        if off <= tolerance or (rounds > ROUNDS_A_JOB and moved <= tolerance * tolerance) or rounds >= most_rounds:
            break
    if off > tolerance:
        warnings.warn(f"after {rounds} rounds the shares of a margin are off by up to {off:.3g}", stacklevel=2)
    return now.select(*MARGINS, "tokens", "weight")


def rates(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells (…, tokens, weight) with rate: weight / tokens, scaled so that the expected tokens are `budget` of all, at most 1.

    Where some rates reach 1, the others are scaled up to spend what is left, until no further rate reaches 1.
    """
    own = cells.withColumn("_f", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    spend, weight = own.agg(F.sum("tokens").cast("double") * F.lit(float(budget)), F.sum("weight")).first()
    scale = spend / weight if weight else 0.0
    while weight:
        full = F.col("_f") * F.lit(scale) >= 1
        used, rest = own.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        more = (spend - used) / rest if rest > 1e-12 else scale
        if more <= scale * (1 + 1e-12):
            break
        scale = more
    return own.withColumn("rate", F.least(F.lit(1.0), F.col("_f") * F.lit(scale))).drop("_f")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 9, topic: Column | None = None) -> DataFrame:
    """docs with topic, n_tokens, weight (of the document: its share of the raked whole), rate and sampled.

    targets: for source, lang or topic, value -> share; where a margin has none, the shares of tokens to the power TEMPER.
    Null sources, languages and topics are the value "(none)". Null texts and texts without words have no weight and the rate 0;
    very long texts count as a whole. Rows are drawn by doc_id (and text, where that is null), so repeated rows share
    their fate. An empty table gives an empty result. Columns with the names of results are replaced (a topic column is read
    first), others, however named, come back unchanged.
    """
    own = {"topic", "n_tokens", "weight", "rate", "sampled"}
    return _mixed(docs, targets, budget, seed, topic).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in own], *sorted(own, key=["topic", "n_tokens", "weight", "rate", "sampled"].index))


def draw(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 9, topic: Column | None = None) -> DataFrame:
    """The documents that mix() samples; all columns of docs, those named like results too, come back unchanged."""
    return _mixed(docs, targets, budget, seed, topic).where("sampled").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, seed: int, topic: Column | None) -> DataFrame:
    """row (all columns of docs) with the results of mix()."""
    if topic is None and "topic" in [c.lower() for c in docs.columns]:
        topic = F.col("topic")
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    base = docs.select(as_row(docs).alias("row"), n_tokens(F.col("text")).alias("n_tokens"), key.alias("key"), *[F.coalesce(F.col(m).cast("string"), F.lit("(none)")).alias(m) for m in ("source", "lang")], (topic if topic is not None else F.lit(None)).cast("string").alias("topic"))
    base = base.withColumn("topic", F.coalesce("topic", F.lit("(none)")) if topic is not None else topic_of(F.col("row")["text"], F.col("n_tokens")))
    cells = materialize(base.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "sums")
    rated = materialize(rates(rake(cells, targets), budget), "rates").withColumnRenamed("weight", "cell_weight").withColumnRenamed("rate", "cell_rate")
    if rated.count() <= MOST_CELLS:
        joined = base.join(F.broadcast(rated), [*MARGINS], "left")
    else:  # a hot cell's documents are dealt over SALTS tasks
        joined = base.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(rated.withColumn("salt", F.explode(all_salts())), [*MARGINS, "salt"], "left")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("cell_rate", F.lit(0.0))).otherwise(0.0)
    weight = F.when(F.col("tokens") > 0, F.col("cell_weight") * F.col("n_tokens") / F.col("tokens")).otherwise(0.0)
    return joined.select("row", "topic", "n_tokens", weight.alias("weight"), rate.alias("rate"), (uniform(F.col("key"), seed) < rate).alias("sampled"))
