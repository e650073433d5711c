"""Many patterns against many texts: only texts that hold a literal which a pattern requires are met with its regular expression.

Each pattern is reduced to literals one of which every match must hold. Texts are exploded into their distinct character grams and joined by
equality with one gram of each literal: of many patterns the rarest gram in these texts is taken, and the numbers of texts and patterns that
share one are joined back; up to BLOCK patterns are broadcast to short texts, and up to FEW are searched for by their literals alone.
Survivors are tested for the literal, then by the expression. Patterns without such a literal are met with all texts, in broadcast blocks of a stated number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Characters of a gram; shorter literals are grams themselves where texts are short (least=1).
GRAM = 3
#: Patterns up to which a long text is searched for each of their literals: less work than to cut it into grams, which costs as much as some
#: hundred searches.
FEW = 100
MOST_ALTS = 4
#: Patterns that are broadcast at a time, at most.
BLOCK = 1000


def _branches(pattern: str) -> Iterator[str] | None:
    """The alternatives of a pattern at its top level; None if it has a construct that is not looked into."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] in ("", "Q", "E"):
                return None
            i += 1
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] != ":":
                return None
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]] if depth == 0 else None


def _class_end(pattern: str, i: int) -> int | None:
    """Where a class that begins at i ends; None for nested ones, intersections and such as have no end."""
    j = i + 1
    if pattern[j : j + 1] == "^":
        j += 1
    if pattern[j : j + 1] == "]":
        return None
    while j < len(pattern):
        if pattern[j] == "\\":
            j += 1
        elif pattern[j] == "[" or pattern[j : j + 2] == "&&":
            return None
        elif pattern[j] == "]":
            return j
        j += 1
    return None


def _longest(branch: str) -> str:
    """The longest run of characters that every match of a branch holds; groups and classes count as gaps."""
    runs, run, i = [], "", 0
    while i < len(branch):
        c = branch[i]
        one = None
        if c == "\\":
            i += 1
            one = branch[i] if not branch[i].isalnum() else None
        elif c == "[":
            i = _class_end(branch, i)
        elif c == "(":
            depth = 1
            while depth:
                i += 1
                if branch[i] == "\\":
                    i += 1
                elif branch[i] == "[":
                    i = _class_end(branch, i)
                else:
                    depth += (branch[i] == "(") - (branch[i] == ")")
        elif c == "{":
            i = branch.index("}", i) if "}" in branch[i:] else len(branch)
        elif c not in ".^$*+?})":
            one = c
        after = branch[i + 1 : i + 2]
        if one is None:
            runs.append(run)
            run = ""
        elif after in ("*", "?", "{"):  # perhaps not there
            runs.append(run)
            run = ""
        elif after == "+":
            runs.append(run + one)
            run = ""
        else:
            run += one
        i += 1
    return max([*runs, run], key=len)


def required(pattern: str | None, least: int = GRAM) -> list[str] | None:
    """Literals of `least` characters or more, one of which every match of a regular expression holds; None where that cannot be told:
    for flags, look-arounds, quotations, odd classes, and alternatives without a literal."""
    branches = _branches(pattern) if pattern else None
    if not branches:
        return None
    out = sorted({_longest(b) for b in branches}, key=lambda x: (len(x), x))
    return out if len(out[0]) >= least else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def required_literals(pattern: pd.Series) -> pd.Series:
    return pattern.map(required)


def glob_literals(ref: Column) -> Column:
    """The longest part of a glob that every match holds, as an array; null for globs of wildcards alone, and where a class holds a bracket.
    A slash beside a wildcard may go."""
    parts = F.transform(F.split(ref, r"\*|\?|\[[^\]]*\]?"), lambda p: F.regexp_replace(p, "^/+|/+$", ""))
    best = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return F.when((best["n"] > 0) & ~F.rlike(ref, F.lit(r"\[[!^]?\]")), F.array(best["p"]))


def grams(chars: Column, size: int = GRAM) -> Column:
    """Distinct grams of a text given as an array of its characters."""
    joined = lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])
    return F.when(F.size(chars) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - size), joined))).otherwise(F.array().cast("array<string>"))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _exploded(texts: DataFrame, text: str, least: int) -> DataFrame:
    """texts with _g, each gram once."""
    bound = texts.withColumn("_chars", F.explode(F.array(_characters(F.col(text)))))  # behind a generator it is made once
    sizes = range(least, GRAM + 1)
    return bound.withColumn("_g", F.explode(F.concat(*[grams(F.col("_chars"), n) for n in sizes]))).drop("_chars")


def matched(texts: DataFrame, text: str, patterns: DataFrame, regex: str, literals: Column | None = None, least: int = GRAM) -> DataFrame:
    """texts joined with the patterns whose regular expression is found in them: each pair of rows once. Columns of both, which must not clash.

    literals: array<string> of a pattern, of which every text that matches holds one; null where there is none. By default, what
    required() finds in the expression. Literals have at least `least` characters; 1 is for short texts such as paths. Null texts and
    null patterns match nothing. Rows may repeat; an empty side gives no rows. No gram holds a hot share of the work but where
    texts with a literal are as many as that.
    """
    keep = [*texts.columns, *patterns.columns]
    known = patterns.where(F.col(regex).isNotNull()).withColumn("_alts", required_literals(F.col(regex)) if literals is None else literals)
    known = known.withColumn("_pid", F.monotonically_increasing_id())
    texts = texts.where(F.col(text).isNotNull())
    found = F.rlike(F.col(text), F.col(regex))
    with_literal = known.where("_alts is not null").select("*", F.posexplode("_alts").alias("_at", "_literal"))
    # Of several literals of a pattern that a text holds, the first one counts, so a pair comes once.
    before = F.exists(F.slice("_alts", F.lit(1), F.col("_at")), lambda a: F.contains(F.col(text), a))
    holds = F.contains(F.col(text), F.col("_literal")) & ~before & found
    n = known.limit(BLOCK + 1).count()
    if n <= FEW and least == GRAM:
        # A join without a key takes no lambda in its condition: the first MOST_ALTS literals are written out.
        one = [F.coalesce(F.contains(F.col(text), F.get("_alts", F.lit(i))), F.lit(False)) for i in range(MOST_ALTS)]
        some = reduce(Column.__or__, one, F.size("_alts") > MOST_ALTS)
        out = texts.join(F.broadcast(known.where("_alts is not null")), some & found).select(*keep)
    elif n <= BLOCK and least < GRAM:
        few = with_literal.withColumn("_g", F.substring("_literal", 1, GRAM))
        out = _exploded(texts, text, least).join(F.broadcast(few), "_g").where(holds).select(*keep)
    else:
        numbered = written(texts.withColumn("_tid", F.monotonically_increasing_id()), "texts")
        with_literal = written(with_literal, "literals")
        cut = with_literal.select("_pid", "_at", "_literal", F.explode(F.array(_characters(F.col("_literal")))).alias("_chars"))
        each = cut.select("_pid", "_at", F.explode(F.when(F.size("_chars") >= GRAM, grams(F.col("_chars"))).otherwise(F.array("_literal"))).alias("_g"))
        seen = _exploded(numbered.select("_tid", text), text, least).select("_tid", "_g")
        seen = written(seen.join(each.select("_g").distinct(), "_g", "left_semi"), "grams")
        rare = each.join(seen.groupBy("_g").agg(F.count("*").alias("_df")), "_g", "left")
        rare = rare.groupBy("_pid", "_at").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g"))
        pairs = seen.join(rare, "_g").select("_tid", "_pid", "_at")
        out = numbered.join(pairs, "_tid").join(with_literal, ["_pid", "_at"]).where(holds).select(*keep)
    rest = known.where("_alts is null")
    for b in range(blocks := -(-rest.count() // BLOCK)):
        part = rest.where(F.pmod(F.xxhash64("_pid"), F.lit(blocks)) == b) if blocks > 1 else rest
        out = out.unionByName(texts.join(F.broadcast(part), found).select(*keep))
    return out
