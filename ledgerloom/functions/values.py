"""Scalar functions on numbers, dates, arrays and maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a norm is 0; null where the lengths differ or a component is null or not finite."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, e: s + e)

    def odd(v: Column) -> Column:
        return F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))

    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    return F.when((F.size(x) == F.size(y)) & ~odd(x) & ~odd(y), F.when(norm == 0, 0.0).otherwise(dot / norm))


def fingerprints_match(stored: Column, current: Column) -> Column:
    """`k=v;k=v` fingerprints agree in every key; `revision` counts only where neither side is `unknown`. Null never matches."""
    a, b = (F.str_to_map(x, F.lit(";"), F.lit("=")) for x in (stored, current))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))

    def same(k: Column) -> Column:
        left, right = F.try_element_at(a, k), F.try_element_at(b, k)
        free = (k == "revision") & ((F.coalesce(left, F.lit("")) == "unknown") | (F.coalesce(right, F.lit("")) == "unknown"))
        return free | F.coalesce(left == right, F.lit(False))

    return stored.isNotNull() & current.isNotNull() & F.forall(keys, same)


def recorded_at_problem(date: Column, recorded_at: Column) -> Column:
    """Why a timestamp is no ISO-8601 one with an offset, or its written date is another than `date`; null if neither."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(~F.coalesce(recorded_at.rlike(shape), F.lit(False)), "no timestamp with offset").when(F.substring(recorded_at, 1, 10) != date, "date differs")


def log_time(stamp: Column) -> Column:
    """ISO timestamps with an offset; zone-less ones are read in the session's zone; null for others."""
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))


def coverage(query_terms: Column, document_terms: Column) -> Column:
    """Share of the query's terms that the document has; null without terms."""
    return F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, document_terms)) / F.size(query_terms))


def coprime_offset(n: int) -> int:
    """The offset nearest to n // 2, the larger on a tie, that shares no factor with n."""
    if n < 2:
        raise ValueError("at least two members are needed")
    return min((o for o in range(1, n) if math.gcd(o, n) == 1), key=lambda o: (abs(o - n // 2), -o))


def coprime_column(n: Column) -> Column:
    """coprime_offset() of a column: half of an odd number, rounded down; one more than half of one that four divides; else two more, or 1 for 2."""
    half = F.floor(n / 2)
    return F.when(n % 2 == 1, F.when(n > 1, half)).when(n == 2, 1).when(n % 4 == 0, half + 1).otherwise(half + 2)


def validated_evidence(evidence: Column) -> Column:
    """Evidence with at least one entry that is not blank."""
    return F.coalesce(F.exists(evidence, lambda e: F.trim(e) != ""), F.lit(False))
