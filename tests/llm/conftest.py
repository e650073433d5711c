import random

import pytest

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Few documents with everything odd: nulls in all columns, empty and very long texts, repeated rows, near copies, columns with the names of results."""
    r = random.Random(5)
    voc = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(800)]
    text = lambda n: " ".join(r.choice(voc) for _ in range(n))
    base = text(120).split()
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \t\n", None, "s", 3), (4, "One", "de", "s", 3), (None, "null id " + text(40), "en", "s", 9), (5, " ".join(base), "en", "s", 1)]
    for i in range(6, 26):
        b = list(base)
        b[r.randrange(120)] = "x%d" % i
        if i % 3 == 0:
            b[r.randrange(120)] = "y%d" % i
        rows.append((i, " ".join(b), "en", "s", 1))
    rows += [(26, rows[5][1], "fr", "s", 1), (26, rows[5][1], "fr", "s", 1)]  # a copy, and a repeated row
    rows += [(27, text(20000), "en", "t", 1), (28, ("loop " * 3000).strip(), "en", "t", 1), (29, "é ü ñ " + text(60), "fr", None, 1)]
    rows += [(30 + i, text(r.randrange(1, 200)), r.choice(["en", "de", "fr", "es", None]), r.choice(["s", "t", None]), 1) for i in range(30)]
    out = spark.createDataFrame(rows, DOCS)
    for c in ("score", "kept", "n_words", "topic", "spans", "component_id", "held_out"):
        out = out.withColumn(c, out["lang"])
    return out.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
