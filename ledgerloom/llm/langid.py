"""Language identification in two steps: the language family, then the language within it.

Linear support vector machines on hashed byte n-grams of the lower-cased text (square roots of frequencies): one against
the rest for families, one against one for the closely related languages of a family, by votes and then margins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, crc_mod, discard, fit_sample, map_batches, materialize, place

# Families by ISO 639-1 code; a language that is not listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl be mk bs",
    "indic": "hi bn pa mr gu ne ur",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he am mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
#: Bounds of the sample to fit on: documents in all, of one language, bytes of one.
MOST_DOCS, PER_LANGUAGE, MOST_BYTES = 6000, 600, 1 << 16
#: Bytes of a text that are cut into grams at a time.
STRETCH = 1 << 20
#: Tasks that train machines.
MOST_TASKS = 200
_WORDY = re.compile(r"[^\W\d_]")
RESULT = "lang_pred string, score double"


def _has_letter(text: str) -> bool:
    """Whether text has a letter (Unicode's categories L); fractions, raised digits and the like are none."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def _bins(raw: np.ndarray) -> np.ndarray:
    """The hashed 2- and 3-byte grams of some bytes, counted."""
    code = raw.astype(np.uint32)
    two = code[:-1] | code[1:] << np.uint32(8)
    out = np.zeros(1 << BITS, np.float32)
    for gram in (two | np.uint32(1 << 24), two[:-1] | code[2:] << np.uint32(16)):
        out += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """A row of unit length for each text: square roots of the frequencies of its hashed 2- and 3-byte grams.

    Whole texts count, a long one STRETCH bytes at a time, so memory is bounded by the text and not a multiple of it; a row depends on its own text only.
    """
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, t in zip(out, texts, strict=True):
        raw = np.frombuffer(f" {t.lower()} ".encode("utf-8", "replace"), np.uint8)
        for a in range(0, max(1, raw.size - 2), STRETCH):  # grams that begin in this stretch
            row += _bins(raw[a : a + STRETCH + 2])
            if a + STRETCH + 2 < raw.size:  # its last 2-byte gram is the first of the next stretch
                last = np.uint32(raw[a + STRETCH]) | np.uint32(raw[a + STRETCH + 1]) << np.uint32(8) | np.uint32(1 << 24)
                row[int(last) * 0x9E3779B1 % (1 << 32) >> 32 - BITS] -= 1
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, steps: int = 70) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is -1 or 1."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), b
    weight = (c * weight / weight.sum()).astype(np.float32)
    rate, t = 1 / (1 + 4 * c), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + np.float32(vb))) * weight
        new, new_b = v - rate * (v - 2 * ((slack * y) @ x)), vb + rate * 2 * float((slack * y).sum())
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2  # a plain number: one of numpy's would make doubles of all
        v, vb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def _machines(langs: list[str]) -> dict[str, tuple[set[str], set[str]]]:
    """Name -> (languages on its positive side, on its negative side): one against the rest for families, one against one within them."""
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    out = {f"family {f}": (set(members[f]), set(langs) - set(members[f])) for f in families} if len(families) > 1 else {}
    return out | {f"pair {m[i]} {m[j]}": ({m[i]}, {m[j]}) for m in members.values() for i in range(len(m)) for j in range(i + 1, len(m))}


def _train(machines: dict[str, tuple[set[str], set[str]]]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = np.array([1 if x in machines[key[0].as_py()][0] else -1 for x in table.column("label").to_pylist()], np.float32)
        balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, b = _svm(vectors(table.column("text").to_pylist()), y, balance)
        return pa.table({"machine": [key[0].as_py()], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": [float(b)]})

    return run


def fit(docs: DataFrame, labelled: DataFrame, most_docs: int = MOST_DOCS, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES) -> dict:
    """labelled: (doc_id, lang); nulls are passed over, as are doc_ids with several languages.

    The sample has at most most_docs documents, per_language of each language and most_bytes of each document (longer ones are
    passed over); each machine is trained in a task of its own from its rows of the sample, and only weights reach the driver.
    Without labelled texts the model knows no language.
    """
    labelled = labelled.where("lang is not null and doc_id is not null").select("doc_id", F.col("lang").alias("label"))
    languages = labelled.select("label").distinct().count()
    if not languages:
        return {"families": [], "members": {}, "family": [], "pairs": {}}
    sample = fit_sample(docs, labelled, max(1, min(per_language, most_docs // languages)), most_bytes, most_classes=most_docs)
    sample = materialize(sample.where(F.col("text").rlike(r"\p{L}")), "sample")
    langs = sorted(r[0] for r in sample.select("label").distinct().collect())
    machines = _machines(langs)
    uses = [(x, name) for name, sides in machines.items() for x in sorted(sides[0] | sides[1])]
    found = {}
    if machines:
        wanted = docs.sparkSession.createDataFrame(uses, "label string, machine string")
        rows = sample.join(F.broadcast(wanted), "label")
        trained = rows.repartition(min(len(machines), MOST_TASKS), "machine").groupBy("machine").applyInArrow(_train(machines), "machine string, w binary, b double")
        found = {r["machine"]: (np.frombuffer(r["w"], np.float32), r["b"]) for r in trained.collect()}
    discard(sample)
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    return {
        "families": families, "members": members,
        "family": [found[f"family {f}"] for f in families] if len(families) > 1 else [],
        "pairs": {f: [(i, j, *found[f"pair {m[i]} {m[j]}"]) for i in range(len(m)) for j in range(i + 1, len(m))] for f, m in members.items()},
    }


def predict(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    n, families = len(x), model["families"]
    if model["family"]:
        margin = np.stack([x @ w + b for w, b in model["family"]], 1)
        sharp = np.exp(3 * (margin - margin.max(1, keepdims=True)))
        chosen, sure = margin.argmax(1), (sharp / sharp.sum(1, keepdims=True)).max(1)
    else:
        chosen, sure = np.zeros(n, int), np.ones(n)
    langs, scores = [""] * n, np.array(sure, float)
    for k, f in enumerate(families):
        rows = np.flatnonzero(chosen == k)
        m = model["members"][f]
        votes, worth = np.zeros((rows.size, len(m))), np.zeros((rows.size, len(m)))
        for i, j, w, b in model["pairs"][f]:
            d = x[rows] @ w + b
            p = 1 / (1 + np.exp(-3 * d))
            votes[:, i] += d >= 0
            votes[:, j] += d < 0
            worth[:, i] += p
            worth[:, j] += 1 - p
        best = (votes + worth / (len(m) + 1)).argmax(1) if rows.size else np.empty(0, int)
        for r, b in zip(rows.tolist(), best.tolist(), strict=True):
            langs[r] = m[b]
        if len(m) > 1:
            scores[rows] *= worth[np.arange(rows.size), best] / (len(m) - 1)
    return langs, np.clip(scores, 0, 1)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs (text, any other columns) with lang_pred and score.

    Null and empty texts and texts without a letter get `und`, score 0; so do all texts under a model that has seen none. Very long
    texts count as a whole. Rows are judged one by one: equal texts get equal results, repeated rows repeat, ties go to the
    language that sorts first, an empty table gives an empty result. Columns with the names of results are replaced,
    others, however named, come back unchanged. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = appended(docs.schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(place(batch.schema.names, "text")).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if t and own["families"] and _has_letter(t)]
            at = 0
            while at < len(todo):
                end, size = at, 0
                while end < len(todo) and end - at < 128 and (end == at or size + len(texts[todo[end]]) <= 1 << 20):
                    size += len(texts[todo[end]])
                    end += 1
                rows = todo[at:end]
                names, sure = predict(vectors([texts[i] for i in rows]), own)
                for i, name in zip(rows, names, strict=True):
                    lang[i] = name
                score[rows] = sure
                at = end
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name.lower() not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(lang, pa.string()), pa.array(score)], names=[n for n, _ in kept] + ["lang_pred", "score"])

    return map_batches(docs, run, schema)


def fold(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, lang) to learn from: documents whose crc32(doc_id as text) leaves another remainder."""
    return docs.where(crc_mod("doc_id", modulus) != held).select("doc_id", "lang")
