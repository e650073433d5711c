"""Text, path and citation functions as Column expressions: all stay on the JVM, inside code generation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_ACCENTED = "àáâãäåāçćčèéêëēìíîïñńòóôõöøùúûüýÿžšßÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_FOLDED = "aaaaaaaccceeeeeiiiinnoooooouuuuyyzssaaaaaaceeeeiiiinooooouuuuy"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def runs(text: Column, other: str) -> Column:
    """What stands between matches of `other`, without empty pieces: a split is many times faster than regexp_extract_all, which copies
    the text for each match."""
    return F.filter(F.split(text, other), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of [a-z0-9], in order, with repetition."""
    return runs(F.lower(text), "[^a-z0-9]+")


def content_terms(text: Column) -> Column:
    """Distinct tokens of two or more characters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(fixed.STOPWORDS)))


def prompt_terms(text: Column, most: int = 12) -> Column:
    """Content terms of three or more characters without conversational filler, at most `most`, in order."""
    return F.slice(F.filter(content_terms(text), lambda t: (F.length(t) >= 3) & ~t.isin(fixed.PROMPT_FILLER)), 1, most)


def record_tokens(text: Column) -> Column:
    """Full-text tokens of records: letters and digits of any script, diacritics folded."""
    return runs(F.translate(F.lower(text), _ACCENTED[: len(_FOLDED)], _FOLDED), r"[^\p{L}\p{N}]+")


def code_tokens(text: Column) -> Column:
    """Full-text tokens of code: as record_tokens, with the underscore as a letter."""
    return runs(F.translate(F.lower(text), _ACCENTED[: len(_FOLDED)], _FOLDED), r"[^\p{L}\p{N}_]+")


def split_symbol(symbol: Column) -> Column:
    """Words of a camelCase or snake_case symbol, lower-cased."""
    apart = F.regexp_replace(F.regexp_replace(symbol, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def path_tokens(path: Column, most: int = 12) -> Column:
    """Query words of a path: final extension off, split at separators and case changes, generic stems and short words out."""
    base = F.substring_index(path, "/", -1)
    cut = F.when(F.contains(base, F.lit(".")), F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)
    apart = F.regexp_replace(F.translate(cut, "/\\_.-", "     "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.lower(apart), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.GENERIC_STEMS))), 1, most)


def extension_of(path: Column) -> Column:
    """Extension with its dot; listed compound ones as a whole; none for dotfiles and names without."""
    base = F.substring_index(path, "/", -1)
    out = F.when(F.ltrim(base, F.lit(".")).contains("."), F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")
    for x in fixed.COMPOUND_EXTENSIONS:
        out = F.when(base.endswith(x) & (base != x), x).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """Language by extension; null for unknown and compound ones."""
    base = F.substring_index(path, "/", -1)
    out = F.lit(None).cast("string")
    for lang, row in fixed.LANGUAGES.items():
        out = F.when(extension_of(path).isin(row[0]), lang).otherwise(out)
    for x in fixed.COMPOUND_EXTENSIONS:
        out = F.when(base.endswith(x), None).otherwise(out)
    return out


def language_of_shebang(line: Column) -> Column:
    """Language by the interpreter of a #! line, through env; a stem matches as a prefix."""
    parts = F.filter(F.split(F.substring(line, 3, 1 << 20), r"\s+"), lambda p: p != "")
    first = F.substring_index(F.get(parts, F.lit(0)), "/", -1)
    name = F.when((first == "env") & (F.size(parts) > 1), F.substring_index(F.get(parts, F.lit(1)), "/", -1)).otherwise(first)
    out = F.lit(None).cast("string")
    for lang, row in fixed.LANGUAGES.items():
        for stem in row[1]:
            out = F.when(name.startswith(stem), lang).otherwise(out)
    return F.when(line.startswith("#!"), out)


def glob_regex(glob: str) -> str:
    """A file-name glob (* also crosses /) as an anchored regular expression that both Java and RE2 read."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def glob_pattern(glob: Column) -> Column:
    """glob_regex() for a column of globs."""
    quoted = F.regexp_replace(glob, r"([.\\+^$(){}|])", r"\\$1")
    stars = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(stars, r"\[!", "[^"), F.lit("$"))


def role_of(path: Column, lang: Column) -> Column:
    """`test` or `code` from the parts of a root-relative path and its language's marks; case counts."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    dirs, base = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    joined = F.concat(F.lit("/"), F.array_join(dirs, "/"), F.lit("/"))
    out = F.lit("code")

    def any_dir(glob: str) -> Column:
        return F.exists(dirs, lambda d: F.rlike(d, F.lit(glob_regex(glob))))

    for name, (_, _, _, names, globs, runs, files) in fixed.LANGUAGES.items():
        hit = F.lit(False)
        if names:
            hit = hit | F.arrays_overlap(dirs, literals(names))
        for g in globs:
            hit = hit | any_dir(g)
        for r in runs:
            hit = hit | F.contains(joined, F.lit(f"/{r}/"))
        for g in files:
            hit = hit | base.rlike(glob_regex(g))
        out = F.when((lang == name) & (F.size(parts) > 0), F.when(hit, "test").otherwise("code")).otherwise(out)
    return out


def skipped_for(path: Column, lang: Column) -> Column:
    """Whether a directory of the path is noise for the file's own language."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.lit(False)
    for name, row in fixed.LANGUAGES.items():
        if row[2]:
            out = F.when(lang == name, F.arrays_overlap(dirs, literals(row[2]))).otherwise(out)
    return out


def flat_line(text: Column) -> Column:
    """Line ends of all kinds and tabs as single spaces."""
    return F.regexp_replace(text, "[\\r\\n\\t\\u0085\\u2028\\u2029]+", " ")


def squeezed(text: Column) -> Column:
    """White space trimmed and collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def link_key(text: Column) -> Column:
    return F.concat(F.lit("link:"), F.sha2(text, 256))


def short_hash(*parts: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-256 of the parts, each ended by a line end."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\n"))]), 256), 1, length)


def commit_citations(text: Column) -> Column:
    """Cited commit hashes (7 or 40 hex digits after commit, merge, at, as, or in back ticks), in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(fixed.COMMIT), F.lit(0)), lambda m: F.regexp_extract(m, "([0-9a-f]{40}|[0-9a-f]{7})`?$", 1))


def commit_subjects(text: Column) -> Column:
    """What follows a quoted commit or merge citation on its line: (hash, subject) pairs as text `hash subject`."""
    found = F.regexp_extract_all(text, F.lit(r'\b(?i:commit|merge)\b\s+(?:[0-9a-f]{40}|[0-9a-f]{7})\b[ \t]*"[^\n]*'), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"([0-9a-f]{40}|[0-9a-f]{7})\b", 1).alias("hash"), F.regexp_extract(m, '"([^\\n]*)', 1).alias("subject")))


def line_citations(text: Column) -> Column:
    """path:line citations as (path, line); the extension is required and no match starts inside a longer path."""
    found = F.regexp_extract_all(text, F.lit(fixed.PATH_LINE), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^(.*):\d+(?:[-,]\d+)?$", 1).alias("path"), F.regexp_extract(m, r":(\d+)(?:[-,]\d+)?$", 1).cast("long").alias("line")))


def decision_markers(text: Column) -> Column:
    """(topic, link) of `decision: TOP-n Ln` marks in code."""
    found = F.regexp_extract_all(text, F.lit(r"decision:\s*TOP-\d+\s+L\d+\b"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"(TOP-\d+)", 1).alias("topic"), F.regexp_extract(m, r"(L\d+)$", 1).alias("link")))


def is_machine_prompt(text: Column) -> Column:
    """Text that a tool sent, by the fixed beginnings of such texts."""
    start = F.regexp_replace(text, r"^\s+", "")
    out = F.lit(False)
    for p in fixed.MACHINE_PROMPT_PREFIXES:
        out = out | start.startswith(p)
    return out


def log_query(text: Column) -> Column:
    """A query as it may be logged: its first 40 characters, of them [A-Za-z0-9._-]."""
    return F.regexp_replace(F.substring(text, 1, 40), "[^A-Za-z0-9._-]", "")


def log_path_token(path: Column, most: int = 512) -> Column:
    """A path as one log token: bytes outside [A-Za-z0-9/._~:!-] percent-encoded, cut to whole encoded units within `most` bytes."""
    hexed = F.split(F.hex(F.encode(path, "UTF-8")), "(?<=\\G..)")
    keep = "[A-Za-z0-9/._~:!-]"
    coded = F.transform(F.filter(hexed, lambda h: h != ""), lambda h: F.when(F.decode(F.unhex(h), "ISO-8859-1").rlike(keep), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("%"), h)))
    whole = F.array_join(coded, "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(F.substring(whole, 1, most), "%[0-9A-F]?$", ""))


def log_field(line: Column, name: str) -> Column:
    """The value of name= in a log line; project and file run to their neighbour or the end of the line, others to white space."""
    if name == "file":
        return F.nullif(F.regexp_extract(line, r"(?:^|\s)file=(.*?)(?:\s+session=\S*)?(?:\s+project=\S*)?$", 1), F.lit(""))
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s){re.escape(name)}=(\S*)", 1), F.lit(""))


def embedding_text(title: Column, body: Column, ruling: Column, rationale: Column, is_link: Column) -> Column:
    """What is embedded: title and ruling with its reason for a link, title and 1,500 characters of body for others."""
    link = F.concat_ws("\n", F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(ruling, F.lit(""))), F.coalesce(rationale, F.lit("")))
    return F.when(is_link, link).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(body, F.lit("")), 1, 1500)))


def excerpt(body: Column, lines: int = 25) -> Column:
    return F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n")


def snippet(body: Column, ruling: Column, length: int = 200) -> Column:
    """Short text of a hit, from the ruling where there is no body."""
    text = F.coalesce(F.nullif(F.trim(F.coalesce(body, F.lit(""))), F.lit("")), ruling, F.lit(""))
    return F.substring(squeezed(text), 1, length)


def pack_hash_line(text: Column) -> Column:
    return F.concat(F.lit("pack sha256="), F.sha2(text, 256), F.lit(" bytes="), F.octet_length(text).cast("string"))


def note_decoded(value: Column) -> Column:
    """%20 and %25 decoded, the latter last."""
    return F.replace(F.replace(value, F.lit("%20"), F.lit(" ")), F.lit("%25"), F.lit("%"))


def note_encoded(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))


def chain_line(link: Column, date: Column, status: Column, authority: Column, text: Column) -> Column:
    """One line of a chain: link, date, status and authority where there are any, and the ruling on one line."""
    head = F.concat_ws(" ", link, date, F.concat(F.lit("["), F.concat_ws(", ", status, authority), F.lit("]")))
    return F.concat(head, F.lit(": "), flat_line(F.coalesce(text, F.lit(""))))


@F.pandas_udf(T.StringType())
def pattern_problem(pattern: pd.Series) -> pd.Series:
    """Why a regular expression does not compile; null if it does. For distinct patterns, which are few."""

    def problem(p):
        try:
            re.compile(p)
        except (re.error, RecursionError, OverflowError) as e:
            return str(e)

    return pattern.map(problem).astype(object).where(lambda x: x.notna(), None)
