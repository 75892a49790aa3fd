"""Scalar expressions over names, paths, identifiers and texts. All of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "urn:loom"


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+", "")


def urn(kind: str, path: Column, ident: Column | None = None) -> Column:
    parts = [F.lit(f"{PREFIX}:{kind}:"), normal_path(path)]
    return F.concat(*parts, *([F.lit("#"), ident] if ident is not None else []))


def symbol_urn(path: Column, name: Column, scope: Column | None = None) -> Column:
    return urn("symbol", path, name if scope is None else F.when(scope.isNull(), name).otherwise(F.concat(scope, F.lit("."), name)))


def route_urn(path: Column, method: Column, route: Column) -> Column:
    return urn("route", path, F.concat(F.upper(method), F.lit(":"), F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route))))


def feature_urn(name: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX}:feature:"), slug(name))


def urn_part(value: Column, part: str) -> Column:
    """kind, path or ident of an identifier; null where it isn't one (an ident may be missing, which gives null too)."""
    pattern = rf"^{PREFIX}:([a-z]+):([^#]+)(?:#(.*))?$"
    return F.nullif(F.regexp_extract(value, pattern, {"kind": 1, "path": 2, "ident": 3}[part]), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def candidate_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def words(text: Column, split_digits: bool = True) -> Column:
    """Lower-case words of camelCase, snake_case and other names; with ``split_digits`` a digit after a letter begins a word."""
    x = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    if split_digits:
        x = F.regexp_replace(x, "([A-Za-z])([0-9])", "$1 $2")
    return F.transform(F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda w: w != ""), F.lower)


def same_word(word: Column, other: Column) -> Column:
    """Equal, or equal without one final s."""
    return (F.regexp_replace(word, "s$", "") == F.regexp_replace(other, "s$", "")) | (word == other)


def word_hit(ws: Column, token: Column) -> Column:
    return F.exists(ws, lambda w: same_word(w, token) | ((F.length(token) >= 4) & w.startswith(token)))


def query_tokens(query: str, stopwords: frozenset[str] = frozenset({"the", "and", "for", "with", "how", "does", "what", "where", "that", "this", "from"})) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) >= 3 and t not in stopwords]


def keyword_score(keyword: Column, symbol_words: Column, path_words: Column) -> Column:
    n = F.length(keyword)
    is_word = lambda w: same_word(w, keyword)
    begins = lambda w: w.startswith(keyword)
    return (
        F.when(F.exists(symbol_words, is_word), 100 + n)
        .when(F.exists(path_words, is_word), 80 + n)
        .when((n >= 4) & F.exists(symbol_words, begins), 40 + n)
        .when((n >= 4) & F.exists(path_words, begins), 30 + n)
        .otherwise(0)
    )


def glob_regex(glob: str) -> str:
    """** is any text, * any text within a folder; all else stands for itself."""
    return "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)) + "$"


PUNCTUATION = r"[{}()\[\];:,.<>=+\-*/&|!?]"


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.3) + F.lit(0.25) * F.regexp_count(text, F.lit(PUNCTUATION))).cast("bigint")


def ledger_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.8)).cast("bigint")


SKIPPED_SEGMENTS = ["api", "v1", "v2", "v3", "app", "routes"]
SKIPPED_PAGES = ["rss", "sitemap", "robots", "favicon", "og", "manifest"]


def route_domain(route: Column) -> Column:
    """The first segment of a route that names a subject; null if none does."""
    parts = F.filter(F.split(route, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$") & ~p.isin(SKIPPED_SEGMENTS) & ~p.startswith("["))
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\.[A-Za-z0-9]+$", "")), lambda p: ~F.lower(p).isin(SKIPPED_PAGES))
    return F.get(bare, F.lit(0))


def structural_folder(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)(?:features|modules)/([^/]+)/", 1), F.lit(""))


def title(text: Column) -> Column:
    x = F.regexp_replace(text, "[-_]", " ")
    return F.concat(F.upper(F.substring(x, 1, 1)), F.expr("''"), F.substring(x, 2, 1 << 30))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole).cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def slice_hash(text: Column, start: Column, end: Column) -> Column:
    """16 hex digits of the hash of lines start to end (from 1)."""
    return F.substring(F.sha2(F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n"), 256), 1, 16)


def confidence(evidence: Column) -> Column:
    """Confidence level of a set of evidence types: the strongest decides."""
    has = lambda *names: F.arrays_overlap(evidence, F.array(*map(F.lit, names)))
    return F.when(has("explicit_declaration"), "EXPLICIT").when(has("route_match", "model_ref", "directory_cluster", "ast_call"), "DETECTED").when(has("semantic_similarity"), "INFERRED").otherwise("AMBIGUOUS")


def risk(features: Column, models: Column, apis: Column, tests: Column, symbols: Column) -> Column:
    return F.when((features >= 3) | (models > 0) | ((apis > 0) & (tests > 5)), "HIGH").when((features >= 1) | (apis > 0) | (symbols >= 5), "MEDIUM").otherwise("LOW")


def coupling(score: Column) -> Column:
    return F.when(score >= 20, "HIGH").when(score >= 8, "MEDIUM").otherwise("LOW")


def is_ui(symbol_kind: Column, path: Column) -> Column:
    return F.coalesce(symbol_kind == "component", F.lit(False)) | path.rlike(r"(^|/)components/|\.(tsx|jsx)$")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.|_test\.|(^|/)test_|\.config\.|\.d\.ts$")


def is_entry_path(path: Column) -> Column:
    """Where programs begin, or what no program needs to import: indexes, mains, servers, commands, tests and their data."""
    return path.rlike(r"(index\.[jt]s|main\.[jt]s|server\.js|app\.ts|\.test\.[jt]s)$|^bin/|tests/|fixtures/")


def is_builtin(name: Column, names: Column) -> Column:
    """Whether the last part of a dotted name is among an array of builtin names."""
    return F.array_contains(names, F.element_at(F.split(name, r"\."), -1))
