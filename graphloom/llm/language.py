"""Language identification by fusing evidence in log space.

Text likelihoods (a naive Bayes model over hashed byte trigrams, with a uniform model for "und"), the declared markup language,
the address suffix and a prior by host are added up. The host's prior is its count of text-only decisions, shrunk towards its
registered domain's, that towards its suffix's and that towards the corpus's; grouped aggregations over all rows give the counts.
Each level leaves out the rows of the one below, so that a row counts once in its host's prior; names without dots, whose host,
domain and suffix are one, are thus shrunk towards the other names alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, held, host_name, host_parts, tidy

#: The model is fitted on at most so many different labelled rows of each language, those of the smallest hashes, and on at most
#: so many languages, the commonest ones.
TRAINING_ROWS, MAX_LANGUAGES = 1000, 256
#: log2 of the number of trigram hashes; trigrams that a text's likelihood counts for at most, as if the rest only confirmed them.
HASH_BITS, EFFECTIVE_TRIGRAMS = 16, 60.0
DECLARED_RELIABILITY, SUFFIX_RELIABILITY, UND_PRIOR = 0.85, 0.7, 0.02
#: Rows worth of its parent's prior that a host's, domain's or suffix's counts are mixed with.
PRIOR_WEIGHT = 20.0
#: Hosts up to which their priors are broadcast (some 150 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
# Address suffixes of one main language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
UND = "und"

#: Bytes of ASCII letters in lower case and of longer UTF-8 sequences stay, all others become spaces.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)
_SLICE = 1 << 18


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trigram hashes of some texts or parts of texts, where each one's begin, and the texts' places. Blank trigrams have hash 0."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = _LETTERS[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        blank = code == 0x202020
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
        code[code == 0] = 1
        code[blank] = 0
        starts = np.cumsum([0, *map(len, parts[:-1])])
        starts[-1:] = np.minimum(starts[-1:], len(code) - 1)
        return code, starts, np.array(owners)

    for k, text in enumerate(texts):
        raw = (text or "").encode()
        for at in range(0, max(len(raw), 1), _SLICE):
            parts.append(b"  " + raw[at : at + _SLICE + 2] + b"  ")
            owners.append(k)
            size += len(parts[-1])
            if size >= _SLICE:
                yield out()
                parts, owners, size = [], [], 0
    if parts:
        yield out()


@dataclass
class Model:
    languages: list[str]
    #: log probability of each trigram hash by language, with "und" last; row 0 is of blanks and all zero.
    weights: np.ndarray

    def log_likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """By text and language, "und" last; tempered to EFFECTIVE_TRIGRAMS. All zero without any letters."""
        total, counts = np.zeros((len(texts), len(self.languages) + 1)), np.zeros(len(texts))
        for code, starts, owners in _slices(texts):
            np.add.at(counts, owners, np.add.reduceat((code != 0).astype(np.float64), starts))
            for j in range(total.shape[1]):
                np.add.at(total[:, j], owners, np.add.reduceat(self.weights[:, j][code].astype(np.float64), starts))
        return total * np.minimum(1.0, EFFECTIVE_TRIGRAMS / np.maximum(counts, 1.0))[:, None]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = TRAINING_ROWS) -> Model:
    """From labelled rows: at most ``rows`` of each language, whole texts, in order of the hash of their key and text.

    Defined results: rows without a label or a text teach nothing; equal rows count once; without labelled rows, as in an empty
    table, the model knows no language and all is "und"; other columns are ignored.
    """
    c = lambda name: F.col(f"`{name}`")
    labelled = docs.select(c(label).cast("string").alias("language"), c(text).cast("string").alias("text"), F.xxhash64(c(key), c(text)).alias("h")).where("language is not null and text is not null")
    # About twice as many hashes as are taken lie below a language's bound, however many rows or copies it has
    known = labelled.groupBy("language").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "language").limit(MAX_LANGUAGES).collect()
    bounds = F.create_map(*[F.lit(x) for r in known for x in (r.language, 2.0**64 * min(1.0, 2 * rows / max(r.d, 1)) - 2.0**63)]) if known else F.lit(None).cast("map<string,double>")
    least = labelled.select("language", "h").where(F.col("h") <= bounds[F.col("language")]).distinct().withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("h")))
    chosen = least.where(F.col("k") <= rows).select("language", "h")  # at most rows * MAX_LANGUAGES
    sample = labelled.join(F.broadcast(chosen), ["language", "h"], "left_semi").dropDuplicates(["language", "h"]).select("language", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            for code, starts, owners in _slices(b.column(1).to_pylist()):
                for at, end, k in zip(starts, [*starts[1:], len(code)], owners, strict=True):
                    n = np.bincount(code[at:end], minlength=1 << HASH_BITS)
                    found[names[k]] = found.get(names[k], 0) + n
        for name, n in found.items():
            h = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"language": pa.array([name] * len(h), pa.string()), "hash": pa.array(h, pa.int32()), "n": pa.array(n[h], pa.int64())})

    got = sample.mapInArrow(tidy(counted), "language string, hash int, n bigint").groupBy("language", "hash").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["language"].unique())
    counts = np.full((1 << HASH_BITS, len(languages) + 1), 0.25)
    for j, name in enumerate(languages):
        own = got[got["language"] == name]
        counts[own["hash"].to_numpy(), j] += own["n"].to_numpy()
    counts[0] = 0
    counts[:, -1] = 1
    weights = np.log(np.maximum(counts, 1e-9) / counts.sum(axis=0))
    weights[0] = 0
    return Model(languages, weights.astype(np.float32))


def _even(classes: int) -> list[float]:
    """A prior without any rows: UND_PRIOR for "und", the same for each language."""
    return [(1 - UND_PRIOR) / (classes - 1)] * (classes - 1) + [UND_PRIOR] if classes > 1 else [1.0]


def _smoothed(counts: Column, less: Column | None, prior: Column) -> Column:
    """The prior after the rows in ``counts`` that aren't in ``less``."""
    counts = counts if less is None else F.zip_with(counts, less, lambda a, b: a - b)
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + PRIOR_WEIGHT * p) / (n + PRIOR_WEIGHT))


def host_priors(decided: DataFrame, classes: int) -> DataFrame:
    """Of rows (host, best): a row for each host with its prior over the classes, as an array."""
    tallies = [F.sum(F.when(F.col("best") == j, 1.0).otherwise(0.0)) for j in range(classes)]
    domain, suffix = host_parts(host_name(F.col("host")))
    hosts = decided.groupBy("host").agg(F.array(*tallies).alias("counts")).withColumn("domain", domain).withColumn("suffix", suffix)
    add = lambda c: F.array(*[F.coalesce(F.sum(F.col(c)[j]), F.lit(0.0)) for j in range(classes)])
    domains = hosts.groupBy("domain", "suffix").agg(add("counts").alias("domain_counts"))
    suffixes = domains.groupBy("suffix").agg(add("domain_counts").alias("suffix_counts"))
    every = suffixes.agg(add("suffix_counts").alias("all_counts"))  # one row
    start = F.array(*map(F.lit, _even(classes)))
    suffixes = suffixes.crossJoin(F.broadcast(every)).select("suffix", "suffix_counts", _smoothed(F.col("all_counts"), F.col("suffix_counts"), start).alias("prior"))
    domains = domains.join(suffixes, "suffix").select("domain", "domain_counts", _smoothed(F.col("suffix_counts"), F.col("domain_counts"), F.col("prior")).alias("prior"))
    hosts = hosts.join(domains, "domain").select("host", "counts", _smoothed(F.col("domain_counts"), F.col("counts"), F.col("prior")).alias("prior"))
    return hosts.select("host", _smoothed(F.col("counts"), None, F.col("prior")).alias("prior"))


def identify(docs: DataFrame, model: Model, text: str = "text", host: str | None = "source", declared: str | None = "lang", suffix: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows with language, confidence and accepted, which replace columns of those names.

    ``host``, ``declared`` and ``suffix`` name the columns of these kinds of evidence; None: there is none. ``columns`` are those
    that stay, by default all; where the text isn't among them, rows are kept without it once it is scored, else each text is
    scored twice (for the priors and for the result), which costs less than to keep or shuffle it. ``accepted`` is false
    for rows that are most likely "und": no letters at all, or letters that no language explains better than chance does.
    Defined results: a null or empty text counts by its other evidence for the posterior, but is "und" and not accepted; a null
    host has the host '' of its own; nulls and unknown values elsewhere are no evidence; ties go to the first language by name;
    repeated rows stay; empty tables stay empty; a model without languages makes all "und"; other columns stay as they are.
    """
    spark, names = docs.sparkSession, [*model.languages, UND]
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        out = pd.Series(list(shared.value.log_likelihoods([t or None for t in texts])))
        give_back()
        return out

    ll, best, prior, post, key = fresh(docs.columns, "log_likelihoods", "best", "prior", "posterior", "host_key")
    col = lambda name: F.col(f"`{name}`")
    lettered = F.exists(ll, lambda x: x != 0.0)
    top = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    host_col = F.coalesce(col(host).cast("string"), F.lit("")) if host else F.lit("")
    scored = docs.withColumn(ll, likelihoods(col(text).cast("string"))).withColumn(key, host_col)
    columns = docs.columns if columns is None else columns
    if text not in columns:
        used = dict.fromkeys([*columns, *(c for c in (declared, suffix) if c)])
        scored = cut(scored.select(*map(col, used), ll, key))
    decided = scored.select(F.col(key).alias("host"), F.when(lettered, top(F.col(ll))).alias("best")).where("best is not null")
    priors = host_priors(decided, len(names)).select(F.col("host").alias(key), F.col("prior").alias(prior))
    priors = held(priors, BROADCAST_HOSTS)

    def told(value: Column, reliability: float) -> Column:
        """Log odds of each class, given one that is told: its own share is the reliability, the others' is even."""
        even = (1 - reliability) / max(len(names) - 2, 1)
        return F.when(value.isin(model.languages), F.array(*[F.log(F.when(value == n, reliability).otherwise(even)) for n in names])).otherwise(F.array(*[F.lit(0.0)] * len(names)))

    terms = [F.col(ll), F.transform(F.coalesce(prior, F.array(*map(F.lit, _even(len(names))))), lambda p: F.log(p))]
    if declared:
        terms.append(told(F.substring(F.lower(F.trim(col(declared).cast("string"))), 1, 2), DECLARED_RELIABILITY))
    if suffix:
        table = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair])
        terms.append(told(F.coalesce(table[F.lower(col(suffix).cast("string"))], F.lit("")), SUFFIX_RELIABILITY))
    total = terms[0]
    for t in terms[1:]:
        total = F.zip_with(total, t, lambda a, b: a + b)
    out = scored.join(priors, key, "left").withColumn(post, total)
    peak = F.array_max(post)
    out = out.withColumn(best, F.when(lettered, F.element_at(F.array(*map(F.lit, names)), top(F.col(post)) + 1)).otherwise(UND))
    confidence = F.when(lettered, 1.0 / F.aggregate(F.transform(post, lambda x: F.exp(x - peak)), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))
    kept = [c for c in columns if c not in ("language", "confidence", "accepted")]
    return out.select(*map(col, kept), F.col(best).alias("language"), confidence.alias("confidence"), (F.col(best) != UND).alias("accepted"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that ``identify`` accepts, with the columns that they had."""
    return identify(docs, model).where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages with a text (markup taken away), the markup's declared language, the host and the address suffix."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", bare.alias("text"), F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1), F.lit("")).alias("lang"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))
