"""Features and rules that people declare in files of JSON or YAML."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs

try:  # without it, files of YAML are reported as problems
    import yaml
except ImportError:
    yaml = None

FEATURE = "feature string, name string, display_name string, description string, tags array<string>, components array<string>, services array<string>, routes array<string>, models array<string>, tests array<string>"
ENTRY = "file string, body string, problem string"
#: Where a tree's rules are looked for, in order.
PLACES = ("loom/rules.yaml", "loom/rules.json")
# The rule where none is declared.
DEFAULT_RULES = ({"name": "ui-cannot-import-database", "from": "src/components/**", "cannot_import": "prisma/**"},)


def snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", key).lower()


def parsed(text: str, path: str):
    """What a file holds, by its suffix; raises ValueError where it can't be read."""
    if path.lower().endswith(".json"):
        return json.loads(text)
    if yaml is None:
        raise ValueError("no reader for YAML")
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"]):
            file = path.rsplit("/", 1)[-1]
            try:
                document = parsed(bytes(content).decode("utf-8"), path)
                if document is None:
                    continue
                if not isinstance(document, dict):
                    raise ValueError("not a mapping")
                out.append((file, json.dumps({snake(str(k)): v for k, v in document.items()}, default=str), None))
            except ValueError as e:
                out.append((file, None, " ".join(str(e).split())))
        yield pd.DataFrame(out, columns=["file", "body", "problem"])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(file, body, problem) of a folder's files of JSON or YAML, not of those below: the mapping that each holds as JSON with keys in snake case, or why it can't be read. Files that hold nothing give no row; empty without such a folder."""
    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,yaml,yml,JSON,YAML,YML}").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)
    return rows.select("path", "content").mapInPandas(_bodies, ENTRY)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Declared features of a folder as nodes with full confidence; files without a feature key or with a ``problem`` are left out."""
    rows = entries(spark, folder).where("problem is null").select(F.from_json("body", FEATURE).alias("d")).select("d.*").where("feature != ''")
    shown = F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("name", F.lit("")), "feature")
    return rows.select(exprs.feature_urn(F.col("feature")).alias("urn"), F.lit("feature").alias("kind"), F.col("feature").alias("name"), F.lit("").alias("path"), F.lit("active").alias("status"), shown.alias("display_name"), "description", F.lit("EXPLICIT").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem) of the files of a folder that declare nothing because they can't be read."""
    return entries(spark, folder).where("problem is not null").select("file", "problem")


def rules(spark: SparkSession, root: str, custom: str | None = None, places: tuple[str, ...] = PLACES) -> list[dict]:
    """The rules of the first file that can be read: ``custom``, then ``places`` below root; DEFAULT_RULES if there is none.

    A file holds a list of rules or a mapping with one under ``rules``; a mapping without it has no rules. Keys may be written in
    camel or snake case. A file that can't be read is named in a warning, and the next one is tried; so is an entry that is no
    mapping or has no name, which is left out. Rules are settings that the driver needs as such, like those of ``settings``.
    """
    log = logging.getLogger(__name__)
    base = root.rstrip("/")
    for path in [*([custom] if custom else []), *(f"{base}/{p}" for p in places)]:
        try:
            rows = spark.read.text(path, wholetext=True).take(1)
        except AnalysisException:  # no such file
            continue
        try:
            document = parsed(rows[0].value if rows else "", path)
        except ValueError as e:
            log.warning("no rules in %s: %s", path, " ".join(str(e).split()))
            continue
        if document is None:
            log.warning("no rules in %s: it is empty", path)
            continue
        found = document.get("rules") if isinstance(document, dict) else document
        found = found if isinstance(found, list) else []
        kept = [{snake(str(k)): v for k, v in r.items()} for r in found if isinstance(r, dict) and r.get("name")]
        if len(kept) < len(found):
            log.warning("%d entries of %s are no rules", len(found) - len(kept), path)
        return kept
    return [dict(r) for r in DEFAULT_RULES]
