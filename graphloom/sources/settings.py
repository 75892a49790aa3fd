"""Settings of a source tree, from a JSON file at one of two places."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .tree import IGNORED_DIRS, SECRETS

PLACES = ("loom.config.json", "loom/config.json")
DEFAULTS = {
    "ignored_dirs": list(IGNORED_DIRS),
    "ignored_names": list(SECRETS),
    "max_bytes": 2 << 20,
    "token_budget": 4000,
    "confidence": {"explicit": 1.0, "detected": 0.85, "inferred": 0.5, "unknown": 0.1},
}


def load(spark: SparkSession, root: str) -> dict:
    """The first of PLACES below root that holds a JSON object, over the defaults; ``confidence`` is merged key by key.

    Spark's reader takes any storage. A file that isn't a JSON object is named in a warning and passed over.
    """
    for place in PLACES:
        path = f"{root.rstrip('/')}/{place}"
        try:
            rows = spark.read.text(path, wholetext=True).take(1)
        except AnalysisException:  # no such file
            continue
        try:
            own = json.loads(rows[0].value) if rows else None
            return DEFAULTS | own | {"confidence": DEFAULTS["confidence"] | (own.get("confidence") or {})}
        except (ValueError, TypeError, AttributeError):
            logging.getLogger(__name__).warning("no settings in %s", path)
    return DEFAULTS | {"confidence": dict(DEFAULTS["confidence"])}
