"""What Git tells of a working tree: its state, what changed since a commit, and commits by file."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.views import feature_view

STATUS = "change string, path string, from_path string"
#: One commit: a line of fields, then its files, a line each.
LOG_FORMAT = "%x00%h|%ad|%an|%s"


def _git(root: str, *args: str) -> str | None:
    """The command's output; None where it fails, as outside of a working tree."""
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def parsed_status(text: str) -> list[tuple[str, str, str | None]]:
    """(change, path, from_path) of ``git status --porcelain -z``: a renamed or copied entry is followed by the path that it had."""
    entries, out = iter(text.split("\0")), []
    for entry in entries:
        code, path = entry[:2], entry[3:]
        if not path:
            continue
        if "R" in code or "C" in code:
            out.append(("renamed", path, next(entries, "")))
        else:
            change = "added" if "A" in code or code == "??" else "deleted" if "D" in code else "modified"
            out.append((change, path, None))
    return out


def status(spark: SparkSession, root: str) -> DataFrame:
    """(change, path, from_path) of files that differ from the last commit; no rows outside of a working tree."""
    return spark.createDataFrame(parsed_status(_git(root, "status", "--porcelain", "-z") or ""), STATUS)


def commit(root: str) -> str:
    """The short name of the last commit; "non-git" outside of a working tree, "uncommitted" before the first one."""
    if _git(root, "rev-parse", "--git-dir") is None:
        return "non-git"
    return (_git(root, "rev-parse", "--short", "HEAD") or "uncommitted").strip()


def changed(spark: SparkSession, root: str, ref: str | None = None) -> DataFrame:
    """(path) of files that changed since a commit, or that ``status`` names."""
    if ref is None:
        return status(spark, root).select("path").distinct()
    names = (_git(root, "diff", "--name-only", "-z", ref, "--") or "").split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


def commits(log: DataFrame) -> DataFrame:
    """(commit, date, author, message, path) from log (value), a commit with its files a row: fields apart by "|", then its files by line."""
    lines = F.split("value", "\n")
    part = F.split(F.get(lines, F.lit(0)), r"\|", 4)
    fields = [F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("commit", "date", "author", "message"))]
    return log.where("value != ''").select(*fields, F.explode(F.filter(F.slice(lines, 2, 1 << 30), lambda x: x != "")).alias("path"))


def log(spark: SparkSession, root: str) -> DataFrame:
    """``commits`` of a working tree."""
    text = _git(root, "log", f"--pretty=format:{LOG_FORMAT}", "--date=short", "--name-only") or ""
    return commits(spark.createDataFrame([(x,) for x in text.split("\0") if x], "value string"))


def feature_history(graph: Graph, changes: DataFrame, most: int = 10) -> DataFrame:
    """(feature, place, commit, date, author, message): the last commits that touched a file of each feature; changes as from ``commits``."""
    files = feature_view(graph).where("role != 'consumers'").join(graph.active().select("urn", "path"), "urn").where("path != ''").select("feature", "path").distinct()
    touched = files.join(changes, "path").select("feature", "commit", "date", "author", "message").distinct()
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("date"), "commit"))
    return touched.withColumn("place", place).where(F.col("place") <= most)
