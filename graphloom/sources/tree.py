"""Source trees and the usage ledger as DataFrames."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..schema import USAGE

IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules", "dist", "build", "target", "coverage", "__pycache__", ".venv", "vendor")
SECRETS = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519", "credentials.json")


def ignored(path: Column, dirs: tuple[str, ...] = IGNORED_DIRS, names: tuple[str, ...] = SECRETS) -> Column:
    """Whether a path lies in an ignored folder or its file name fits a pattern."""
    folder = "(^|/)(" + "|".join(map(re.escape, dirs)) + ")/"
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    # Python writes the end of a pattern in a way that Java doesn't know
    return reduce(lambda a, p: a | name.rlike("^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$") + "$"), names, path.rlike(folder))


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path below root, text, hash, bytes) of every file that isn't ignored; Spark's own listing passes over names with a leading dot or underscore, and over empty files.

    Bytes that are no UTF-8 are replaced; files that can't be read are passed over. The filter stands before contents are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    below = F.element_at(F.split("path", re.escape(base) + "/"), -1)
    rows = reader.load(base).withColumn("path", exprs.normal_path(below)).where(~ignored(F.col("path")))
    return rows.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"))


def append_usage(records: DataFrame, path: str) -> None:
    """Adds records of the ledger; columns that they lack are null."""
    schema = records.sparkSession.createDataFrame([], USAGE).schema
    columns = [F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    records.select(*columns).write.mode("append").json(path)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; lines that can't be read are left out."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def reset_usage(spark: SparkSession, path: str) -> None:
    """The ledger begins anew, empty."""
    spark.createDataFrame([], USAGE).write.mode("overwrite").json(path)


def usage_totals(ledger: DataFrame, session: str | None = None, day: str | None = None) -> DataFrame:
    """(day, command, n, tokens, sessions): totals by day and by command, and over all, with null in what isn't grouped; of one session or day (yyyy-MM-dd), if given."""
    rows = ledger.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "command", "tokens_generated", "session_id")
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    if day is not None:
        rows = rows.where(F.col("day") == day)
    totals = F.count("*").alias("n"), F.sum("tokens_generated").alias("tokens"), F.count_distinct("session_id").alias("sessions")
    return rows.groupingSets([[], ["day"], ["command"]], "day", "command").agg(*totals)
