"""A graph in a folder: nodes, edges and aliases as Parquet, in buckets by urn.

A version is a manifest that says, for each table and bucket, in which version's files the bucket lies. Saving compares each
bucket's digest with the last manifest's and writes the buckets alone that changed; a row in ``current`` then names the version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph as ops
from ..operators.graph import Graph

SCHEMA_VERSION = 2
#: Buckets of a table, and the column that says in which one a row lies.
BUCKETS = 64
KEYS = {"nodes": "urn", "edges": "source_urn", "aliases": "old_urn"}
#: What a store writes below its folder, and all that ``clean`` deletes.
OWN = ("tables", "manifests", "current")
#: Errors of Spark's that say that nothing is there.
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class StoreError(Exception):
    """The store is missing, or of another schema version."""


def _parts(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def save(g: Graph, folder: str) -> str:
    """Writes a new version; readers see it once its row in ``current`` is there. Earlier versions stay readable."""
    spark, version = g.nodes.sparkSession, uuid.uuid4().hex
    before = _manifest(spark, folder, _last(spark, folder)["version"]) if initialised(spark, folder) else None
    manifest, schemas = None, {}
    for table, key in KEYS.items():
        df = getattr(g, table)
        if df is None:
            continue
        schemas[table] = df.schema.json()
        rows = _parts(df, key)
        # Sums don't depend on the order of rows
        row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        digests = rows.groupBy("_bucket").agg(F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"), F.count("*").alias("rows")).select(F.lit(table).alias("table"), "_bucket", "digest", "rows")
        if before is None:
            found = digests.withColumn("version", F.lit(version))
        else:
            same = before.select("table", "_bucket", "digest", "rows", F.col("version").alias("_was"))
            found = digests.join(F.broadcast(same), ["table", "_bucket", "digest", "rows"], "left").withColumn("version", F.coalesce("_was", F.lit(version))).drop("_was")
        found = spark.createDataFrame(found.collect(), found.schema)  # at most BUCKETS rows
        changed = [r["_bucket"] for r in found.where(F.col("version") == version).collect()]
        if changed:
            rows.where(F.col("_bucket").isin(changed)).repartition(len(changed), "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/tables/{table}/{version}")
        manifest = found if manifest is None else manifest.union(found)
    manifest.coalesce(1).write.parquet(f"{folder}/manifests/{version}")
    said = F.create_map(*[F.lit(x) for kv in schemas.items() for x in kv])
    stats = ops.stats(Graph(*(_read(spark, folder, version, t, schemas[t]) for t in ("nodes", "edges"))))
    row = stats.select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("saved_at"), F.struct(*stats.columns).alias("stats"), said.alias("schemas"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return version


def _manifest(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifests/{version}")


def _read(spark: SparkSession, folder: str, version: str, table: str, schema: str) -> DataFrame:
    """A table of a version, from the files of all versions that hold a bucket of it."""
    kind = StructType.fromJson(json.loads(schema))
    at = [(r["version"], r["_bucket"]) for r in _manifest(spark, folder, version).where(F.col("table") == table).collect()]
    if not at:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{folder}/tables/{table}/{v}/_bucket={b}" for v, b in sorted(at)])


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(version, schema_version, saved_at, stats and more) of all versions."""
    try:
        return spark.read.parquet(f"{folder}/current")
    except AnalysisException as e:
        if e.getCondition() not in MISSING:
            raise
        raise StoreError(f"no graph in {folder}") from e


def initialised(spark: SparkSession, folder: str) -> bool:
    """Whether a graph of this schema version has been saved there."""
    try:
        return _last(spark, folder) is not None
    except StoreError:
        return False


def _last(spark: SparkSession, folder: str):
    last = metadata(spark, folder).orderBy(F.desc("saved_at")).first()
    if last is None or last["schema_version"] != SCHEMA_VERSION:
        raise StoreError(f"schema version {last and last['schema_version']}, not {SCHEMA_VERSION}: the graph has to be built again")
    return last


def load(spark: SparkSession, folder: str, version: str | None = None) -> Graph:
    """The last version, or the one named."""
    last = _last(spark, folder) if version is None else metadata(spark, folder).where(F.col("version") == version).first()
    if last is None:
        raise StoreError(f"no version {version} in {folder}")
    return Graph(*(_read(spark, folder, last["version"], t, last["schemas"][t]) if t in last["schemas"] else None for t in KEYS))


def clean(spark: SparkSession, folder: str) -> None:
    """Deletes what ``save`` wrote and nothing else; without a store nothing happens."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in OWN:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)
    spark.catalog.refreshByPath(folder)


def export_json(g: Graph) -> DataFrame:
    """(table, json) of every active node and every edge between such."""
    active = g.active()
    ends = active.select("urn")
    edges = g.edges.join(ends.withColumnRenamed("urn", "source_urn"), "source_urn", "left_semi").join(ends.withColumnRenamed("urn", "target_urn"), "target_urn", "left_semi")
    return active.select(F.lit("node").alias("table"), F.to_json(F.struct(*active.columns)).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct(*edges.columns))))
