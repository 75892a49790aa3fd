"""The given tables as a graph: parts, orders, customers, suppliers and part types, with their references as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a task where edges are made distinct, joined or sorted.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """So many that a task's share of the line items doesn't grow with them; Spark doesn't merge what is dealt by number."""
    return max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // TASK_ROWS)


def _urn(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    cols = lambda urn, kind, name, path, start=F.lit(0), end=F.lit(0): (urn.alias("urn"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), F.lit("active").alias("status"), start.alias("start_line"), end.alias("end_line"))
    nation = t("nation")
    features = t("part").select(F.lower("p_type").alias("k"), "p_type").distinct()
    out = features.select(*cols(_urn("feature", "k"), "feature", F.col("p_type"), F.lit("")))
    out = out.union(t("part").select(*cols(_urn("part", "p_partkey"), "symbol", F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_size") + 4)))
    out = out.union(t("orders").select(*cols(_urn("order", "o_orderkey"), "symbol", _urn("order", "o_orderkey"), F.col("o_orderpriority"))))
    out = out.union(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*cols(_urn("customer", "c_custkey"), "symbol", F.col("c_name"), F.col("n_name"))))
    return out.union(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*cols(_urn("supplier", "s_suppkey"), "route", F.col("s_name"), F.col("n_name"))))


def edges(spark: SparkSession, sf_dir: str, shipped: str | None = None, tasks: int | None = None) -> DataFrame:
    """``shipped``: a condition on line items, of which the others make no edges. ``tasks``: into how many line items are dealt."""
    t = lambda name: table(spark, sf_dir, name)
    once = lambda df: (df.repartition(tasks, *df.columns) if tasks else df).distinct()
    lines = t("lineitem").where(shipped) if shipped else t("lineitem")
    edge = lambda df, s, d, kind: df.select(s.alias("source_urn"), d.alias("target_urn"), F.lit(kind).alias("relationship"))
    member = t("part").select("p_partkey", F.lower("p_type").alias("k"))
    out = edge(member, _urn("part", "p_partkey"), _urn("feature", "k"), "implements")
    out = out.union(edge(once(lines.select("l_orderkey", "l_partkey")), _urn("order", "l_orderkey"), _urn("part", "l_partkey"), "calls"))
    out = out.union(edge(t("orders"), _urn("customer", "o_custkey"), _urn("order", "o_orderkey"), "calls"))
    return out.union(edge(once(lines.select("l_suppkey", "l_partkey")), _urn("supplier", "l_suppkey"), _urn("part", "l_partkey"), "exposes"))


def graph(spark: SparkSession, sf_dir: str, shipped: str | None = None) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, shipped))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that follow one another for some user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source_urn"), F.lead("event_type").over(w).alias("target_urn")).where("target_urn is not null and source_urn != target_urn").distinct()


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one type and size, each with the next one; those of even sizes close to a ring."""
    w = Window.partitionBy("p_type", "p_size").orderBy("p_partkey")
    whole = Window.partitionBy("p_type", "p_size")
    after = F.coalesce(F.lead("p_partkey").over(w), F.when(F.col("p_size") % 2 == 0, F.min("p_partkey").over(whole)))
    rows = table(spark, sf_dir, "part").select("p_partkey", after.alias("after")).where("after is not null and after != p_partkey")
    return rows.select(_urn("part", "p_partkey").alias("source_urn"), _urn("part", "after").alias("target_urn"))


# A second graph, whose parts are functions in files of a size, orders jobs in a file for each customer, suppliers routes and nations models


def _part_path() -> Column:
    return F.concat(F.lit("src/"), F.translate("p_brand", "#", "/"), F.lit("/"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 10 == 0, ".tsx").otherwise(".ts"))


def _job_path(key: str) -> Column:
    return F.concat(F.lit("jobs/"), F.col(key).cast("string"), F.lit(".ts"))


def _job_start() -> Column:
    return ((F.col("o_orderkey") % 40) * 20 + 1).cast("int")


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    none, no = F.lit(None).cast("string"), F.lit(0)

    def cols(urn, kind, name, path, symbol_kind=none, start=no, end=no, status=F.lit("active")):
        pairs = {"urn": urn, "kind": F.lit(kind), "name": name, "path": path, "status": status, "symbol_kind": symbol_kind, "start_line": start.cast("int"), "end_line": end.cast("int")}
        return [c.alias(k) for k, c in pairs.items()]

    part, orders = t("part"), t("orders")
    k = F.col("p_partkey")
    out = part.select(F.lower("p_type").alias("k")).distinct().select(*cols(_urn("feature", "k"), "feature", F.col("k"), F.lit("")))
    begin = (k % 50) * 10 + 1
    kinds = F.get(F.array(*map(F.lit, ("class", "function", "constant", "method"))), (k % 4).cast("int"))
    out = out.union(part.select(*cols(_urn("part", "p_partkey"), "symbol", F.col("p_name"), _part_path(), kinds, begin, begin + 6, F.when(k % 37 == 0, "retired").otherwise("active"))))
    out = out.union(orders.select(*cols(_urn("order", "o_orderkey"), "symbol", _urn("order", "o_orderkey"), _job_path("o_custkey"), F.lit("function"), _job_start(), _job_start() + 15)))
    files = orders.select(_job_path("o_custkey").alias("path")).union(part.select(_part_path())).distinct()
    out = out.union(files.select(*cols(_urn("file", "path"), "file", F.col("path"), F.col("path"))))
    tested = t("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").select("c_custkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part"))
    first = F.when(F.col("part") == "a", 1).otherwise(401)
    out = out.union(tested.select(*cols(F.concat(_urn("test", "c_custkey"), F.lit(":"), "part"), "test", F.col("part"), _job_path("c_custkey"), none, first, first + 399)))
    checked = part.where("p_size % 7 = 0").select(_part_path().alias("path")).distinct()
    out = out.union(checked.select(*cols(_urn("test", "path"), "test", F.col("path"), F.col("path"), none, F.lit(1), F.lit(250))))
    out = out.union(t("supplier").select(*cols(_urn("supplier", "s_suppkey"), "route", F.col("s_name"), _job_path("s_suppkey"))))
    return out.union(t("nation").select(*cols(_urn("model", "n_nationkey"), "model", F.col("n_name"), F.concat(F.lit("schema/"), "n_name"))))


def code_edges(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``tasks``: into how many line items are dealt."""
    t = lambda name: table(spark, sf_dir, name)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    none = F.lit(None)

    def edge(df, source, target, kind, line=none, confidence=F.lit("DETECTED"), score=F.lit(0.9)):
        return df.select(source.alias("source_urn"), target.alias("target_urn"), F.lit(kind).alias("relationship"), none.cast("string").alias("file"), line.cast("int").alias("line"), confidence.alias("confidence"), score.alias("confidence_score"))

    part, k = t("part").withColumn("k", F.lower("p_type")).withColumn("path", _part_path()), F.col("p_partkey")
    feature, own = _urn("feature", "k"), _urn("part", "p_partkey")
    sure = F.when(k % 5 == 0, "EXPLICIT").when(k % 5 <= 2, "DETECTED").otherwise("INFERRED")
    out = edge(part, own, feature, "implements", none, sure, 1 - (k % 5) / 10.0)
    w = Window.partitionBy("k").orderBy("p_partkey")
    following = part.withColumn("after", F.lead("p_partkey").over(w)).withColumn("next_k", F.lead("k").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")))
    out = out.union(edge(following.where("p_size % 2 = 0 and after is not null"), own, _urn("part", "after"), "calls", (k % 50) * 10 + 3))
    out = out.union(edge(following.where("next_k is not null and next_k != k and p_size = 3").select("k", "next_k").distinct(), feature, _urn("feature", "next_k"), "consumes"))
    lines = dealt(t("lineitem"), "l_orderkey").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    caller = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("file:"), _job_path("o_custkey"))).otherwise(_urn("order", "o_orderkey"))
    line = F.when(F.col("o_orderpriority") != "1-URGENT", _job_start() + F.col("l_linenumber"))
    out = out.union(edge(lines, caller, _urn("part", "l_partkey"), "calls", line))
    supplied = dealt(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    out = out.union(edge(supplied, _urn("supplier", "l_suppkey"), _urn("part", "l_partkey"), "exposes"))
    small = t("lineitem").select("l_suppkey", "l_partkey").join(part.where("p_size = 2"), F.col("l_partkey") == k).select("l_suppkey", "k").distinct()
    out = out.union(edge(small, _urn("supplier", "l_suppkey"), feature, "belongs_to"))
    out = out.union(edge(part.where("p_size % 7 = 0").select("path", "k").distinct(), _urn("test", "path"), feature, "belongs_to"))
    out = out.union(edge(part.where("p_size = 1").select((k % 25).alias("n"), "k").distinct(), _urn("model", "n"), feature, "belongs_to"))
    out = out.union(edge(part.where("p_size % 11 = 0").select("path", "k").distinct(), _urn("file", "path"), feature, "belongs_to", none, F.lit("INFERRED"), F.lit(0.6)))
    tested = t("orders").where("o_orderkey % 10 = 0").join(t("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')"), F.col("o_custkey") == F.col("c_custkey"))
    return out.union(edge(tested, F.concat(_urn("test", "c_custkey"), F.lit(":a")), _urn("order", "o_orderkey"), "tests"))


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """With aliases: every part whose key ends in 5 was once called old:<key>."""
    old = table(spark, sf_dir, "part").where("p_partkey % 10 = 5").select(_urn("old", "p_partkey").alias("old_urn"), _urn("part", "p_partkey").alias("urn"))
    return Graph(code_nodes(spark, sf_dir), code_edges(spark, sf_dir), old)


#: The same for SQL.
CODE_SQL = """
with recursive pt as (select *, lower(p_type) k, 'src/' || replace(p_brand, '#', '/') || '/' || p_size || case when p_size % 10 = 0 then '.tsx' else '.ts' end as path from part),
od as (select *, 'jobs/' || o_custkey || '.ts' as path, (o_orderkey % 40) * 20 + 1 first_line from orders),
cu as (select *, 'jobs/' || c_custkey || '.ts' as path from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')),
nodes as (
  select distinct 'feature:' || k urn, 'feature' kind, k as name, '' as path, 'active' status, null symbol_kind, 0::bigint start_line, 0::bigint end_line from pt
  union all select 'part:' || p_partkey, 'symbol', p_name, path, case when p_partkey % 37 = 0 then 'retired' else 'active' end, ['class', 'function', 'constant', 'method'][p_partkey % 4 + 1], (p_partkey % 50) * 10 + 1, (p_partkey % 50) * 10 + 7 from pt
  union all select 'order:' || o_orderkey, 'symbol', 'order:' || o_orderkey, path, 'active', 'function', first_line, first_line + 15 from od
  union all select 'file:' || path, 'file', path, path, 'active', null, 0, 0 from (select path from od union select path from pt)
  union all select 'test:' || c_custkey || ':' || x, 'test', x, path, 'active', null, case x when 'a' then 1 else 401 end, case x when 'a' then 400 else 800 end from cu, (values ('a'), ('b')) v(x)
  union all select distinct 'test:' || path, 'test', path, path, 'active', null, 1, 250 from pt where p_size % 7 = 0
  union all select 'supplier:' || s_suppkey, 'route', s_name, 'jobs/' || s_suppkey || '.ts', 'active', null, 0, 0 from supplier
  union all select 'model:' || n_nationkey, 'model', n_name, 'schema/' || n_name, 'active', null, 0, 0 from nation
), fw as (select *, lead(p_partkey) over (partition by k order by p_partkey) after, lead(k) over (partition by p_brand, p_size order by p_partkey) next_k from pt),
li as (select * from lineitem join od on l_orderkey = o_orderkey),
edges as (
  select 'part:' || p_partkey source_urn, 'feature:' || k target_urn, 'implements' relationship, null::bigint line, case when p_partkey % 5 = 0 then 'EXPLICIT' when p_partkey % 5 <= 2 then 'DETECTED' else 'INFERRED' end confidence, 1 - (p_partkey % 5) / 10.0::double confidence_score from pt
  union all select 'part:' || p_partkey, 'part:' || after, 'calls', (p_partkey % 50) * 10 + 3, 'DETECTED', 0.9 from fw where p_size % 2 = 0 and after is not null
  union all select distinct 'feature:' || k, 'feature:' || next_k, 'consumes', null::bigint, 'DETECTED', 0.9 from fw where next_k <> k and p_size = 3
  union all select case when l_returnflag = 'R' then 'file:' || path else 'order:' || o_orderkey end, 'part:' || l_partkey, 'calls', case when o_orderpriority <> '1-URGENT' then first_line + l_linenumber end, 'DETECTED', 0.9 from li
  union all select distinct 'supplier:' || l_suppkey, 'part:' || l_partkey, 'exposes', null::bigint, 'DETECTED', 0.9 from lineitem
  union all select distinct 'supplier:' || l_suppkey, 'feature:' || k, 'belongs_to', null::bigint, 'DETECTED', 0.9 from lineitem join pt on l_partkey = p_partkey where p_size = 2
  union all select distinct 'test:' || path, 'feature:' || k, 'belongs_to', null::bigint, 'DETECTED', 0.9 from pt where p_size % 7 = 0
  union all select distinct 'model:' || (p_partkey % 25), 'feature:' || k, 'belongs_to', null::bigint, 'DETECTED', 0.9 from pt where p_size = 1
  union all select distinct 'file:' || path, 'feature:' || k, 'belongs_to', null::bigint, 'INFERRED', 0.6 from pt where p_size % 11 = 0
  union all select 'test:' || c_custkey || ':a', 'order:' || o_orderkey, 'tests', null::bigint, 'DETECTED', 0.9 from od join cu on o_custkey = c_custkey where o_orderkey % 10 = 0
), act as (select * from nodes where status <> 'retired'),
member as (select distinct target_urn feature, source_urn urn from edges where relationship in ('implements', 'belongs_to'))"""


#: The same nodes and edges for SQL.
SQL = """
with nodes as (
  select distinct 'feature:' || lower(p_type) urn, 'feature' kind, p_type as name, '' as path, 0 start_line, 0 end_line from part
  union all select 'part:' || p_partkey, 'symbol', p_name, p_brand, p_size, p_size + 4 from part
  union all select 'order:' || o_orderkey, 'symbol', 'order:' || o_orderkey, o_orderpriority, 0, 0 from orders
  union all select 'customer:' || c_custkey, 'symbol', c_name, n_name, 0, 0 from customer join nation on c_nationkey = n_nationkey
  union all select 'supplier:' || s_suppkey, 'route', s_name, n_name, 0, 0 from supplier join nation on s_nationkey = n_nationkey
), lines as (select * from lineitem where {shipped}),
edges as (
  select 'part:' || p_partkey source_urn, 'feature:' || lower(p_type) target_urn, 'implements' relationship from part
  union all select distinct 'order:' || l_orderkey, 'part:' || l_partkey, 'calls' from lines
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls' from orders
  union all select distinct 'supplier:' || l_suppkey, 'part:' || l_partkey, 'exposes' from lines
)"""


def sql(body: str, shipped: str = "true", recursive: bool = False) -> str:
    text = SQL.replace("{shipped}", shipped) + body
    return text.replace("with nodes", "with recursive nodes", 1) if recursive else text


EVENT_SQL = """
with recursive follow as (select event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events),
step as (select distinct s, t from follow where t is not null and s <> t)"""
RING_SQL = """
with groups as (select *, min('part:' || p_partkey) over (partition by p_type, p_size) least_, count(*) over (partition by p_type, p_size) n from part)"""


def code_sql(body: str) -> str:
    return CODE_SQL + body
