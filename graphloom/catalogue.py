"""Every query over the given tables by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exprs
from .operators import brief, budget, classify, context, extract, graph, impact, incremental, resolve, review, rules, traverse, views
from .operators.graph import Graph
from .operators.search import search
from .plans import driver_graph as dg
from .plans import source_tree
from .sources import tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Graph lookups, degrees, hygiene


@query(dg.sql("""
select (select count(*) from nodes) nodes, (select count(*) from nodes where kind = 'feature') features, (select count(*) from nodes where kind = 'symbol') symbols,
  (select count(*) from nodes where kind = 'route') routes, 0::bigint tests, (select count(distinct path) from nodes where path <> '') paths, (select count(*) from edges) edges"""))
def graph_stats(spark, d):
    return graph.stats(dg.graph(spark, d))


@query(dg.sql("""
select kind, path, count(*) n from nodes group by all"""))
def active_by_kind(spark, d):
    return dg.graph(spark, d).active().groupBy("kind", "path").agg(F.count("*").alias("n"))


@query(dg.sql(""", alias as (select 'part:' || p_partkey old_urn, 'part:' || (p_partkey - 1) urn from part where p_partkey % 10 = 0)
select coalesce(a.urn, source_urn) source_urn, coalesce(b.urn, target_urn) target_urn, relationship, count(*) n
from edges left join alias a on source_urn = a.old_urn left join alias b on target_urn = b.old_urn group by all"""))
def edge_endpoints_resolved(spark, d):
    part = dg.table(spark, d, "part").where("p_partkey % 10 = 0")
    aliases = part.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("old_urn"), F.concat(F.lit("part:"), F.col("p_partkey") - 1).alias("urn"))
    n = dg.tasks(spark, d)
    g = Graph(dg.nodes(spark, d), dg.edges(spark, d, tasks=n), aliases)
    return g.resolved_edges(n).repartition(n, "source_urn", "target_urn").groupBy("source_urn", "target_urn", "relationship").agg(F.count("*").alias("n"))


@query(dg.sql("""
select target_urn urn, count(*) n_in from edges group by 1 order by n_in desc, urn limit 20"""))
def in_degree_top20(spark, d):
    return graph.degrees(dg.edges(spark, d)).where("n_in > 0").select("urn", "n_in").orderBy(F.desc("n_in"), "urn").limit(20)


#: What every root in ``roots`` reaches, as ``impact.impact`` gives it.
IMPACT = """, e as (select edges.*, a.path site_path from edges join act a on a.urn = source_urn),
roots as (select urn root from act where kind in ('symbol', 'file', 'model')),
r(root, urn, depth) as (select root, root, 0 from roots union select root, e.source_urn, depth + 1 from r join e on e.target_urn = r.urn),
reach as (select root, urn, min(depth) depth from r group by 1, 2),
own as (select root, case when kind in ('feature', 'route', 'test') then kind when depth = 1 then 'direct' else 'indirect' end category, a.urn, kind, path, start_line from reach join act a on a.urn = reach.urn where depth > 0),
other as (select distinct root, category, path from own where kind <> 'file' and path <> ''),
around as (select root, urn, kind, path, start_line from roots join nodes on urn = root union all select root, urn, kind, path, start_line from own where category in ('direct', 'indirect')),
paths as (select distinct root, path from around where path <> ''),
sites as (select distinct root, site_path as path, line spot from reach join e on e.target_urn = reach.urn where line > 0 and site_path <> ''),
starts as (select distinct root, path, start_line spot from around where kind = 'symbol' and path <> '' and start_line > 0),
near as (select root, n.urn, n.path, n.start_line, n.end_line, s.path is not null has_site, t.path is not null has_start from paths p join act n using (path) left join (select distinct root, path from sites) s using (root, path) left join (select distinct root, path from starts) t using (root, path) where n.kind = 'test'),
imp as (select root, category, urn from own left join other using (root, category, path) where kind <> 'file' or other.path is null
  union select root, 'feature', m.feature from around a join member m on m.urn = a.urn join act f on f.urn = m.feature where f.kind = 'feature'
  union select root, 'route', n.urn from paths join act n using (path) where n.kind = 'route'
  union select n.root, 'test', n.urn from near n join sites s on s.root = n.root and s.path = n.path and spot between start_line and end_line where has_site
  union select n.root, 'test', n.urn from near n join starts s on s.root = n.root and s.path = n.path and spot between start_line and end_line where not has_site and has_start
  union select root, 'test', urn from near where not has_site and not has_start),
c as (select root, count(*) filter (category = 'direct') direct, count(*) filter (category = 'indirect') indirect, count(*) filter (category = 'feature') features, count(*) filter (category = 'route') routes, count(*) filter (category = 'test') tests from roots left join imp using (root) group by 1)"""
HOT = IMPACT + """, i as (select target_urn urn, count(*) n_in from edges group by 1), o as (select source_urn urn, count(*) n_out from edges group by 1),
f as (select x.urn, count(distinct feature) features from (select source_urn urn, target_urn feature from edges union select target_urn, source_urn from edges) x join nodes n on n.urn = feature where n.kind = 'feature' group by 1),
hot as (select root urn, coalesce(n_in, 0) n_in, coalesce(n_out, 0) n_out, coalesce(f.features, 0) features, direct consumers, routes apis, tests, 2 * coalesce(n_in, 0) + coalesce(n_out, 0) + 3 * coalesce(f.features, 0) + 2 * direct + 2 * routes score
  from c left join i on i.urn = root left join o on o.urn = root left join f on f.urn = root)"""
RATING = "case when score >= 20 then 'HIGH' when score >= 8 then 'MEDIUM' else 'LOW' end"


@query(dg.code_sql(HOT + f"""
select *, {RATING} rating from hot order by score desc, urn limit 20"""))
def hotspots_top20(spark, d):
    hot = impact.hotspots(dg.code_graph(spark, d), 20)
    return hot.select("urn", "n_in", "n_out", "features", "consumers", "apis", "tests", "score", "rating").orderBy(F.desc("score"), "urn").limit(20)


@query(dg.code_sql(HOT + f"""
select {RATING} rating, count(*) n, sum(score)::bigint total from hot group by 1"""))
def hotspot_rating_counts(spark, d):
    return impact.hotspots(dg.code_graph(spark, d)).groupBy("rating").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(dg.code_sql(HOT + """
select 'coupled' as rule, urn, score from hot where score > 60"""))
def max_coupling(spark, d):
    return rules.too_coupled(impact.hotspots(dg.code_graph(spark, d)), "coupled", 60)


@query(dg.code_sql("""
select urn, name, path from act n where kind = 'symbol' and not exists (select 1 from edges where target_urn = n.urn)"""))
def dead_symbols(spark, d):
    return graph.dead_symbols(dg.code_graph(spark, d)).select("urn", "name", "path")


@query(dg.code_sql(""", p as (select urn, path from act where path <> ''), used as (select b.path from edges join p a on a.urn = source_urn join p b on b.urn = target_urn where a.path <> b.path)
select distinct path from p where path not in (select path from used) and regexp_matches(path, '\\.tsx?$')"""))
def dead_files(spark, d):
    return graph.dead_files(dg.code_graph(spark, d))


DANGLING = ", known as (select urn, case when urn like 'order:%' and path = '5-LOW' then 'retired' else 'active' end status from nodes where urn not like 'part:%7')"


@query(dg.sql(DANGLING + """, ends as (select source_urn, target_urn, 'source' side, source_urn urn from edges union all select source_urn, target_urn, 'target', target_urn from edges)
select source_urn, target_urn, side, case when status is null then 'missing' else 'retired' end problem from ends left join known using (urn) where status is null or status = 'retired'"""))
def dangling_edges(spark, d):
    return graph.dangling(_damaged(spark, d))


def _damaged(spark, d) -> Graph:
    """Without every part whose key ends in 7; orders of the lowest priority are retired."""
    n = dg.nodes(spark, d).where("urn not like 'part:%7'")
    return Graph(n.withColumn("status", F.when(F.col("urn").like("order:%") & (F.col("path") == "5-LOW"), "retired").otherwise("active")), dg.edges(spark, d))


@query(dg.sql(DANGLING + """
select source_urn, target_urn, relationship from edges where source_urn not in (select urn from known where status = 'retired') and target_urn not in (select urn from known where status = 'retired')"""))
def retire_edges(spark, d):
    g = _damaged(spark, d)
    return graph.retire(g, g.nodes.where("status = 'retired'")).edges.select("source_urn", "target_urn", "relationship")


@query(dg.sql(""", p as (select urn, path from nodes where path <> ''), used as (select b.path from edges join p a on a.urn = source_urn join p b on b.urn = target_urn where a.path <> b.path)
select distinct path from p where path not in (select path from used)"""))
def unconsumed_paths(spark, d):
    return graph.unconsumed_paths(dg.graph(spark, d))


@query(dg.sql("""
select urn from nodes where kind = 'feature' and urn not in (select target_urn from edges e where relationship = 'implements' and source_urn in (select target_urn from edges where relationship = 'calls'))"""))
def orphan_features(spark, d):
    g = dg.graph(spark, d)
    called = g.edges.where("relationship = 'calls'").select(F.col("target_urn").alias("source_urn"))
    live = g.edges.where("relationship = 'implements'").join(called, "source_urn", "left_semi")
    return graph.orphan_features(Graph(g.nodes, live)).select("urn")


# Features


EXPLAIN = """, linked as (select source_urn node, target_urn feature, confidence, confidence_score, relationship from edges union all select target_urn, source_urn, confidence, confidence_score, relationship from edges where source_urn <> target_urn),
l as (select linked.* from linked join nodes on urn = feature where kind = 'feature'), asked as (select 'old:' || p_partkey target, 'part:' || p_partkey node from pt where p_partkey % 10 = 5 union all select 'part:' || p_partkey, 'part:' || p_partkey from pt where p_partkey % 10 <> 5),
direct as (select target, feature, arg_max(confidence, confidence_score * 10 + case confidence when 'EXPLICIT' then 3 when 'DETECTED' then 2 else 1 end) confidence, max(confidence_score) score, string_agg(relationship, ',' order by relationship) edges from asked join l using (node) group by 1, 2),
inferred as (select distinct target, l.feature, n.path from asked join nodes n on n.urn = node join l on l.node = 'file:' || n.path)
select target, feature, confidence, score, edges from direct union all select target, feature, 'INFERRED', 0.5, 'file ' || path from inferred where (target, feature) not in (select (target, feature) from direct)"""


@query(dg.code_sql(EXPLAIN))
def explain_features(spark, d):
    """Every part is asked for; those with an old name under that one."""
    k = F.col("p_partkey")
    asked = dg.table(spark, d, "part").select(F.concat(F.when(k % 10 == 5, "old:").otherwise("part:"), k.cast("string")).alias("urn"))
    return views.explain(dg.code_graph(spark, d), asked).withColumn("edges", F.array_join("edges", ","))


VIEW = """, near as (select distinct f.urn feature, n.urn, n.kind, n.path from edges e join act f on f.urn = e.target_urn join act n on n.urn = e.source_urn where f.kind = 'feature'),
own as (select feature, case when kind = 'symbol' and ends_with(path, '.tsx') then 'ui' when kind = 'symbol' then 'services' when kind = 'route' then 'api' when kind = 'model' then 'database' when kind = 'test' then 'tests' end as role, urn from near),
v as (select feature, role, urn from own where role is not null union select source_urn, 'consumers', target_urn from edges where relationship = 'consumes'
  union select o.feature, 'consumers', m.feature from own o join edges e on e.target_urn = o.urn join member m on m.urn = e.source_urn where role in ('services', 'api') and relationship in ('calls', 'imports') and m.feature <> o.feature)"""


@query(dg.code_sql(VIEW + """
select feature, role, count(*) n from v group by all"""))
def feature_view_counts(spark, d):
    return views.feature_view(dg.code_graph(spark, d)).groupBy("feature", "role").agg(F.count("*").alias("n"))


COVER = """, docs as (select distinct url as path from pages union all select 'docs/' || p_type || '.md' from part where p_size = 4), n as (select f.urn feature, count(*) filter (role in ('ui', 'services')) implementation, count(*) filter (role = 'api') api, count(*) filter (role = 'database') as database, count(*) filter (role = 'tests') tests,
  max(case when f.name in (select f2.name from act f2, docs where f2.kind = 'feature' and contains(lower(docs.path), f2.name)) then 1 else 0 end)::bigint documentation, count(*) filter (role = 'consumers') consumers from act f left join v on v.feature = f.urn where f.kind = 'feature' group by 1),
long as (unpivot n on implementation, api, database, tests, documentation, consumers into name dimension value n),
scored as (select *, case when dimension = 'tests' and n = 1 then 50 when n > 0 then 100 else 0 end points from long)"""


@query(dg.code_sql(VIEW + COVER + """
select feature, dimension, n, case points when 100 then 'COMPLETE' when 50 then 'PARTIAL' else 'MISSING' end status, points from scored"""))
def feature_coverage(spark, d):
    return views.coverage(dg.code_graph(spark, d), _docs(spark, d))


def _docs(spark, d) -> DataFrame:
    """Pages, and a document for each type of parts of one size."""
    named = dg.table(spark, d, "part").where("p_size = 4").select(F.concat(F.lit("docs/"), "p_type", F.lit(".md")))
    return dg.table(spark, d, "pages").select(F.col("url").alias("path")).union(named)


@query(dg.code_sql(VIEW + COVER + """
select feature, floor(avg(points) + 0.5)::int percent from scored group by 1"""))
def feature_completeness(spark, d):
    return views.completeness(views.coverage(dg.code_graph(spark, d), _docs(spark, d)))


FUNCTIONS = """, fn as (select feature, n.urn, n.name, n.path, n.start_line from member m join act n on n.urn = m.urn where kind = 'symbol' and symbol_kind in ('function', 'method', 'class')),
uses as (select source_urn, target_urn from edges where relationship in ('calls', 'imports')),
k as (select target_urn urn, count(*) callers, count(distinct nullif(path, '')) paths from uses join act a on a.urn = source_urn group by 1),
inside as (select a.feature, source_urn, target_urn from uses join fn a on a.urn = source_urn join fn b on b.urn = target_urn and b.feature = a.feature),
fm as (select feature, urn, name, path, start_line, coalesce(callers, 0) callers, coalesce(paths, 0) > 1 shared, (feature, urn) not in (select (feature, target_urn) from inside) entry, (select count(distinct target_urn) from inside i where i.feature = fn.feature and i.source_urn = fn.urn) inner_calls from fn left join k using (urn)),
placed as (select *, row_number() over (partition by feature order by entry desc, callers desc, path, start_line, urn)::int place from fm)"""


@query(dg.code_sql(FUNCTIONS + """
select * from placed"""))
def function_map(spark, d):
    return views.function_map(dg.code_graph(spark, d))


@query(dg.code_sql(VIEW + """, named as (select v.*, name, path from v join act using (urn))
select urn feature, '' section, 0 place, '## ' || name line from act where kind = 'feature'
union all select feature, role, row_number() over (partition by feature, role order by path, name, urn)::int, '- ' || name || case when path <> '' then ' (' || path || ')' else '' end from named"""))
def markdown_index(spark, d):
    return views.index_lines(dg.code_graph(spark, d))


@query("""with hits as (select p_type feature, p_partkey urn, p_name from part where contains(p_name, 'a')), total as (select count(distinct urn) all_ from hits)
select feature, count(*) n, sum(length(p_name))::bigint score, round(count(distinct urn) / all_, 4) share, count(distinct urn) / all_ >= 0.2 genuine from hits, total group by feature, all_""")
def feature_share_gate(spark, d):
    hits = dg.table(spark, d, "part").where(F.col("p_name").contains("a"))
    total = hits.agg(F.count_distinct("p_partkey").alias("total"))
    by = hits.groupBy(F.col("p_type").alias("feature")).agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("score"), F.count_distinct("p_partkey").alias("members")).crossJoin(total)
    return by.select("feature", "n", "score", F.round(F.col("members") / F.col("total"), 4).alias("share"), (F.col("members") / F.col("total") >= 0.2).alias("genuine"))


# Traversal


@query(dg.sql(""", reach(urn, depth) as (select 'part:42', 0 union select source_urn, depth + 1 from reach join edges on target_urn = urn where depth < 4)
select urn, min(depth) depth from reach where urn <> 'part:42' group by 1""", recursive=True))
def impact_single(spark, d):
    root = spark.createDataFrame([("part:42",)], "urn string")
    return traverse.consumers(dg.edges(spark, d, tasks=dg.tasks(spark, d)), root).select("urn", "depth")


def _roots(spark, d) -> DataFrame:
    """All symbols, files and models."""
    return dg.code_graph(spark, d).active().where("kind in ('symbol', 'file', 'model')").select("urn")


@query(dg.code_sql(IMPACT + """
select root, urn, depth from reach where depth > 0"""))
def impact_batch(spark, d):
    return traverse.consumers(impact.live_edges(dg.code_graph(spark, d)), _roots(spark, d))


@query(dg.code_sql(IMPACT + """
select root, category, count(*) n from imp group by all"""))
def impact_categories(spark, d):
    return impact.category_counts(dg.code_graph(spark, d), _roots(spark, d))


@query(dg.code_sql(IMPACT.replace("kind in ('symbol', 'file', 'model')", "urn like 'part:%5'") + """
select 'old' || substr(root, 5) root, category, urn from imp"""))
def impact_of_old_names(spark, d):
    """Parts are asked for under the names that they once had."""
    g = dg.code_graph(spark, d)
    alive = g.active().select("urn")
    return impact.impact(g, g.aliases.join(alive, "urn", "left_semi").select(F.col("old_urn").alias("urn")))


@query(dg.code_sql(IMPACT + """
select *, case when features >= 3 or (routes > 0 and tests > 5) then 'HIGH' when features >= 1 or routes > 0 or direct + indirect >= 5 then 'MEDIUM' else 'LOW' end risk from c"""))
def risk_rating(spark, d):
    return impact.counts(dg.code_graph(spark, d), _roots(spark, d))


@query(dg.code_sql(IMPACT + """
select 'tested' as rule, urn, path from act where kind = 'symbol' and regexp_matches(path, '^jobs/.*$') and urn not in (select root from imp where category = 'test')"""))
def requires_tests(spark, d):
    return rules.untested(dg.code_graph(spark, d), "tested", "jobs/**")


REVIEW = """, files as (select 'src/Brand/' || b || '/' || z || '.ts' as path from (values (1, 3), (13, 14), (25, 35)) x(b, z) union all select 'schema/NATION_6' union all select 'jobs/' || s || '.ts' from (values (1), (2), (3)) y(s)),
changed as (select urn, kind from act join files using (path) where kind in ('symbol', 'route', 'model', 'test'))"""


@query(dg.code_sql(REVIEW + IMPACT.replace("roots as (select urn root from act where kind in ('symbol', 'file', 'model'))", "roots as (select urn root from changed where kind <> 'test')") + EXPLAIN.replace("asked as (select 'old:'", "asked as (select urn target, urn node from changed where kind = 'symbol'), unused as (select 'old:'").split("\nselect")[0] + """,
f as (select urn from imp where category = 'feature' union select feature from direct union select feature from inferred), t as (select distinct urn from imp where category = 'test'),
k as (select count(*) filter (kind = 'symbol') symbols, count(*) filter (kind = 'route') apis, count(*) filter (kind = 'model') models from changed)
select (select count(*) from files) files, symbols, apis, models, (select count(*) from f) features, (select count(*) from t) tests, (select count(*) from imp join changed on changed.urn = root where category = 'direct' and kind = 'symbol') direct_consumers,
  case when models > 0 or (select count(*) from f) >= 3 then 'HIGH' else 'MEDIUM' end risk, 'symbols changed, no test did;models changed: check stored data;routes changed, no test did' concerns from k"""))
def change_review(spark, d):
    paths = [f"src/Brand/{b}/{z}.ts" for b, z in ((1, 3), (13, 14), (25, 35))] + ["schema/NATION_6"] + [f"jobs/{s}.ts" for s in (1, 2, 3)]
    return review.review(dg.code_graph(spark, d), spark.createDataFrame([(p,) for p in paths], "path string")).withColumn("concerns", F.array_join("concerns", ";"))


@query(dg.RING_SQL + """
select 'part:' || p_partkey urn, least_ component from groups where p_size % 2 = 0 and n > 1""")
def cycle_nodes(spark, d):
    return traverse.on_cycles(dg.ring_edges(spark, d))


@query(dg.EVENT_SQL + """, trail(path) as (select [s, t] from step where s < t union all select list_append(path, t) from trail join step on s = path[-1] where t > path[1] and not list_contains(path, t) and len(path) < 4)
select list_aggregate(path, 'string_agg', '>') as cycle, len(path)::int n from trail join step on s = path[-1] and t = path[1]""")
def cycles_bounded(spark, d):
    return traverse.cycles(dg.event_edges(spark, d), 4).select(F.array_join("cycle", ">").alias("cycle"), "n")


@query(dg.EVENT_SQL + """, trail(path) as (select ['view'] union all select list_append(path, t) from trail join step on s = path[-1] where path[-1] <> 'purchase' and not list_contains(path, t) and len(path) < 4)
select list_aggregate(path, 'string_agg', '>') as path, len(path)::int n from trail where path[-1] = 'purchase' order by n, path limit 5""")
def call_paths_bounded(spark, d):
    one = lambda u: spark.createDataFrame([(u,)], "urn string")
    return traverse.paths(dg.event_edges(spark, d), one("view"), one("purchase"), 4).select(F.array_join("path", ">").alias("path"), "n").orderBy("n", "path").limit(5)


SESSIONS = """with gaps as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 24 hours, true)::int new_ from events),
marked as (select *, sum(new_) over (partition by user_id order by ts, event_id) k from gaps), sessions as (select user_id, k, min(ts) a, max(ts) b from marked group by 1, 2)"""


@query(SESSIONS + """
select s.user_id, s.k::bigint session, count(*) errors from sessions s join events e on e.user_id = s.user_id and e.ts between a and b where event_type = 'error' group by all""")
def sites_in_ranges(spark, d):
    e = dg.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval '24' hour"), F.lit(True)).cast("int")
    ranges = e.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    sites = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"))
    return resolve.contained(sites, ranges, "user_id").groupBy("user_id", "session").agg(F.count("*").alias("errors"))


# Search, classification and names

WORDS = r"list_transform(list_filter(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w))"


def _hit(x: str, t: str) -> str:
    same = f"regexp_replace(w, 's$', '') = '{t.removesuffix('s')}'"
    return f"len(list_filter({WORDS.format(x=x)}, lambda w: {same} or starts_with(w, '{t}'))) > 0"


@query(f"""with s as (select p_partkey urn, p_name as name, case when lower(p_name) in ('small gear', 'small', 'gear') then 10 else
  (case when {_hit('p_name', 'small')} then 5 else 0 end) + (case when {_hit('p_brand', 'small')} then 3 else 0 end) + (case when {_hit('p_name', 'gear')} then 5 else 0 end) + (case when {_hit('p_brand', 'gear')} then 3 else 0 end) end
  + (case when {_hit('p_type', 'small')} then 4 else 0 end) + (case when {_hit('p_type', 'gear')} then 4 else 0 end) score from part)
select urn, name, score::bigint score from s where score > 0 order by score desc, urn limit 20""")
def search_top20(spark, d):
    part = dg.table(spark, d, "part").select(F.col("p_partkey").alias("urn"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), "p_type")
    return search(part, "small gear", 20, ("p_type",)).select("urn", "name", "score")


VOCAB = [("small", "Sizes", []), ("anvils", "Metal", []), ("gear", "Metal", []), ("large", "Sizes", []), ("econ", "Economy", []), ("promo", "Promotions", [])]


def _score_sql(k: str) -> str:
    same = "len(list_filter({x}, lambda w: w = keyword or regexp_replace(w, 's$', '') = regexp_replace(keyword, 's$', ''))) > 0"
    begins = "length(keyword) >= 4 and len(list_filter({x}, lambda w: starts_with(w, keyword))) > 0"
    return f"case when {same.format(x='nw')} then 100 + length(keyword) when {same.format(x='pw')} then 80 + length(keyword) when {begins.format(x='nw')} then 40 + length(keyword) when {begins.format(x='pw')} then 30 + length(keyword) else 0 end"


@query(f"""with vocab(ord, keyword, feature_name) as (values {', '.join(f"({k}, '{v[0]}', '{v[1]}')" for k, v in enumerate(VOCAB))}),
p as (select p_partkey urn, {WORDS.format(x='p_name')} nw, {WORDS.format(x='p_type')} pw from part), s as (select urn, ord, keyword, feature_name, {_score_sql('')} score from p, vocab)
select urn, keyword, feature_name, score::int score from (select *, row_number() over (partition by urn order by score desc, ord) k from s where score > 0) where k = 1""")
def keyword_classify(spark, d):
    part = dg.table(spark, d, "part").select(F.col("p_partkey").alias("urn"), exprs.words(F.col("p_name"), False).alias("symbol_words"), exprs.words(F.col("p_type"), False).alias("path_words"))
    return classify.best_keyword(part, classify.vocabulary(spark, VOCAB)).select("urn", "keyword", "feature_name", "score")


@query(r"""with p as (select page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') as route from pages),
q as (select page_id, list_filter(string_split(route, '/'), lambda x: x <> '' and not regexp_matches(x, '^\(.*\)$') and x not in ('api', 'v1', 'v2', 'v3', 'app', 'routes') and not starts_with(x, '[')) parts from p)
select page_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '\.[A-Za-z0-9]+$', '')), lambda x: lower(x) not in ('rss', 'sitemap', 'robots', 'favicon', 'og', 'manifest'))[1] as domain from q""")
def route_domain(spark, d):
    return dg.table(spark, d, "pages").select("page_id", exprs.route_domain(F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")).alias("domain"))


@query(r"""select page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') slug,
list_aggregate(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w)), 'string_agg', ' ') words from pages""")
def slug_and_words(spark, d):
    return dg.table(spark, d, "pages").select("page_id", exprs.slug(F.col("url")).alias("slug"), F.array_join(exprs.words(F.col("url")), " ").alias("words"))


@query("""select 'urn:loom:symbol:' || replace(p_brand, '#', '/') || '#' || p_name urn, 'symbol' kind, replace(p_brand, '#', '/') as path, p_name ident, count(*) n from part group by all""")
def urn_parts(spark, d):
    u = dg.table(spark, d, "part").select(exprs.symbol_urn(F.translate("p_brand", "#", "/"), F.col("p_name")).alias("urn"))
    return u.groupBy("urn").agg(F.count("*").alias("n")).select("urn", *[exprs.urn_part(F.col("urn"), p).alias(p) for p in ("kind", "path", "ident")], "n")


# Resolution


@query("""with f as (select page_id, regexp_replace(url, '^[a-z]+://([^/]*).*$', '\\1') host, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) lang from pages)
select page_id, target, tier from (select a.page_id, b.page_id target, case when a.host = b.host then 1 else 2 end tier,
  row_number() over (partition by a.page_id order by case when a.host = b.host then 1 else 2 end, b.page_id) k from f a join f b on a.page_id <> b.page_id where a.host = b.host or a.lang = b.lang) where k = 1""")
def import_first_match(spark, d):
    f = dg.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("lang"))
    return resolve.first_others(f, ["host", "lang"], "page_id").withColumnRenamed("other", "target")


@query(dg.code_sql(""", i as (select distinct path source_file, './' || (o_orderkey % 2000) module_specifier from od union select distinct path, '../src/Brand/' || (o_orderkey % 30) || '/./' || (o_custkey % 60) from od),
t as (select *, case when module_specifier like './%' then 'jobs/' || substr(module_specifier, 3) else replace(substr(module_specifier, 4), '/./', '/') end base from i)
select source_file, module_specifier, p.path target_path from t join (select distinct path, regexp_replace(path, '\\.tsx?$', '') stem from (select path from od union select path from pt)) p on p.stem = base"""))
def import_targets(spark, d):
    path = F.concat(F.lit("jobs/"), F.col("o_custkey").cast("string"), F.lit(".ts"))
    key = lambda c, n: (F.col(c) % n).cast("string")
    o = dg.table(spark, d, "orders")
    near = o.select(path.alias("source_file"), F.concat(F.lit("./"), key("o_orderkey", 2000)).alias("module_specifier"))
    far = o.select(path, F.concat(F.lit("../src/Brand/"), key("o_orderkey", 30), F.lit("/./"), key("o_custkey", 60)))
    files = dg.code_nodes(spark, d).where("kind = 'file'").select("path")
    return resolve.import_targets(near.union(far).distinct(), files).select("source_file", "module_specifier", "target_path")


@query("""with f as (select distinct 'pkg/' || replace(p_brand, '#', '') || '/s' || p_size dir, 'pkg/' || replace(p_brand, '#', '') || '/s' || p_size || '/p' || p_partkey || '.go' as path from part),
i as (select distinct 'ex.org/' || replace(p_brand, '#', '') || '/s' || (p_size + 20) spec, replace(p_brand, '#', '') || '/s' || (p_size + 20) long, 's' || (p_size + 20) short from part),
hit as (select *, exists (select 1 from f where ends_with(dir, '/' || long)) whole from i)
select 'main.go' source_file, spec module_specifier, path target_path from hit join f on ends_with(dir, '/' || case when whole then long else short end)""")
def package_files(spark, d):
    brand = F.translate("p_brand", "#", "")
    part = dg.table(spark, d, "part")
    files = part.select(F.concat(F.lit("pkg/"), brand, F.lit("/s"), F.col("p_size").cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"))
    asked = part.select(F.lit("main.go").alias("source_file"), F.concat(F.lit("ex.org/"), brand, F.lit("/s"), (F.col("p_size") + 20).cast("string")).alias("module_specifier"))
    return resolve.package_files(asked, files)


@query(dg.code_sql(""", i as (select distinct od.path source_file, pt.path target_path, p_name as name from od join lineitem on l_orderkey = o_orderkey join pt on l_partkey = p_partkey)
select source_file, target_path, i.name, max(n.urn) urn from i join nodes n on n.path = target_path and n.name = i.name where kind = 'symbol' group by all"""))
def imported_names(spark, d):
    path = lambda df: df.select("l_orderkey", "l_partkey").distinct()
    nodes = dg.code_nodes(spark, d).where("kind = 'symbol'")
    order = nodes.where("urn like 'order:%'").select(F.substring("urn", 7, 20).cast("bigint").alias("l_orderkey"), F.col("path").alias("source_file"))
    part = nodes.where("urn like 'part:%'").select(F.substring("urn", 6, 20).cast("bigint").alias("l_partkey"), F.col("path").alias("target_path"), F.array("name").alias("imported_symbols"))
    said = path(dg.table(spark, d, "lineitem")).join(order, "l_orderkey").join(part, "l_partkey").select("source_file", "target_path", "imported_symbols").distinct()
    return resolve.imported_symbols(said, nodes).select("source_file", "target_path", "name", "urn")


@query(dg.code_sql("""
select source_urn, target_urn, relationship from (select *, row_number() over (partition by source_urn, target_urn order by confidence_score desc, relationship) k from edges) where k = 1"""))
def edges_once(spark, d):
    n = dg.tasks(spark, d)
    return graph.distinct_edges(dg.code_edges(spark, d, n), F.struct((-F.col("confidence_score")).alias("s"), "relationship"), n).select("source_urn", "target_urn", "relationship")


@query(dg.code_sql(""", added as (select 'part:' || p_partkey s, 'part:' || (p_partkey + 1) t from pt)
select s source_urn, t target_urn from added where s not in (select urn from nodes where status = 'retired') and t not in (select urn from nodes where status = 'retired')"""))
def edges_added(spark, d):
    """Edges from each part to the one of the next number, known or not; those of retired parts are left out."""
    g = dg.code_graph(spark, d)
    part = lambda k: F.concat(F.lit("part:"), k.cast("string"))
    new = dg.table(spark, d, "part").select(part(F.col("p_partkey")).alias("source_urn"), part(F.col("p_partkey") + 1).alias("target_urn"), F.lit("follows").alias("relationship"))
    return graph.add_edges(g, new).edges.where("relationship = 'follows'").select("source_urn", "target_urn")


@query(dg.code_sql(""", moved as (select distinct path, replace(path, 'src/', 'lib/') new_ from pt where p_size % 5 = 0)
select replace(urn, path, new_) urn, new_ as path, urn old_urn from nodes join moved using (path)"""))
def nodes_renamed(spark, d):
    nodes = dg.code_nodes(spark, d)
    moved = nodes.where("kind = 'file' and path rlike '[05]\\\\.tsx?$' and path like 'src/%'").select(F.col("path").alias("from_key"), F.regexp_replace("path", "^src/", "lib/").alias("to_key"))
    renamed, aliases = incremental.renamed_nodes(nodes, moved)
    return renamed.where("path like 'lib/%'").join(aliases, "urn").select("urn", "path", "old_urn")


@query(dg.code_sql(""", files as (select distinct path, p_size * 10 + 1 n from pt union select distinct path, 800 from od where o_custkey % 9 <> 0)
select 'error' severity, 'missing file' problem, urn, path from act where path <> '' and path not in (select path from files)
union all select 'warning', 'lines beyond the file', urn, path from act join files using (path) where kind = 'symbol' and start_line > 0 and (start_line > n or end_line > n)"""))
def graph_problems(spark, d):
    """Every file has a text of as many lines as its size says, or none."""
    nodes = dg.code_nodes(spark, d).where("kind = 'file'").select("path")
    src = nodes.where("path like 'src/%'").select("path", (F.regexp_extract("path", r"(\d+)\.tsx?$", 1).try_cast("int") * 10 + 1).alias("n"))
    jobs = nodes.where("path like 'jobs/%'").where(F.regexp_extract("path", r"(\d+)\.ts$", 1).try_cast("bigint") % 9 != 0).select("path", F.lit(800))
    texts = src.union(jobs).select("path", F.repeat(F.lit("x\n"), F.col("n") - 1).alias("text"))
    return review.problems(dg.code_graph(spark, d), texts)


CALL_SQL = """with s as (select 'part:' || p_partkey urn, p_name as name, p_brand as path, p_type, count(*) over (partition by p_name) = 1 alone from part where p_partkey % 2 = 0),
c as (select p_partkey call_id, p_name as name, p_brand as file, p_type from part where p_partkey % 2 = 1), imported as (select distinct 'Brand#' || (p_size % 5 + 1) || '1' file_type, p_brand as path from part where p_size <= 10),
m as (select call_id, urn, case when file = s.path then 1 when exists (select 1 from imported i where i.file_type = c.file and i.path = s.path) then 2 when alone then 3 end tier from c join s using (name))
select call_id, urn, tier from (select *, row_number() over (partition by call_id order by tier, urn) k from m where tier is not null) where k = 1"""


@query(CALL_SQL)
def call_resolution(spark, d):
    part = dg.table(spark, d, "part")
    symbols = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("urn"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    calls = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("call_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    imported = part.where("p_size <= 10").select(F.concat(F.lit("Brand#"), (F.col("p_size") % 5 + 1).cast("string"), F.lit("1")).alias("file"), F.col("p_brand").alias("path"))
    return resolve.resolve_calls(calls, symbols, imported)


@query(dg.code_sql("""
select r.path, r.urn route, t.urn test from act r join act t on t.path = r.path and t.kind = 'test' where r.kind = 'route'"""))
def file_group_cross(spark, d):
    """Routes and tests of one file."""
    nodes = dg.code_graph(spark, d).active()
    side = lambda kind: nodes.where(F.col("kind") == kind).select("path", F.col("urn").alias(kind))
    return resolve.within_group(side("route"), side("test"), "path")


@query("""with declared as (select p_type feature, unnest([min(p_name), max(p_name)]) as name from part group by 1)
select distinct d.feature, p_partkey urn from declared d join part on p_name = d.name""")
def explicit_mapping(spark, d):
    part = dg.table(spark, d, "part")
    declared = part.groupBy(F.col("p_type").alias("feature")).agg(F.array(F.min("p_name")).alias("components"), F.array(F.max("p_name")).alias("services"))
    return classify.explicit(part.select(F.col("p_partkey").alias("urn"), F.col("p_name").alias("name")), declared)


DETECT = [*VOCAB, ("nation", "Nations", []), ("jobs", "Jobs", [])]
LOOSE = f"""with recursive vocab(ord, keyword, feature_name) as (values {', '.join(f"({k}, '{v[0]}', '{v[1]}')" for k, v in enumerate(DETECT))}),
s as (select 'part:' || p_partkey urn, p_name as name, 'src/' || case when p_size % 9 = 0 then 'modules/' || lower(replace(p_brand, '#', '-')) || '/x' else p_type end as path from part),
l as (select urn, {WORDS.format(x='name')} nw, {WORDS.format(x='path')} pw from s where path not like 'src/modules/%'),
k as (select urn, ord, feature_name, {_score_sql('')} score from l, vocab),
best as (select * from (select *, row_number() over (partition by urn order by score desc, ord) n from k where score > 0) where n = 1),
found as (select 'supplier:' || s_suppkey urn, n_name as name, 'DETECTED' confidence, 0.85 score, 'route_match' evidence from supplier join nation on s_nationkey = n_nationkey
  union all select 'model:' || n_nationkey, 'Nations', 'DETECTED', 0.85, 'model_ref' from nation where contains(lower(n_name), 'nation')
  union all select urn, string_split(path, '/')[3], 'DETECTED', 0.9, 'directory_cluster' from s where path like 'src/modules/%'
  union all select urn, feature_name, 'DETECTED', 0.85, 'directory_cluster' from best where (score >= 80 and score < 100) or score < 40
  union all select urn, feature_name, 'INFERRED', 0.6, 'semantic_similarity' from best where not ((score >= 80 and score < 100) or score < 40)
  union all select 'test:' || c_custkey, 'Jobs', 'DETECTED', 0.8, 'ast_call' from customer)
"""


@query(LOOSE + """select urn, regexp_replace(lower(replace(name, '_', ' ')), '[^a-z0-9]+', '-', 'g') slug, confidence, score::double score, evidence from found""")
def detected_candidates(spark, d):
    return _candidates(spark, d).select("urn", "slug", "confidence", "score", "evidence")


def _candidates(spark, d) -> DataFrame:
    """From suppliers as routes below their nation, nations as models, parts as symbols, of which some lie in modules, and a test for each customer."""
    t = lambda name: dg.table(spark, d, name)
    urn = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("urn")
    routes = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(urn("supplier", "s_suppkey"), F.concat(F.lit("/api/v1/"), "n_name", F.lit("/"), F.col("s_suppkey").cast("string")).alias("route_path"))
    models = t("nation").select(urn("model", "n_nationkey"), F.col("n_name").alias("name"))
    module = F.concat(F.lit("modules/"), F.lower(F.translate("p_brand", "#", "-")), F.lit("/x"))
    symbols = t("part").select(urn("part", "p_partkey"), F.col("p_name").alias("name"), F.concat(F.lit("src/"), F.when(F.col("p_size") % 9 == 0, module).otherwise(F.col("p_type"))).alias("path"))
    tests = t("customer").select(urn("test", "c_custkey"), F.lit("runs").alias("name"), F.lit("jobs/a.ts").alias("path"))
    return classify.candidates(routes, models, symbols, tests, classify.vocabulary(spark, DETECT))


@query(LOOSE + """, f as (select distinct 'urn:loom:feature:' || trim(regexp_replace(lower(replace(name, '_', ' ')), '[^a-z0-9]+', '-', 'g'), '-') feature, urn, confidence, score from found),
declared as (select 'urn:loom:feature:sizes' feature), linked as (select 'part:' || p_partkey urn, 'urn:loom:feature:sizes' feature from part where p_size = 1 or p_name like 'small%')
select urn, feature, 'EXPLICIT' confidence, 1.0::double score from linked
union all select urn, feature, confidence, score::double from (select *, row_number() over (partition by urn, feature order by score desc) k from f) where k = 1 and (urn, feature) not in (select (urn, feature) from linked)""")
def merged_features(spark, d):
    """One feature is declared, with parts of its own; what is detected joins it or makes others."""
    part = dg.table(spark, d, "part").where("p_size = 1 or p_name like 'small%'")
    linked = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("urn"), F.lit("urn:loom:feature:sizes").alias("feature"))
    declared = spark.createDataFrame([("urn:loom:feature:sizes", "Sizes", [])], "urn string, name string, tags array<string>")
    return classify.merged(declared, linked, _candidates(spark, d))[1].select("urn", "feature", "confidence", F.col("confidence_score").alias("score"))


# Rules

RULES = [{"name": "urgent", "from": "1-*", "cannot_import": "Brand#1*"}, {"name": "nations", "from": "*A*", "cannot_import": "2-**"}]
FORBIDDEN = dg.sql(""", r as (select source_urn, target_urn, a.path f, b.path t from edges join nodes a on a.urn = source_urn join nodes b on b.urn = target_urn),
v as (select 'urgent' as rule, source_urn, target_urn from r where regexp_matches(f, '^1-[^/]*$') and regexp_matches(t, '^Brand#1[^/]*$') union all select 'nations', source_urn, target_urn from r where regexp_matches(f, '^[^/]*A[^/]*$') and regexp_matches(t, '^2-.*$'))""")


@query(FORBIDDEN + "\nselect rule, source_urn, target_urn from v")
def forbidden_edges(spark, d):
    g = dg.graph(spark, d)
    return rules.forbidden(g.nodes, g.edges, rules.rule_rows(spark, RULES))


@query(FORBIDDEN + ", s as (select *, case when rule = 'urgent' then 'ERROR' else 'WARNING' end severity from v)\nselect count(*) violations, count(*) filter (severity = 'ERROR') failed, greatest(0, 2 - count(*) filter (severity = 'ERROR')) passed from s")
def rule_report(spark, d):
    v = forbidden_edges(spark, d).withColumn("severity", F.when(F.col("rule") == "urgent", "ERROR").otherwise("WARNING"))
    return rules.report(v, len(RULES))


CHECKED = [
    {"name": "jobs-apart", "from": "jobs/**", "cannot_import": "src/Brand/1*/*.ts"},
    {"name": "tested", "target": "jobs/**", "requires_tests": True},
    {"name": "loose", "max_coupling": 60},
]
CHECK = dg.code_sql(HOT + """,
v as (select 'jobs-apart' as rule, 'ERROR' severity, source_urn urn, target_urn, a.path as path, line, null::bigint score, a.path || ' must not use ' || b.path message from edges join nodes a on a.urn = source_urn join nodes b on b.urn = target_urn
    where relationship in ('calls', 'imports') and regexp_matches(a.path, '^jobs/.*$') and regexp_matches(b.path, '^src/Brand/1[^/]*/[^/]*\\.ts$')
  union all select 'tested', 'WARNING', urn, null, path, start_line, null, name || ' has no test' from act where kind = 'symbol' and regexp_matches(path, '^jobs/.*$') and urn not in (select root from imp where category = 'test')
  union all select 'loose', 'WARNING', urn, null, path, null, score, name || ' scores more than 60' from (select hot.*, act.name, act.path from hot join act using (urn) order by score desc, urn limit 100) where score > 60)""")


@query(CHECK + "\nselect * from v")
def rule_check(spark, d):
    return rules.check(dg.code_graph(spark, d), CHECKED)


@query(CHECK + "\nselect 3::bigint rules, greatest(0, 3 - count(*) filter (severity = 'ERROR')) passed, count(*) filter (severity = 'ERROR') failed, count(*) violations, count(*) filter (severity = 'ERROR') = 0 compliant from v")
def rule_check_outcome(spark, d):
    return rules.outcome(rules.check(dg.code_graph(spark, d), CHECKED), CHECKED)


# Snapshots

SNAP = """with old as (select doc_id as path, sha256(text) hash from documents where doc_id % 7 <> 0), new as (select doc_id as path, sha256(case when doc_id % 11 = 0 then text || '!' else text end) hash from documents where doc_id % 13 <> 0),
c as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.hash <> n.hash then 'modified' else 'same' end as change from old o full join new n on o.path = n.path)"""


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = dg.table(spark, d, "documents")
    new_text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash")), docs.where("doc_id % 13 != 0").select(F.col("doc_id").alias("path"), F.sha2(new_text, 256).alias("hash"))


@query(SNAP + "\nselect path, change from c")
def snapshot_diff(spark, d):
    return incremental.changes(*_snapshots(spark, d))


@query(SNAP + """
select count(*) filter (change = 'added') added, count(*) filter (change = 'modified') modified, count(*) filter (change = 'deleted') deleted,
  round(least(1.0, count(*) filter (change <> 'same') / greatest(1, count(*) filter (change <> 'deleted'))), 4) score, count(*) filter (change <> 'same') > 0 stale, count(*) filter (change <> 'same') / count(*) filter (change <> 'deleted') > 0.4 rebuild from c""")
def drift_score(spark, d):
    return incremental.drift(incremental.changes(*_snapshots(spark, d)))


@query("""with o as (select sha256(text) hash, doc_id from_key, row_number() over (partition by sha256(text) order by doc_id) nth from documents where doc_id % 2 = 0), n as (select sha256(text) hash, doc_id to_key, row_number() over (partition by sha256(text) order by doc_id) nth from documents where doc_id % 2 = 1)
select from_key, to_key from o join n using (hash, nth)""")
def hash_renames(spark, d):
    docs = dg.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return incremental.renames(docs.where("path % 2 = 0"), docs.where("path % 2 = 1"))


@query("""with o as (select 'o' || o_orderkey urn, case when o_orderkey % 50 = 0 then 'file' else 'symbol' end kind, o_orderdate created_at from orders where o_orderkey % 3 <> 0), n as (select 'o' || o_orderkey urn, 'symbol' kind, timestamp '2000-01-01' created_at from orders where o_orderkey % 4 <> 0)
select urn, coalesce(n.kind, o.kind) kind, case when o.urn is null then 'added' when n.urn is not null then 'updated' when o.kind = 'file' then 'kept' else 'retired' end as action,
  case when n.urn is not null or o.kind = 'file' then 'active' else 'retired' end status, coalesce(o.created_at, n.created_at) created_at from o full join n using (urn)""")
def reconcile_upsert(spark, d):
    o = dg.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("urn"), "o_orderdate")
    old = o.where("o_orderkey % 3 != 0").select("urn", F.when(F.col("o_orderkey") % 50 == 0, "file").otherwise("symbol").alias("kind"), F.lit("active").alias("status"), F.col("o_orderdate").alias("created_at"))
    new = o.where("o_orderkey % 4 != 0").select("urn", F.lit("symbol").alias("kind"), F.lit("active").alias("status"), F.expr("cast('2000-01-01' as " + dict(o.dtypes)["o_orderdate"] + ")").alias("created_at"))
    return incremental.reconcile(old, new)


# Budgets, hashes, ledger

PUNCT_SQL = r"(length({x}) - length(regexp_replace({x}, '[{{}}()\[\];:,.<>=+\-*/&|!?]', '', 'g')))"


@query(f"""select lang, count(*) n, sum(ceil(length(text) / 3.3::double + 0.25 * {PUNCT_SQL.format(x='text')})::bigint)::bigint tokens, sum(ceil(length(text) / 3.8::double)::bigint)::bigint ledger_tokens from documents group by 1""")
def token_estimates(spark, d):
    return dg.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(exprs.token_estimate(F.col("text"))).alias("tokens"), F.sum(exprs.ledger_estimate(F.col("text"))).alias("ledger_tokens"))


@query("""with recursive i as (select conv_id, turn, ceil(length(text) / 3.8::double)::bigint c, row_number() over (partition by conv_id order by case role when 'system' then 10 when 'user' then 5 else 1 end desc, turn) k from conversations),
f(conv_id, k, total, ids, dropped) as (select distinct conv_id, 0::bigint, 0::bigint, '', 0::bigint from i union all select f.conv_id, i.k, case when total + c <= 400 then total + c else total end, case when total + c <= 400 then ids || ',' || turn else ids end, case when total + c <= 400 then dropped else dropped + 1 end from f join i on i.conv_id = f.conv_id and i.k = f.k + 1)
select conv_id, substr(ids, 2) packed, total, dropped from (select *, row_number() over (partition by conv_id order by k desc) r from f) where r = 1""")
def budget_pack(spark, d):
    c = dg.table(spark, d, "conversations")
    priority = F.when(F.col("role") == "system", 10).when(F.col("role") == "user", 5).otherwise(1)
    return budget.pack(c, "conv_id", priority, F.col("turn"), exprs.ledger_estimate(F.col("text")), F.col("turn"), 400)


@query(f"""with d as (select doc_id, text, left(text, 661) head from documents), mark as (select chr(10) || '... [truncated]' m),
c as (select doc_id, text, ceil(length(text) / 3.3::double + 0.25 * {PUNCT_SQL.format(x='text')}) <= 200 fits, list_max(list_filter(range(0, length(head) + 1), lambda n: ceil((n + length(m)) / 3.3::double + 0.25 * ({PUNCT_SQL.format(x='left(head, n)')} + {PUNCT_SQL.format(x='m')})) <= 200)) best, m from d, mark)
select doc_id, case when fits then text else left(text, best) || m end as text from c""")
def truncate_to_budget(spark, d):
    return dg.table(spark, d, "documents").select("doc_id", budget.truncate(F.col("text"), 200).alias("text"))


@query("""select doc_id, substr(sha256(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))), 1, 16) hash from documents""")
def slice_hash(spark, d):
    return dg.table(spark, d, "documents").select("doc_id", exprs.slice_hash(F.col("text"), F.lit(2), F.lit(4)).alias("hash"))


@query("""with t as (select doc_id, len(string_split(text, chr(10))) n from documents) select doc_id, n::int as lines, case when doc_id % 20 + 3 > n then 'warning' else 'ok' end severity from t""")
def validate_ranges(spark, d):
    n = F.size(F.split("text", "\n"))
    return dg.table(spark, d, "documents").select("doc_id", n.alias("lines"), F.when(F.col("doc_id") % 20 + 3 > n, "warning").otherwise("ok").alias("severity"))


@query("""with e as (select user_id, list(distinct case event_type when 'purchase' then 'explicit_declaration' when 'signup' then 'route_match' when 'error' then 'semantic_similarity' else 'other' end) s from events group by 1)
select user_id, case when list_contains(s, 'explicit_declaration') then 'EXPLICIT' when list_contains(s, 'route_match') then 'DETECTED' when list_contains(s, 'semantic_similarity') then 'INFERRED' else 'AMBIGUOUS' end confidence from e""")
def confidence_from_evidence(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "explicit_declaration").when(F.col("event_type") == "signup", "route_match").when(F.col("event_type") == "error", "semantic_similarity").otherwise("other")
    return dg.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(kind).alias("s")).select("user_id", exprs.confidence(F.col("s")).alias("confidence"))


@query("""select strftime(ts, '%Y-%m-%d') as day, event_type command, count(*) n, round(sum(value), 2) tokens, count(distinct user_id) sessions from events group by grouping sets ((), (day), (event_type))""")
def usage_summary(spark, d):
    """Totals, by day and by command, in one pass."""
    e = dg.table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("command"), F.col("value").alias("tokens_generated"), F.col("user_id").alias("session_id"))
    return tree.usage_totals(e).withColumn("tokens", F.round("tokens", 2))


@query("""with f as (select distinct p_name as name from part union select distinct upper(regexp_extract(url, '://([^./]*)', 1)) from pages)
select name, exists (select 1 from pages where contains(lower(url), lower(name))) documented from f where name <> ''""")
def doc_term_hits(spark, d):
    pages = dg.table(spark, d, "pages").select(F.col("url").alias("path"))
    names = dg.table(spark, d, "part").select(F.col("p_name").alias("name")).union(pages.select(F.upper(F.regexp_extract("path", "://([^./]*)", 1)))).where("name != ''").distinct()
    hit = views.named_in(names, pages).withColumn("documented", F.lit(True))
    return names.join(hit, "name", "left").select("name", F.coalesce("documented", F.lit(False)).alias("documented"))


@query("""with r as (select p_brand as path, case when p_type like '%' || 'STEEL' or lower(p_type) like 'e%' then 1 when p_size > 25 then 2 else 3 end role, p_partkey from part)
select path, case role when 1 then 'API' when 2 then 'Service' else 'Model' end role, p_partkey urn from (select *, row_number() over (partition by path order by role, p_partkey) k from r) where k = 1""")
def task_files_by_role(spark, d):
    part = dg.table(spark, d, "part")
    role = F.when(F.col("p_type").endswith("STEEL") | F.lower("p_type").startswith("e"), 1).when(F.col("p_size") > 25, 2).otherwise(3)
    first = graph.first_match(part.select(F.col("p_brand").alias("path"), role.alias("rank"), F.col("p_partkey").alias("urn")), ["path"], [F.col("rank"), F.col("urn")])
    return first.select("path", F.get(F.array(*map(F.lit, ("API", "Service", "Model"))), F.col("rank") - 1).alias("role"), "urn")


@query(dg.sql(""", m as (select target_urn feature, source_urn urn from edges where relationship = 'implements'), c as (select * from edges where relationship = 'calls'),
k as (select target_urn urn, count(*) callers, count(distinct path) > 1 shared from c join nodes on urn = source_urn group by 1),
f as (select feature, n.*, coalesce(callers, 0) callers, coalesce(shared, false) shared from m join nodes n using (urn) left join k using (urn)),
a as (select distinct feature, n.* from m join edges e on e.target_urn = m.urn and e.relationship = 'exposes' join nodes n on n.urn = e.source_urn),
b as (select *, row_number() over (partition by feature order by callers desc, urn) k from f where shared)
select urn feature, 'FEATURE' section, '' sort, 'FEATURE ' || name line from nodes where kind = 'feature'
union all select feature, 'ENTRY', urn, path || ':' || start_line || '-' || end_line || ' ' || name || case when shared then ' !shared(' || callers || ')' else '' end from f
union all select feature, 'API', urn, name || ' @ ' || path || ':' || start_line from a
union all select feature, 'BLAST RADIUS', printf('%04d', k), name || ' ' || path || ':' || start_line || ': ' || callers || ' callers' from b where k <= 8"""))
def brief_lines(spark, d):
    g = dg.graph(spark, d)
    return brief.brief_lines(g, g.active().where("kind = 'feature'").select(F.col("urn").alias("feature"), F.col("name").alias("title")))


@query(dg.code_sql(f""",
s as (select *, case when lower(name) in ('small gear', 'small', 'gear') then 10 else
  (case when {_hit('name', 'small')} then 5 else 0 end) + (case when {_hit('path', 'small')} then 3 else 0 end) + (case when {_hit('name', 'gear')} then 5 else 0 end) + (case when {_hit('path', 'gear')} then 3 else 0 end) end score from act),
top as (select * from s where score > 0 order by score desc, urn limit 25),
sym as (select *, row_number() over (order by score desc, urn) k from top where kind = 'symbol'),
tiers as (select *, case when name = 'small gear' then 1 when lower(name) = 'small gear' then 2 else 5 end tier from act where kind = 'symbol' and contains(lower(name), 'small gear')),
same as (select * from tiers order by tier, urn limit 1),
picked as (select k, urn, name, path, start_line, end_line, symbol_kind from sym where k <= 8
  union all select 0, urn, name, path, start_line, end_line, symbol_kind from same where urn not in (select urn from sym where k <= 8)),
u as (select * from edges where relationship in ('calls', 'imports')),
fro as (select k, a.name other from picked join u on target_urn = picked.urn join act a on a.urn = source_urn), tos as (select k, a.name other from picked join u on source_urn = picked.urn join act a on a.urn = target_urn),
n as (select k, count(*) callers from fro group by 1),
fro1 as (select k, other, row_number() over (partition by k order by other) i from (select distinct * from fro)), tos1 as (select k, other, row_number() over (partition by k order by other) i from (select distinct * from tos))
select 'SYMBOLS' section, printf('%04d.0', k) sort, path || ':' || start_line || '-' || end_line || ' ' || name || ' (' || symbol_kind || ')' || case when callers > 1 then ' !shared(' || callers || ')' else '' end line from picked left join n using (k)
union all select 'SYMBOLS', printf('%04d.1', k), 'called by: ' || string_agg(other, ', ' order by i) from fro1 where i <= 8 group by k
union all select 'SYMBOLS', printf('%04d.2', k), 'calls: ' || string_agg(other, ', ' order by i) from tos1 where i <= 8 group by k"""))
def symbol_brief(spark, d):
    return brief.symbol_lines(dg.code_graph(spark, d), "small gear")


@query(dg.sql(""", m as (select e.target_urn subject, n.urn, n.kind, n.name, n.path from edges e join nodes n on n.urn = e.source_urn where e.relationship = 'implements'
  union select i.target_urn, n.urn, n.kind, n.name, n.path from edges i join edges x on x.target_urn = i.source_urn and x.relationship = 'exposes' join nodes n on n.urn = x.source_urn where i.relationship = 'implements'),
s as (select *, row_number() over (partition by subject order by path, name, urn) k from m where kind = 'symbol'), r as (select * from m where kind = 'route'), any_route as (select distinct subject from r)
select subject, 1 phase, 'Services' title, urn, name, path from s where k <= 5
union all select subject, 2, 'Endpoints', urn, name, path from r
union all select subject, case when subject in (from any_route) then 3 else 2 end, 'Verification', null, null, null from (select distinct subject from m)"""))
def plan_phases(spark, d):
    g = dg.graph(spark, d)
    m = g.edges.where("relationship = 'implements'").select(F.col("target_urn").alias("subject"), F.col("source_urn").alias("urn"))
    x = g.edges.where("relationship = 'exposes'").select(F.col("target_urn").alias("urn"), F.col("source_urn").alias("by"))
    both = m.union(m.join(x, "urn").select("subject", "by")).distinct()
    return brief.phases(both.join(g.active().select("urn", "kind", "name", "path"), "urn").select("subject", "urn", "kind", "name", "path"))


@query(dg.sql("""
select 'node' part, to_json({'urn': urn, 'kind': kind, 'name': name, 'path': path})::varchar json from nodes
union all select 'edge', to_json({'source_urn': source_urn, 'target_urn': target_urn, 'relationship': relationship})::varchar from edges"""))
def graph_payload(spark, d):
    return brief.payload(dg.graph(spark, d))


# Facts from source files


@query(source_tree.SQL + """
select *, coalesce(scope, case when name like 'inner!_%' escape '!' and path like '%.ts' then replace(name, 'inner', 'outer') end) enclosing_scope from (
select path, 'class' kind, 'Order' || o as name, null as scope, 2 start_line, case l when 0 then b when 1 then b + 1 when 2 then 3 else b + 5 end::int end_line, true is_exported from f
union all select path, 'method', 'line_' || p, 'Order' || o, (h + 1 + e * k)::int, (h + e * (k + 1))::int, l in (0, 3) from p
union all select path, case l when 3 then 'method' else 'function' end, 'show_' || o, case l when 3 then 'Order' || o end, (b + case l when 1 then 3 when 2 then 1 else 2 end)::int, (b + case l when 0 then 3 when 1 then 5 when 2 then 3 else 4 end)::int, l <> 2 from f
union all select path, kind, name || o, null, (b + a)::int, (b + z)::int, exported from f join (values (0, 'function', 'outer_', 4, 7, true), (0, 'function', 'inner_', 5, 6, true),
  (1, 'interface', 'Line', 6, 8, true), (1, 'variable', 'table_', 9, 13, true), (1, 'function', 'outer_', 14, 19, true), (1, 'function', 'inner_', 15, 17, false), (1, 'variable', 'api_', 20, 24, true),
  (2, 'interface', 'Lines', 5, 7, true), (2, 'variable', 'Limit', 8, 8, true), (3, 'class', 'Kind', 6, 9, false)) x(l, kind, name, a, z, exported) using (l))""")
def extract_symbols(spark, d):
    return extract.symbols(source_tree.files(spark, d), hashes=False).select("path", "kind", "name", "scope", "enclosing_scope", "start_line", "end_line", "is_exported")


@query(source_tree.SQL + """
select path source_file, case l when 0 then 'shop.customers' when 1 then './customers' when 2 then 'shop/customers' else 'shop.customers.Customer' || c end module_specifier,
  case l when 2 then 'customers' else 'Customer' || c end symbol, l = 2 is_namespace, 1 line from f""")
def extract_imports(spark, d):
    found = extract.imports(source_tree.files(spark, d))
    return found.select("source_file", "module_specifier", F.explode("imported_symbols").alias("symbol"), "is_namespace", "line")


@query(source_tree.SQL + """
select path, 'GET' http_method, '/orders/' || o route_path, (b + case l when 0 then 1 when 1 then 2 when 2 then 4 else 1 end)::int line from f""")
def extract_routes(spark, d):
    return extract.routes(source_tree.files(spark, d)).select("path", "http_method", "route_path", "line")


@query(source_tree.SQL + """
select * exclude (o), 'urn:loom:symbol:' || file || '#' || case when starts_with(caller, 'line_') or (starts_with(caller, 'show_') and file like '%.java') then 'Order' || o || '.' else '' end || caller caller_urn from (
select o, path file, 'line_' || p caller, 'price_' || p callee_name, (h + 2 + e * k)::int line from p
union all select o, path, 'show_' || o, 'Order' || o, (b + case l when 0 then 3 when 1 then 4 when 2 then 2 else 3 end)::int from f
union all select o, path, null, case l when 1 then 'app.get' else 'r.Get' end, (b + case l when 1 then 2 else 4 end)::int from f where l in (1, 2)
union all select o, path, case caller when 'load' then caller else caller || o end, callee || o, (b + a)::int from f join (values (0, 'inner_', 'check_', 6), (0, 'outer_', 'inner_', 7), (1, 'inner_', 'check_', 16), (1, 'outer_', 'inner_', 18), (1, 'load', 'fetch_', 22)) x(l, caller, callee, a) using (l))""")
def extract_calls(spark, d):
    return extract.calls(source_tree.files(spark, d))


CONTEXT = """with pp as (select *, p_type || ' ' || p_size ty from part), s as (select ty f, p_partkey % 3 c, '## ' || case p_partkey % 3 when 0 then 'API Endpoints' when 1 then 'Core Services & Functions' else 'Related Tests' end || chr(10) || string_agg('- ' || p_name, chr(10) order by p_partkey, p_name) || chr(10) x from pp group by ty, p_partkey % 3),
k as (select *, ceil(length(x) / 3.3::double + 0.25 * {punct_x})::bigint n from s), h as (select distinct ty f, '# Feature Context: ' || ty || chr(10) x from pp),
p as (select f, h.x h, ceil(length(h.x) / 3.3::double + 0.25 * {punct_h})::bigint hn, a.x a, coalesce(a.n, 1000) an, v.x v, coalesce(v.n, 1000) vn, t.x t, coalesce(t.n, 1000) tn
  from h left join (from k where c = 0) a using (f) left join (from k where c = 1) v using (f) left join (from k where c = 2) t using (f)),
p1 as (select *, hn + an <= 60 ta, hn + case when hn + an <= 60 then an else 0 end s1 from p), p2 as (select *, s1 + vn <= 60 tv, s1 + case when s1 + vn <= 60 then vn else 0 end s2 from p1)
select f feature, concat_ws(chr(10), h, case when ta then a end, case when tv then v end, case when s2 + tn <= 60 then t end) context, 1 + ta::int + tv::int + (s2 + tn <= 60)::int sections from p2"""


@query(CONTEXT.format(punct_x=PUNCT_SQL.format(x="x"), punct_h=PUNCT_SQL.format(x="h.x")))
def feature_contexts(spark, d):
    part = dg.table(spark, d, "part").withColumn("ty", F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")))
    category = F.get(F.array(*map(F.lit, ("api", "services", "tests"))), (F.col("p_partkey") % 3).cast("int"))
    members = part.select(F.col("ty").alias("feature"), category.alias("category"), F.col("p_name").alias("line"), F.col("p_partkey").alias("sort"))
    return context.contexts(part.select(F.col("ty").alias("feature"), F.col("ty").alias("title")).distinct(), members, 60).select("feature", "context", "sections")
