"""The queries of the corpus operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontamination, hard_negatives, language, mixing, near_dedup, packing, pii, repair, sharding, token_counts, url_filter
from .common import SECOND_LEVEL, for_documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared language is ``lang``. Documents have no address, so no suffix; their source, a name without dots, stands for the host."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs), columns=["doc_id"]).select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over raw pages: markup's language, address suffix and host."""
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.identify(pages, model, host="host", suffix="suffix", columns=["page_id"]).select("page_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def op2_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its number; bad: of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes)


def op6_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and number -1, whose texts look like another template's marks."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(rows.unionByName(more))


def op10_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number is divisible by 7 count with the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_entropy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations after damage by a checksum of their numbers: rows lost, emptied, cut, said twice, or under a wrong role."""
    rows = table(spark, sf_dir, "conversations")
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    damaged = rows.withColumns({"text": text, "role": role, "times": times})
    return repair.repair(damaged, F.col("harm") != 0)


def _tuned(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for_documents(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _tuned(f)
    for f in (
        op1_language_id,
        op2_proportional_shards,
        op3_personal_data,
        op4_multiprobe_neighbours,
        op5_url_reputation,
        op6_balanced_packing,
        op7_token_counts,
        op8_decontamination,
        op9_chat_windows,
        op10_bagminhash_dedup,
        op11_hard_negatives,
        op12_entropy_mixture,
        op13_conversation_repair,
        language_of_pages,
    )
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_OP8 = f"""
with d as (select doc_id, coalesce({_WORDS.format("text")}, []) ws from documents), b as (select item_id, {_WORDS.format("text")} ws from benchmark where text is not null),
win as (select distinct item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') w from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from (select *, least(10, len(ws)) n from b where len(ws) > 0))),
sizes as (select distinct n from win), dw as (select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes where len(ws) >= n)),
hits as (select distinct doc_id, item_id, i, dw.n from dw join win using (n, w)), places as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
names as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from hits) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join places using (doc_id) left join names using (doc_id)"""

_LEVEL = """
{name}_m as (select g.*, {above} mean from {groups} g {join}),
{name}_w as (select greatest(2.0, least(200.0, coalesce(case when spread > noise then (size - spread) / (spread - noise) else 200.0 end, 200.0))) weight
  from (select sum(n * (bad / n::double - mean) * (bad / n::double - mean)) / sum(n) spread, sum(mean * (1 - mean)) / sum(n) noise, sum(mean * (1 - mean) * n) / sum(n) size from {name}_m)),
{name}_p as (select {key}, weight * mean + bad a, weight * (1 - mean) + n - bad b from {name}_m, {name}_w)"""
_BOUND = "{t}a / ({t}a + {t}b) - 1.64 * sqrt({t}a * {t}b / (({t}a + {t}b) * ({t}a + {t}b) * ({t}a + {t}b + 1)))"

SQL_OP5 = (
    r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
o as (select regexp_replace(regexp_replace(p.host, '(?s)^.*@', ''), ':[0-9]*$', '') host, case when quality = 0 or toxic = 1 then 1 else 0 end bad from p join labels on doc_id = page_id),
names as (select distinct host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') as name from p), labelled as (select *, string_split(name, '.') l, array_to_string(list_slice(l, -2, -1), '.') last_two from names),
parts as (select host, name, case when last_two in ({known}) then array_to_string(list_slice(l, -3, -1), '.') else last_two end domain, case when last_two in ({known}) then last_two else l[-1] end suffix from labelled),
h as (select o.host, any_value(domain) domain, any_value(suffix) suffix, count(*) n, sum(bad) bad from o join (select distinct name, domain, suffix from parts) x on o.host = x.name group by 1),
d as (select domain, suffix, sum(n) n, sum(bad) bad from h group by all), s as (select suffix, sum(n) n, sum(bad) bad from h group by 1),
whole as (select coalesce(sum(bad), 0) + 0.5::double a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 0.5::double b from h),""".replace("{known}", ", ".join(f"'{x}'" for x in SECOND_LEVEL))
    + _LEVEL.format(name="s", above="whole.a / (whole.a + whole.b)", groups="s", join=", whole", key="suffix")
    + ","
    + _LEVEL.format(name="d", above="s_p.a / (s_p.a + s_p.b)", groups="d", join="join s_p using (suffix)", key="domain, suffix")
    + ","
    + _LEVEL.format(name="h", above="d_p.a / (d_p.a + d_p.b)", groups="h", join="join d_p using (domain)", key="host")
    + f""",
bounds as (select parts.host, coalesce({_BOUND.format(t="h_p.")}, {_BOUND.format(t="d_p.")}, {_BOUND.format(t="s_p.")}, {_BOUND.format(t="whole.")}) bound
  from parts left join h_p on h_p.host = parts.name left join d_p on d_p.domain = parts.domain left join s_p on s_p.suffix = parts.suffix, whole),
r(verdict, h, x) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled as (select page_id, host, path, h || x as rule, verdict, row_number() over (partition by page_id order by length(h || x) desc nulls last) k from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, x))
select page_id, host, path, rule, coalesce(verdict, case when bound > 0.2 then 'block' else 'allow' end) verdict, round(bound, 9) bad_bound from ruled join bounds using (host) where k = 1"""
)

_ESC = r"replace(replace({}, '\', '\b'), '|', '\p')"
SQL_OP9 = f"""
with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, row_number() over (partition by conv_id order by turn, role, text) i, length(replace({_ESC.format("role")}, '<', '\\l')) + length({_ESC.format("text")}) + 11 written, ceil(length({_ESC.format("text")}) / 4.0)::bigint + 4 n from c),
u as (select *, sum(n) over (partition by conv_id order by i) s, first_value(role) over (partition by conv_id order by i) = 'system' sys, first_value(n) over (partition by conv_id order by i) n1 from t),
w(conv_id, start, before) as (select conv_id, 1::bigint, 0::hugeint from u where i = 1 union all
  select conv_id, i, s - n from (select u.*, row_number() over (partition by u.conv_id, start order by i) k from w join u on u.conv_id = w.conv_id and i > start and s - before > greatest(1, 384 - case when sys then n1 else 0 end)) where k = 1),
rep as (select w.conv_id, sum(written) extra from w join u on u.conv_id = w.conv_id and i < start and ((sys and i = 1) or (before - (s - n) <= 128)) group by 1)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) loss_sha256, (sum(written) + coalesce(any_value(extra), 0))::bigint formatted_chars from u left join rep using (conv_id) group by conv_id"""

SQL_OP11 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) y from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_inner_product(a.y, b.y)::bigint score from r a join r b on a.vec_id <> b.vec_id and a.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id negative_id, positive_score, score negative_score
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select * from n where rank <= 5"""

#: op2 and op7 need a checksum or tokenizer that SQL lacks; op1, op3, op4, op6 and op10 models, transducers or signatures. Tests hold these against plain versions.
SQL: dict[str, str] = {"op5_url_reputation": SQL_OP5, "op8_decontamination": SQL_OP8, "op9_chat_windows": SQL_OP9, "op11_hard_negatives": SQL_OP11}
