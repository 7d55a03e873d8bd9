"""Merges, censuses and summaries over the star schema and documents with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.stats import floored_ratio, safe_div
from parlance.operators import merge
from parlance.plans import tables as t
from parlance.sources.files import numeric

QUERIES, ORACLE_SQL = {}, {}


def _labelled(spark, sf_dir, how="left"):
    return t.read(spark, sf_dir, "documents").drop("text").join(t.read(spark, sf_dir, "labels"), "doc_id", how)


def merge_inner(spark, sf_dir):
    """Features that name a language and a group too, which the metadata wins."""
    features = t.read(spark, sf_dir, "labels").withColumns({"lang": F.lit("zz"), "source": F.lit("none")})
    return merge.merge(features, t.read(spark, sf_dir, "documents").drop("text"), "doc_id", prefer="right").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


ORACLE_SQL["merge_inner"] = "select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id)"


def merge_chain(spark, sf_dir):
    base = t.read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    orders = t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("c_acctbal"))
    extra = t.read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_p"))
    return merge.merge_all(base, [(orders, "inner"), (extra, "left")], "k").select("k", "c_mktsegment", "c_acctbal", "n_orders", "n_p")


ORACLE_SQL["merge_chain"] = """select c_custkey as k, c_mktsegment, c_acctbal, n_orders, n_p from customer join (select o_custkey, count(*) as n_orders from orders group by 1) o on c_custkey = o.o_custkey
left join (select o_custkey, count(*) as n_p from orders where o_orderstatus = 'P' group by 1) p on c_custkey = p.o_custkey"""


def merge_left_coverage(spark, sf_dir):
    return merge.coverage(_labelled(spark, sf_dir), "quality")


ORACLE_SQL["merge_left_coverage"] = "select count(*) as n_rows, count(quality) as n_found, avg((quality is not null)::int) as share from documents left join labels using (doc_id)"


def key_intersection(spark, sf_dir):
    return merge.common_keys(t.read(spark, sf_dir, "documents"), t.read(spark, sf_dir, "labels"), "doc_id")


ORACLE_SQL["key_intersection"] = "select doc_id from documents intersect select doc_id from labels"


def missing_partner(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents")
    return merge.missing_partners(d, {"labels": t.read(spark, sf_dir, "labels"), "good": t.read(spark, sf_dir, "labels").filter("quality = 1")}, "doc_id")


ORACLE_SQL["missing_partner"] = """select 'labels' as partner, count(*) as n_missing from documents where doc_id not in (select doc_id from labels)
union all select 'good', count(*) from documents where doc_id not in (select doc_id from labels where quality = 1)"""


def null_census(spark, sf_dir):
    return merge.null_census(_labelled(spark, sf_dir), ["lang", "source", "n_chars", "quality", "toxic"])


ORACLE_SQL["null_census"] = "with j as (select * from documents left join labels using (doc_id)) " + " union all ".join(f"select '{c}' as column, count(*) filter (where {c} is null) as n_null, count(*) as n_rows from j" for c in ("lang", "source", "n_chars", "quality", "toxic"))


def value_counts(spark, sf_dir):
    return merge.value_counts(_labelled(spark, sf_dir), "quality")


ORACLE_SQL["value_counts"] = "select quality, count(*) as n from documents left join labels using (doc_id) group by quality"


def top_values(spark, sf_dir):
    return merge.value_counts(t.read(spark, sf_dir, "orders"), "o_custkey", 10)


ORACLE_SQL["top_values"] = "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10"


def group_summary(spark, sf_dir):
    return merge.group_summary(t.read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 4500)


ORACLE_SQL["group_summary"] = """select c_mktsegment, count(c_acctbal) as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as std, min(c_acctbal) as min, max(c_acctbal) as max,
case when avg(c_acctbal) >= 4500 then 'control range' else 'below control range' end as verdict from customer group by 1"""


def corpus_totals(spark, sf_dir):
    return merge.corpus_totals(t.read(spark, sf_dir, "documents"), "lang", "n_chars")


ORACLE_SQL["corpus_totals"] = "select lang, count(*) as n, sum(n_chars) / 3600.0::double as hours, avg(n_chars) as mean_sec from documents group by rollup (lang)"


def largest_per_stem(spark, sf_dir):
    files = t.read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "n_chars")
    return merge.largest_per_stem(files, "source", "path", "n_chars")


ORACLE_SQL["largest_per_stem"] = "select source, arg_max(doc_id::varchar, (n_chars, doc_id::varchar)) as path, max(n_chars) as n_chars from documents group by source"


def first_per_stem(spark, sf_dir):
    return merge.first_per_stem(t.read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path")), "source", "path")


ORACLE_SQL["first_per_stem"] = "select source, min(doc_id::varchar) as path from documents group by source"


def prefix_match(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.col("source").alias("a"))
    b = t.read(spark, sf_dir, "documents").select(F.concat("source", F.lit("0")).alias("b")).union(t.read(spark, sf_dir, "documents").select("lang"))
    return merge.prefix_matches(d, b, "a", "b")


ORACLE_SQL["prefix_match"] = """with a as (select distinct source as a from documents), b as (select source || '0' as b from documents union select lang from documents)
select a, b from a, b where starts_with(a, b) or starts_with(b, a)"""


def role_routing(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    group = F.when(F.col("quality") == 1, "control").when(F.col("quality") == 0, "pwa")
    return rows.groupBy(merge.role(group, F.col("lang")).alias("role")).agg(F.count("*").alias("n"))


ORACLE_SQL["role_routing"] = """select case when quality = 1 and lang = 'en' then 'control' when quality = 0 and lang = 'en' then 'train' when quality = 0 then 'external_' || lang end as role, count(*) as n
from documents left join labels using (doc_id) group by 1"""


def duration_band(spark, sf_dir):
    return merge.in_duration_band(t.read(spark, sf_dir, "events"), "value", 20.0, 300.0)[1]


ORACLE_SQL["duration_band"] = "select count_if(value between 20 and 300)::bigint as n_kept, count_if(not coalesce(value between 20 and 300, false))::bigint as n_skipped from events"


def vote_filter(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("up"), F.pmod("o_custkey", F.lit(4)).alias("down"))
    return rows.filter(merge.good_votes(F.col("up"), F.col("down")))


ORACLE_SQL["vote_filter"] = "select o_orderkey, o_orderkey % 5 as up, o_custkey % 4 as down from orders where o_orderkey % 5 >= 1 and o_custkey % 4 <= o_orderkey % 5"


def numeric_coercion(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract("o_orderpriority", "^(.)-?", 1).alias("v"))
    return numeric(rows, ["v"], 0.0)


ORACLE_SQL["numeric_coercion"] = "select o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^(.)-?', 1) as double), 0) as v from orders"


def safe_ratios(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem")
    d = F.col("l_linenumber") - 3
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", safe_div(F.col("l_quantity"), d).alias("safe"), floored_ratio(F.col("l_quantity"), d.cast("double")).alias("floored"))


ORACLE_SQL["safe_ratios"] = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber > 3 then l_quantity / (l_linenumber - 3) end as safe,
l_quantity / greatest((l_linenumber - 3)::double, 1e-6::double) as floored from lineitem"""


def patched_groups(spark, sf_dir):
    rows = merge.patched(t.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", [1, 5, 9], "c_mktsegment", "pwa")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


ORACLE_SQL["patched_groups"] = "select case when c_custkey in (1, 5, 9) then 'pwa' else c_mktsegment end as c_mktsegment, count(*) as n from customer group by 1"


def top_rows(spark, sf_dir):
    return merge.top(t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")], 25)


ORACLE_SQL["top_rows"] = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_partkey limit 25"


def union_with_controls(spark, sf_dir):
    rows = _labelled(spark, sf_dir, "inner").select("doc_id", "lang", "quality")
    return rows.filter("quality = 0 and lang = 'en'").unionByName(rows.filter("quality = 1").drop("lang"), allowMissingColumns=True)


ORACLE_SQL["union_with_controls"] = "select doc_id, lang, quality from documents join labels using (doc_id) where quality = 0 and lang = 'en' union all select doc_id, null, quality from documents join labels using (doc_id) where quality = 1"

QUERIES |= {f.__name__: f for f in (merge_inner, merge_chain, merge_left_coverage, key_intersection, missing_partner, null_census, value_counts, top_values, group_summary, corpus_totals, largest_per_stem, first_per_stem, prefix_match, role_routing, duration_band, vote_filter, numeric_coercion, safe_ratios, patched_groups, top_rows, union_with_controls)}
