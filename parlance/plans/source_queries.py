"""Round trips through files: what the sinks write in the shared folder, the scans read back; and saved models."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from parlance.operators import models
from parlance.plans import tables as t
from parlance.shared import shared_dir
from parlance.sources import files

QUERIES, ORACLE_SQL = {}, {}


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/parlance/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def sorted_table(spark, sf_dir):
    """Orders as one CSV table in ranges of their key, with a not-a-number in a column."""
    rows = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_custkey") % 9 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"))
    path = _folder(spark)
    files.write_table(rows, path, key="o_orderkey", form="csv")
    return files.table(spark, path, "o_orderkey long, o_orderpriority string, price double")


ORACLE_SQL["sorted_table"] = "select o_orderkey, o_orderpriority, case when o_custkey % 9 > 0 then o_totalprice end as price from orders"


def table_by_language(spark, sf_dir):
    """Documents in a folder for each language."""
    path = _folder(spark)
    files.write_by(t.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


ORACLE_SQL["table_by_language"] = "select lang, count(*) as n, sum(n_chars)::bigint as n_chars from documents group by lang"


def fallback_table(spark, sf_dir):
    """A tab-separated table under the second of two names, its columns inferred."""
    path = _folder(spark)
    rows = t.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows.write.option("header", True).option("sep", "\t").csv(f"{path}/other.tsv")
    return files.first_table(spark, path, ["validated.tsv", "other.tsv"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


ORACLE_SQL["fallback_table"] = "select c_custkey::bigint as c_custkey, c_nationkey::int as c_nationkey, c_mktsegment from customer"


def norm_files(spark, sf_dir):
    """Two of four norm files, one with the names of its columns in another case, and a value that is no number."""
    path = _folder(spark)
    words = t.lexicon(spark, sf_dir)
    words.select(F.translate("word", ascii_lowercase, ascii_uppercase).alias("Word"), F.when(F.col("n_phones") > 12, "none").otherwise(F.col("n_phones").cast("string")).alias("Lg10WF")).write.option("header", True).csv(f"{path}/SUBTLEX-US.csv")
    words.select("word", (F.col("n_phones") * 0.5).alias("aoa")).write.option("header", True).csv(f"{path}/Brysbaert_AoA.csv")
    return files.norms(spark, path)


ORACLE_SQL["norm_files"] = f"with {t.LEXICON} select 'freq' as kind, word, n_phones::double as value from lx where n_phones <= 12 union all select 'aoa', word, n_phones * 0.5::double from lx"


def listed_names(spark, sf_dir):
    """Documents of the sources that a list of names has, which also has blank lines and comments."""
    path = _folder(spark)
    source = t.read(spark, sf_dir, "documents").select("source").filter("source is not null").distinct()
    source.select(F.explode(F.array(F.concat(F.lit("  "), "source", F.lit(" ")), F.lit(""), F.concat(F.lit("# not "), "source"))).alias("value")).write.text(path)
    found = files.name_list(spark, path).distinct()
    return t.read(spark, sf_dir, "documents").join(found, F.col("source") == F.col("name")).groupBy("name").agg(F.count("*").alias("n"))


ORACLE_SQL["listed_names"] = "select source as name, count(*) as n from documents where source is not null group by source"


def saved_model(spark, sf_dir):
    """Predictions of a linear model that was saved and loaded again."""
    rows = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    path = _folder(spark)
    models.save(models.pipeline(["l_quantity"], models.estimator("ridge")[0], "l_extendedprice").fit(rows), path)
    (again,) = models.load_all([path])
    return again.transform(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "prediction")


ORACLE_SQL["saved_model"] = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, b + a * l_quantity as prediction
from lineitem, (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem)"""


def out_of_fold(spark, sf_dir):
    """Errors by fold of a linear model that has not seen the fold; orders without a fold train only."""
    rows = t.read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.when(F.col("l_orderkey") % 5 < 4, (F.col("l_orderkey") % 5).cast("int")).alias("fold"))
    found = models.out_of_fold(rows, ["l_quantity"], "l_extendedprice", "ridge", 4)
    return found.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("l_extendedprice"))).alias("mae"))


ORACLE_SQL["out_of_fold"] = """with r as (select l_extendedprice as y, l_quantity as x, case when l_orderkey % 5 < 4 then (l_orderkey % 5)::int end as fold from lineitem),
m as (select f.fold, regr_slope(y, x) as a, regr_intercept(y, x) as b from r, (select unnest([0, 1, 2, 3]) as fold) f where r.fold is distinct from f.fold group by f.fold)
select r.fold, count(*) as n, avg(abs(b + a * x - y)) as mae from r join m on m.fold = r.fold group by r.fold"""

QUERIES |= {f.__name__: f for f in (sorted_table, table_by_language, fallback_table, norm_files, listed_names, saved_model, out_of_fold)}
