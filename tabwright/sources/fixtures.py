"""Study tables derived from the TPC-H-like star schema, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import spread

OBS_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
OBS_FEATURES = ["f_qty", "f_disc", "f_tax", "f_size", "f_retail", "f_order", "f_spiky", "f_size2"]
OBS_EXEMPT = ["gender", "year_collect"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide observation table with missing cells, planted outliers and a planted signal."""
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(
        part, line.l_partkey == part.p_partkey)
    c = F.col
    return joined.select(
        *OBS_KEY,
        (c("l_orderkey") * 7919 + c("l_linenumber") * 104729 + c("l_partkey") * 31
         + c("l_suppkey")).alias("k"),
        F.when(c("l_suppkey") % 50 != 0, c("l_extendedprice") / 1000.0).alias("target"),
        F.when(c("l_linestatus") == "F", 1).otherwise(0).alias("gender"),
        F.year("o_orderdate").alias("year_collect"),
        F.when((c("l_orderkey") + c("l_linenumber")) % 13 != 0, c("l_quantity")).alias("f_qty"),
        F.when(c("l_partkey") % 41 != 0, c("l_discount")).alias("f_disc"),
        c("l_tax").alias("f_tax"),
        c("p_size").cast("double").alias("f_size"),
        c("p_retailprice").alias("f_retail"),
        c("o_totalprice").alias("f_order"),
        (c("l_quantity") * F.when(c("l_orderkey") % 97 == 0, 20.0).otherwise(1.0)).alias("f_spiky"),
        (2.0 * c("p_size") + c("l_orderkey") % 7).alias("f_size2"),
        (3.0 * c("l_quantity") - 0.5 * c("p_size") + 10.0 * c("l_tax") * c("l_tax")).alias("signal"),
    )


def binary_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("y"),
        F.col("n_chars").cast("double").alias("x_chars"), F.col("lang").alias("x_lang"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("method"), (F.col("user_id") % 10).cast("int").alias("fold")
    ).agg((-F.avg("value")).alias("error"))


def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation: every customer stands for a scored program."""
    c = F.col
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("program_id"),
        (1.0 + F.abs("c_acctbal") / 1000.0).alias("raw_fitness"),
        (c("c_nationkey") + 3).alias("length"),
        (c("c_nationkey") % 6 + 1).alias("depth"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (c("o_custkey") % 5).cast("int").alias("cluster"),
        c("o_totalprice").alias("x"), F.year("o_orderdate").alias("year_collect"),
        F.when(c("o_orderstatus") == "F", 1).otherwise(0).alias("gender"))
