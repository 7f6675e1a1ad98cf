"""The tables that queries run on, bound to the driver's Parquet tables.

predictions: lineitem with part. A data set is a part type, a splitter a brand, rep the
line number, fold the order key modulo 5, model the return flag; the internal test set are
open lines ("test") and the external benchmark the filled ones ("ips"); the observed value
is the extended price and the predicted one follows from quantity, retail price and
discount. features: the embeddings as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("dataset"),
        F.col("p_brand").alias("splitter"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linenumber").cast("int").alias("rep"),
        (F.pmod(F.col("l_orderkey"), F.lit(5)) + 1).cast("int").alias("fold"),
        (F.pmod(F.col("l_suppkey"), F.lit(3)) + 1).cast("int").alias("run"),
        F.when(F.col("l_linestatus") == "O", "test").otherwise("ips").alias("set"),
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("y_pred"),
        (F.col("l_discount") <= 0.05).alias("in_domain"),
        "l_partkey", "l_suppkey", "l_shipdate",
    )


#: The order that breaks ties between predictions of one group.
TIES = ("sample_id", "l_partkey", "l_suppkey", "l_shipdate", "y_true", "y_pred")

PREDICTIONS = """
pred AS (SELECT p_type AS dataset, p_brand AS splitter, l_returnflag AS model, l_linenumber::INT AS rep,
  (l_orderkey % 5 + 1)::INT AS fold, (l_suppkey % 3 + 1)::INT AS run, CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'ips' END AS "set",
  l_orderkey AS sample_id, l_extendedprice AS y_true, l_quantity * p_retailprice * (1 - l_discount) AS y_pred,
  l_discount <= 0.05 AS in_domain, l_partkey, l_suppkey, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))


FEATURES = """
feat AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::INT AS label FROM embeddings)"""
