"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all tasks: short rows of one small file are many in one task, which shows where each takes long."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts bound to the market tables: patient = customer, code = part type, value = quantity."""
    o, li, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("l_returnflag").alias("fact_type"),
        F.col("p_type").alias("code"),
        F.col("p_name").alias("local_text"),
        F.col("p_brand").alias("brand"),
        F.col("l_quantity").alias("value_num"),
        F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.to_date("l_shipdate").alias("effective"),
        F.col("l_linestatus").alias("state"),
    )


#: The same facts in SQL.
FACTS = """facts as (
  select l_orderkey * 10 + l_linenumber as fact_id, o_orderkey as encounter_id, o_custkey as patient_id,
         l_returnflag as fact_type, p_type as code, p_name as local_text, p_brand as brand, l_quantity as value_num,
         round(1 - l_discount, 4) as confidence, cast(l_shipdate as date) as effective, l_linestatus as state
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
