"""Report and enrichment tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.schema import (
    ACCEPT,
    AMOUNT,
    CUSTOMER,
    MONEY,
    ORDER,
    PRODUCT,
    QUOTE,
    REP,
    REQUEST,
    SEQ,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _null_every(n: int, value):
    """``value``, but null on every n-th order."""
    return F.when(F.col("o_orderkey") % n != 0, value)


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes from ``orders``: each once, every seventh with a second payment row.

    Parts and suppliers are dealt to the orders in turn, all of them: their keys rise from 0
    without holes.
    """
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    parts, suppliers = max(part.count(), 1), max(supplier.count(), 1)
    key = F.col("o_orderkey")
    closed = F.col("o_orderstatus") != "P"
    hours = F.make_dt_interval(hours=((key * 37) % 720).cast("int"))
    suffix = F.when(key % 3 == 0, "-A").otherwise("")
    payments = F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        orders.join(part, F.col("p_partkey") == key % parts)
        .join(supplier, F.col("s_suppkey") == key % suppliers)
        .withColumn("part_no", F.explode(payments))
        .select(
            (key * 10 + F.col("part_no")).cast("bigint").alias(SEQ),
            _null_every(211, key.cast("string")).alias(QUOTE),
            F.col("o_orderdate").cast("timestamp_ntz").alias(REQUEST),
            F.when(closed, F.col("o_orderdate").cast("timestamp_ntz") + hours).alias(ACCEPT),
            F.concat(F.lit("Custom "), "p_name").alias(PRODUCT),
            F.when(closed, F.concat((key - key % 2).cast("string"), suffix)).alias(ORDER),
            _null_every(97, F.col("o_custkey")).alias(CUSTOMER),
            F.when(closed, F.col("o_totalprice").cast(MONEY)).alias(AMOUNT),
            _null_every(11, F.col("s_name")).alias(REP),
        )
    )


def enrichment(spark: SparkSession, folder: str, all_customers: bool = False) -> DataFrame:
    """Attributes of four customers in five: the fifth is for the rows of a left join that
    meet nothing."""
    customer = table(spark, folder, "customer")
    if not all_customers:
        customer = customer.filter(F.col("c_custkey") % 5 != 0)
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("c_custkey").alias(CUSTOMER),
            F.col("c_mktsegment").alias("industry_category"),
            F.col("n_name").alias("industry_sub_category"),
            F.floor(F.col("c_acctbal") / 2000).cast("string").alias("range_employees"),
            F.col("r_name").alias("range_revenue"),
        )
    )


def event_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as quotes with a strict time order."""
    paid = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0)
    return table(spark, folder, "events").select(
        F.col("event_id").alias(SEQ),
        F.col("event_id").cast("string").alias(QUOTE),
        F.col("ts").cast("timestamp_ntz").alias(REQUEST),
        F.col("user_id").alias(CUSTOMER),
        F.col("props").alias(PRODUCT),
        paid.cast(MONEY).alias(AMOUNT),
    )
