"""The driver's star-schema tables as frames of the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def support_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): a customer supports each supplier from whom it returned a line."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label, rejected): suppliers; those in debt stand for rejected entities."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.lower("s_name").alias("label"), (F.col("s_acctbal") < 0).alias("rejected"))


def fingerprint_sql(digest: str) -> str:
    """DuckDB SQL of hashing.fingerprint over rows of which ``digest`` is the SHA-256 of their JSON."""
    return "sha256(concat_ws(':', count(*), " + ", ".join(f"sum(('0x' || substr({digest}, {a}, 15))::BIGINT::HUGEINT)" for a in (1, 16, 31, 46)) + "))"
