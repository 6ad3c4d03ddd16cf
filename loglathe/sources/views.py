"""Other tables seen as events, sessions and parts, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time at which ages are taken; no operator reads the clock.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, uid, role, kind, raw of conversation turns."""
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "say").otherwise("note")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("uid"), "role", kind.alias("kind"), F.col("text").alias("raw"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, uid, ts, kind, raw, tokens of a user's actions, numbered by time."""
    kind = F.when(F.col("event_type") == "signup", "prompt").when(F.col("event_type").isin("view", "click"), "say").when(F.col("event_type") == "purchase", "tool").otherwise("fail")
    raw = F.concat_ws(" ", "event_type", F.col("value").cast("decimal(18,2)").cast("string"))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("uid"), "ts", kind.alias("kind"), raw.alias("raw"), (F.col("event_id") % 50).alias("tokens"))


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, last_ts, bytes, replaceable of orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_ts"), F.round("o_totalprice").cast("long").alias("bytes"), (F.col("o_orderstatus") == "F").alias("replaceable"))


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project, tag of customers."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("tag"))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lineitems as parts (message, n, updated, data) and orders as messages (message, session, role)."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("updated"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("data"))
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message"), F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") == "F", "user").otherwise("assistant").alias("role"))
    return p, m
