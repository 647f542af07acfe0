"""Signal traces made of event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaf names of event types, in the order of their ids.
LEAVES = {"click": "io_valid", "view": "io_ready", "error": "io_busy", "signup": "clock", "purchase": "data"}
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def events_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timestamp (us), seq, signal_id, signal_name, value_raw: 4 modules of 5 signals."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    kinds = list(LEAVES)
    pick = lambda values: F.create_map(*(F.lit(x) for k in kinds for x in (k, values[k])))[F.col("event_type")]
    core, whole = F.col("user_id") % 4, F.floor("value").cast("long")
    value = F.when(F.col("event_type") == "purchase", whole.cast("string")).when(F.col("value") < 5, "x").otherwise((whole % 2).cast("string"))
    return e.select(
        F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)").alias("timestamp"),
        F.col("event_id").alias("seq"),
        (core * 5 + pick({k: i for i, k in enumerate(kinds)})).cast("long").alias("signal_id"),
        F.concat(F.lit("top.core"), core.cast("string"), F.lit("."), pick(LEAVES)).alias("signal_name"),
        value.alias("value_raw"),
    )


def events_signals(spark: SparkSession) -> DataFrame:
    """The dictionary of the same trace."""
    leaf = F.element_at(F.array(*map(F.lit, LEAVES.values())), (F.col("id") % 5 + 1).cast("int"))
    core = F.floor(F.col("id") / 5).cast("string")
    return spark.range(20).select(F.col("id").alias("signal_id"), F.concat(F.lit("top.core"), core, F.lit("."), leaf).alias("signal_name"))


def orders_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace with many changes at one tick: one signal for each order priority, status over days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)").alias("timestamp"),
        F.col("o_orderkey").alias("seq"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("signal_id"),
        F.when(F.col("o_orderstatus") == "O", "1").when(F.col("o_orderstatus") == "F", "0").otherwise("x").alias("value_raw"),
    )


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary with a deep hierarchy: region.nation.customer."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("signal_id"), F.concat_ws(".", F.replace("r_name", F.lit(" "), F.lit("_")), F.replace("n_name", F.lit(" "), F.lit("_")), F.replace("c_name", F.lit("#"), F.lit("_"))).alias("signal_name"))
