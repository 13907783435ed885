"""Views of the benchmark tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.options import ColumnRoles
from clickloom.session import spread
from clickloom.sources.sinks import write_csv
from clickloom.sources.text import CLICK_LOG_COLUMNS, CLICK_LOG_FEATURES, CLICK_LOG_LABEL

EVENT_FEATURES = ["event_id", "hour", "user_id", "k"]

EVENT_ROLES = ColumnRoles("click", "event_id", (), ("hour", "user_id", "k"))

ORDER_ROLES = ColumnRoles(
    "finished", "o_orderkey", ("o_totalprice",), ("o_orderpriority", "c_mktsegment", "c_nationkey")
)

LINEITEM_FEATURES = [
    "l_suppkey",
    "l_partkey",
    "l_linestatus",
    "l_linenumber",
    "l_quantity",
    "l_discount",
    "l_tax",
    "month",
]

# days of the month per training batch of the click events
BATCH_DAYS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a click log: the label, categories hour / user / k, one number, a training batch.

    The event type is the label and therefore never a feature.
    """
    day = F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        (F.col("event_type") == "click").cast("int").alias("click"),
        F.hour("ts").alias("hour"),
        "user_id",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"),
        "value",
        F.floor((day - 1) / BATCH_DAYS).cast("int").alias("batch"),
    )


# values of each made-up category of the click log, from few to many
_CLICK_LOG_VALUES = {c: 2 + 5 * k for k, c in enumerate(CLICK_LOG_FEATURES)}


def click_log_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write ``events`` as a CSV of the 24 columns of the click log: own id, label and hour, other categories from
    the user and the event; an empty field now and then."""
    log = click_events(spark, sf_dir)
    made = {"id": F.col("event_id").cast("string"), "hour": F.col("hour").cast("string"), CLICK_LOG_LABEL: F.col("click")}
    for c, values in _CLICK_LOG_VALUES.items():
        number = F.expr(f"(user_id * {values} + event_id) % {values}")
        made.setdefault(c, F.when(number > 0, F.concat(F.lit("v"), number)))
    log = spread(log, log.count())
    write_csv(log.select(*[made[c].alias(c) for c in CLICK_LOG_COLUMNS]), path)


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a scored table: a probability from the value column, and its rounded class."""
    return click_events(spark, sf_dir).select(
        "event_id",
        "ts",
        "click",
        (F.col("value") / 500).alias("probability"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("prediction"),
    )


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and nation; the label is whether the order is finished."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")


def returned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with the label whether the item was returned."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        *[c for c in LINEITEM_FEATURES if c != "month"],
        F.month("l_shipdate").alias("month"),
    )
