"""Readers: headered CSV by name, comma text by position, the click log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.sources.records import PLACE, read_records

# fixed values: the columns of the click log, in file order
CLICK_LOG_COLUMNS = [
    "id", "click", "hour", "C1", "banner_pos",
    "site_id", "site_domain", "site_category",
    "app_id", "app_domain", "app_category",
    "device_id", "device_ip", "device_model", "device_type", "device_conn_type",
    "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21",
]

CLICK_LOG_LABEL = "click"

CLICK_LOG_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == CLICK_LOG_LABEL else T.StringType())
        for c in CLICK_LOG_COLUMNS
    ]
)

# stands for a missing field while reading, so that a quoted empty text stays an empty text
_MISSING = "\0"

CLICK_LOG_FEATURES = [c for c in CLICK_LOG_COLUMNS if c != CLICK_LOG_LABEL]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, *, multi_line: bool = False
) -> DataFrame:
    """Headered CSV with quoted fields and doubled quotes; a bad number is an error.

    ``multi_line`` allows line breaks inside quotes; files are split over tasks all the same, behind one scan
    that counts quotes.
    """
    if multi_line:
        return _parsed(read_records(spark, path), schema, [])
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("nullValue", _MISSING)
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )


def read_by_name(spark: SparkSession, path: str, *, place: bool = False) -> DataFrame:
    """Headered CSV whose columns are taken by name, all as text; the first file's header names them.

    Quoted fields may hold line breaks, and a row that does not fit the header is an error. With ``place`` the
    rows carry where they stand, for ``sources.records.numbered``.
    """
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return _parsed(read_records(spark, path), schema, PLACE if place else [])


def _parsed(records: DataFrame, schema: T.StructType | str, keep: Sequence[str]) -> DataFrame:
    """Records below the header as columns."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    options = {"escape": '"', "nullValue": _MISSING, "mode": "FAILFAST"}
    below = records.where("_block > 0 OR _place > 0")
    return below.select(*keep, F.from_csv("record", ddl, options).alias("_fields")).select(*keep, "_fields.*")


def read_click_log(spark: SparkSession, path: str) -> DataFrame:
    """The 24-column click log; blank categories come as NULL and count as the category ''."""
    return read_csv(spark, path, CLICK_LOG_SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in the column ``value``; the number of partitions follows from the file sizes."""
    return spark.read.text(path)


def split_fields(lines: DataFrame, column: str = "value", out: str = "fields") -> DataFrame:
    """Plain comma split of each line, no quoting, into an array of text addressed by position."""
    return lines.withColumn(out, F.split(F.col(column), ","))


def field(position: int, type_: str = "string", fields: str = "fields", strict: bool = True) -> Column:
    """One field by 0-based position, parsed; bad text is an error, or NULL when not ``strict``."""
    text = F.get(F.col(fields), F.lit(position))
    return text.cast(type_) if strict else text.try_cast(type_)


def parse_lines(
    lines: DataFrame, columns: Sequence[tuple[str, str]], column: str = "value", strict: bool = True
) -> DataFrame:
    """Comma lines to named, typed columns given as (name, type) in field order."""
    others = [c for c in lines.columns if c != column]
    return split_fields(lines, column, "_fields").select(
        *others,
        *[field(i, t, "_fields", strict).alias(name) for i, (name, t) in enumerate(columns)],
    )


def join_fields(*columns: Column) -> Column:
    """Comma line of the given columns; missing values become empty fields."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
