"""Readers for the file kinds the jobs take. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.schemas import ID_MAP, WEIGHT, assert_schema


# Type name, then EMPTY or coordinates in one pair of parentheses or more.
_GEOMETRY = r"(?i)^\s*(?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s*(?:EMPTY|\([-+0-9.e,()\s]+\))\s*$"


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",") -> DataFrame:
    """Headerless delimited files bound to a schema by position."""
    return spark.read.schema(schema).option("sep", delimiter).csv(path)


def read_parquet_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet whose declared columns must be there; further columns are kept."""
    return assert_schema(spark.read.parquet(path), schema)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "avro") -> DataFrame:
    """Any self-describing format, checked like parquet. Avro needs Spark's avro module on the class path."""
    return assert_schema(spark.read.format(fmt).load(path), schema)


def read_default(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.load(path)


def read_csv_header(spark: SparkSession, path: str, schema: T.StructType = ID_MAP) -> DataFrame:
    """Headered csv; columns are matched to the schema by the header's names."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Headerless agent, weight; the weight stays text until ``weight_number``."""
    return spark.read.schema(WEIGHT).csv(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_wkt_table(
    spark: SparkSession, path: str, wkt_column: int, delimiter: str = "\t", skip_invalid: bool = False
) -> DataFrame:
    """Delimited text with a WKT column at a 0-based position, as ``wkt`` and ``user_data``.

    The other columns, tab-separated, are the geometry's user data. A line without a known geometry fails the
    query unless ``skip_invalid``.
    """
    return wkt_table(spark.read.text(path), wkt_column, delimiter, skip_invalid)


def wkt_table(lines: DataFrame, wkt_column: int, delimiter: str = "\t", skip_invalid: bool = False) -> DataFrame:
    parts = F.split("value", _literal(delimiter), -1)
    rest = F.filter(parts, lambda _, i: i != wkt_column)
    found = lines.select(F.get(parts, F.lit(wkt_column)).alias("wkt"), F.array_join(rest, "\t").alias("user_data"))
    valid = F.coalesce(F.col("wkt").rlike(_GEOMETRY), F.lit(False))
    if skip_invalid:
        return found.where(valid)
    refuse = F.raise_error(F.concat(F.lit("not a geometry: "), F.coalesce(F.substring("wkt", 1, 60), F.lit("null"))))
    return found.withColumn("wkt", F.when(valid, F.col("wkt")).otherwise(refuse.cast("string")))


def _literal(text: str) -> str:
    """A split pattern that matches the text itself."""
    return "\\Q" + text + "\\E"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def resolve_dated(
    spark: SparkSession, roots: Sequence[str], date: str, module: str = "lbs", layout: str = "{root}/{module}/{date}"
) -> str | None:
    """The first root that holds the dataset's folder for a date, else None. Roots go from most to least wanted."""
    for root in roots:
        path = layout.format(root=root.rstrip("/"), module=module, date=date)
        if path_exists(spark, path):
            return path
    return None


def read_dated(
    spark: SparkSession,
    roots: Sequence[str],
    date: str,
    module: str = "lbs",
    fmt: str = "parquet",
    layout: str = "{root}/{module}/{date}",
) -> DataFrame:
    path = resolve_dated(spark, roots, date, module, layout)
    if path is None:
        raise FileNotFoundError(f"no {module} folder for {date} under {', '.join(roots)}")
    return spark.read.format(fmt).load(path)


def read_days(
    spark: SparkSession, path: str, schema: T.StructType | str, first: str, last: str | None = None, *, day: str = "date", fmt: str = "parquet", **options
) -> DataFrame:
    """The days from ``first`` to ``last`` (default: ``first`` alone) of a table of ``write_days``; other days' folders are not read.

    ``schema`` names the columns with the day, which is text.
    """
    rows = spark.read.schema(schema).format(fmt).options(**options).load(path)
    return rows.where(F.col(day).between(first, last or first))
