"""Scans: CSV and JSON landing files, tables, JDBC and Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyceum.functions.text import blank_to_null


CORRUPT = "corrupt_record"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = False, keep_corrupt: bool = False
) -> DataFrame:
    """Landing CSV: header row, comma, double quote; ``NULL``, ``null`` and empty fields are NULL.

    ``path`` may be a file, a folder or a glob.  The schema is given, so no pass is spent on
    inference, and fields that do not parse become NULL; ``keep_corrupt`` adds the whole line of such a
    row in ``corrupt_record``, for the quarantine.  ``multi_line`` reads quoted line breaks; such
    files are not split between tasks, so leave it off for large files without them.
    """
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    rows = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return blank_to_null(rows)


def read_json(spark: SparkSession, path: str, schema: T.StructType, *, outer_array: bool = True) -> DataFrame:
    """JSON files; with ``outer_array`` each file is one array, otherwise one object per line.

    A file that is one array cannot be split between tasks, so large feeds should use lines.
    """
    return spark.read.schema(schema).option("multiLine", outer_array).json(path)


def read_table(spark: SparkSession, name: str, fmt: str | None = None, **options: str) -> DataFrame:
    """A catalog table, or a path or external table when ``fmt`` names a data source."""
    if fmt is None:
        return spark.table(name)
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if "dbtable" in options or "query" in options else reader.load(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """Database table; give ``split_on`` and ``bounds`` to read a large one in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on and bounds:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def read_kafka(spark: SparkSession, servers: str, topic: str, *, starting: str = "latest") -> DataFrame:
    """Kafka topic as a stream; needs the Kafka connector on the cluster."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", "false")
        .load()
    )


def query(spark: SparkSession, sql: str, **params: object) -> DataFrame:
    """SQL with named parameters (``:name``), bound as literals and never spliced into the text."""
    return spark.sql(sql, args=params)


def parse_payload(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Message bytes in ``value`` -> one column per JSON field."""
    return records.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")
