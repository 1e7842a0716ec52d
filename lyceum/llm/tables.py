"""Staged tables, joins behind a size check, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.sources.staging import stage

#: A side is broadcast when it has at most this many bytes by its row count; beyond, both sides shuffle.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of one Arrow batch: some MB of ordinary texts on either side of a worker's pipe.
ARROW_ROWS = 1_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for texts.  A session that has set a size of its own
    below Spark's default keeps it."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW)) <= ARROW_ROWS:
        conf.set(_ARROW, str(ARROW_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` (a staged or stored table) with a broadcast hint if its counted rows fit, else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of finished steps: it acts on what the JVM has collected."""
    spark.sparkContext._jvm.System.gc()


#: Edges of a written file, and files at least.
FILE_ROWS, MIN_FILES = 200_000, 8
#: Bytes of a row of nodes and minima, at most; nodes are numbers or short digests.
NODE_BYTES = 96


def _stars(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step on ``count`` undirected edges ``(a, b)``; minima by aggregation, so a hub is pre-aggregated.  While the minima are
    few they go to the edges, which then need no shuffle."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.filter("b < a")
    least = side.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
    few = 2 * count * NODE_BYTES <= BROADCAST_BYTES  # two nodes an edge at most
    joined = side.join(F.broadcast(least) if few else least, side.a == least.n)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each pair of steps written once.
    A round's checksum tells when nothing changes.
    """

    def step(df: DataFrame, count: int) -> DataFrame:
        # A large-star step keeps the number of edges or lowers it.
        out = _stars(_stars(df, True, count), False, count)
        return stage(out.coalesce(max(MIN_FILES, -(-count // FILE_ROWS))), label)

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = mark(now)
    while before[0]:
        now = step(now, before[0])
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
