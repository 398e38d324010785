"""Reading and writing tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "json", "parquet")


def infer_format(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower().removeprefix(".")
    if suffix not in FORMATS:
        raise ValueError(f"unsupported dataset format: {suffix or path}")
    return suffix


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read a csv, json or parquet table and drop parser artifacts.

    JSON is line-delimited and splits over tasks; files that hold one array each need multiLine=True. Lines
    that are no object of the schema fail the job unless another mode is passed.

    Pass a schema for csv and json at scale: without one Spark scans the data to infer it.
    """
    fmt = fmt or infer_format(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported dataset format: {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options.setdefault("header", True)
        if schema is None:
            options.setdefault("inferSchema", True)
    if fmt == "json":
        options.setdefault("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return drop_empty_artifacts(reader.options(**options).load(path))


def drop_empty_artifacts(df: DataFrame, prefixes: tuple[str, ...] = ("Unnamed:", "_c")) -> DataFrame:
    """Drop columns named by the parser when every value is null. One pass, only if there are any."""
    suspects = [c for c in df.columns if c.startswith(prefixes[0]) or (c.startswith(prefixes[1]) and c[2:].isdigit())]
    if not suspects:
        return df
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in suspects]).first()
    return df.drop(*[c for c in suspects if filled[c] == 0])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a result table. Partition by low-cardinality columns such as action or day."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


#: A table in more pieces than this is never dealt anew, however many cores there are.
HANDFUL = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table that comes in a handful of pieces, fewer than there are cores, over all cores, by keys.

    A file of one row group is read by one task, and whatever is computed per row runs there. Tables of more
    files or row groups are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if pieces <= HANDFUL and pieces < cores else df
