"""Writing, reading back and folder housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "year", mode: str = "overwrite") -> None:
    """Parquet by partition column; rows are dealt by it first, so that a partition is a few files and not one a task."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(mode).partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small CSV with a header, as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_quarantine(undated: DataFrame, path: str) -> int:
    """Rows without a date, written only if there are any."""
    n = undated.count()
    if n:
        undated.write.mode("overwrite").parquet(path)
    return n


def read_back(spark: SparkSession, path: str, columns: list[str] = ()) -> DataFrame:
    """What was written, as it is on disk; an error if a column is missing."""
    df = spark.read.parquet(path)
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df


def rows_of(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Local rows as a DataFrame."""
    return spark.createDataFrame(rows, names)


def describe(df: DataFrame) -> dict:
    """Columns, types, input files and the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {"columns": df.columns, "types": dict(df.dtypes), "files": df.inputFiles(), "plan": plan}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any Hadoop file system; 0 if there is none."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def clear(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)
