"""Raw CSV reports in canonical columns, under declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.text import decode_percent, normalize_text, parse_date

CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false", "mode": "PERMISSIVE"}


def _csv(spark: SparkSession, schema, paths) -> DataFrame:
    return spark.read.options(**CSV).schema(schema).csv([paths] if isinstance(paths, str) else list(paths))


def _canonical(df: DataFrame, columns: dict[str, Column], source: str) -> DataFrame:
    """Columns that a source lacks are typed nulls."""
    known = columns | {"source_dataset": F.lit(source), "data_source": F.lit("real")}
    return df.select(*((known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CANONICAL))


def read_daily(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Source 1: a path, glob or list of them."""
    text = {c: normalize_text(F.col(c.capitalize())) for c in S.DIMENSIONS}
    prices = {f"{c}_price": F.col(f"{c.capitalize()}_Price") for c in ("min", "max", "modal")}
    return _canonical(_csv(spark, S.RAW_DAILY, paths), text | prices | {"arrival_date": parse_date(F.col("Arrival_Date"), "yyyy-MM-dd")}, S.DAILY)


def commodity_of_file(path: Column) -> Column:
    """The file's name without folders, .csv and %XX escapes."""
    return normalize_text(decode_percent(F.regexp_extract(path, r"([^/]+)\.csv$", 1)))


def read_mandi(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Source 2: the commodity is the file's name."""
    df = _csv(spark, S.RAW_MANDI, paths).withColumn("_path", F.input_file_name())
    text = {c: normalize_text(F.col(f"{c.capitalize()}_Name")) for c in ("state", "district", "market")}
    prices = {f"{c}_price": F.col(f"{c.capitalize()}_Price") for c in ("min", "max", "modal")}
    rest = {
        "variety": normalize_text(F.col("Variety")), "commodity_group": normalize_text(F.col("Group")), "commodity": commodity_of_file(F.col("_path")),
        "arrivals_tonnes": F.col("Arrivals"), "arrival_date": parse_date(F.col("Reported_Date"), "dd MMM yyyy", "yyyy-MM-dd"),
    }
    return _canonical(df, text | prices | rest, S.MANDI)
