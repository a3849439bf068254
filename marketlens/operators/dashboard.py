"""Queries of the dashboard, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import sinks


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a job or a stream has written at a path so far; no rows if nothing."""
    return spark.read.schema(schema).parquet(path) if sinks.size_of(spark, path) else spark.createDataFrame([], schema)


def top_counts(reports: DataFrame, column: str, within: list[str] | None = None, top: int = 10) -> DataFrame:
    kept = reports if within is None else reports.filter(F.col(column).isin(*within))
    return kept.groupBy(column).agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), column).limit(top)


def price_statistics(statistics: DataFrame, within: list[str] | None = None, top: int = 50) -> DataFrame:
    """The first commodities by name of what profile.price_statistics gives, of those chosen."""
    kept = statistics if within is None else statistics.filter(F.col("commodity").isin(*within))
    return kept.orderBy("commodity").limit(top)


def live(scored: DataFrame, states: list[str] | None = None, commodities: list[str] | None = None) -> DataFrame:
    """The scored rows of the chosen states and commodities; all without a choice."""
    for column, chosen in (("state", states), ("commodity", commodities)):
        if chosen:
            scored = scored.filter(F.col(column).isin(*chosen))
    return scored


def stream_kpis(scored: DataFrame) -> DataFrame:
    """One row; the latest probability is that of the last row by time and entity. Scored: timestamp,
    anomaly_probability, anomaly_prediction and entity columns."""
    last = F.max(F.struct("timestamp", "state", "district", "market", "commodity", "variety", "anomaly_probability"))
    hits = F.coalesce(F.sum(F.col("anomaly_prediction").cast("long")), F.lit(0).cast("long"))
    df = scored.agg(F.count("*").alias("n_records"), hits.alias("n_anomalies"), last.alias("last"))
    pct = F.when(F.col("n_records") > 0, F.round(100.0 * F.col("n_anomalies") / F.col("n_records"), 4))
    return df.select("n_records", "n_anomalies", pct.alias("anomaly_pct"), F.col("last.timestamp").alias("last_timestamp"), F.col("last.anomaly_probability").alias("last_probability"))


def top_anomalous(scored: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Commodities or markets by their number of anomalies."""
    return top_counts(scored.filter("anomaly_prediction = 1"), column, top=top)


def recent_alerts(scored: DataFrame, top: int = 50) -> DataFrame:
    ties = ("state", "district", "market", "commodity", "variety")
    return scored.filter("anomaly_prediction = 1").orderBy(F.desc("timestamp"), *ties).limit(top)
