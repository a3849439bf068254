"""Strictly historical price features: one definition, for batch and for the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.numbers import count_if, ratio

WINDOW_ROWS = 7


def history(entity: list[str] = S.ENTITY, order: list[str] = ("arrival_date",)):
    return Window.partitionBy(*entity).orderBy(*order)


def price_features(reports: DataFrame, entity: list[str] = S.ENTITY, order: list[str] = ("arrival_date",)) -> DataFrame:
    """Adds the nine features. The rolling frame is the seven rows before the current one; all windows share a sort."""
    w = history(entity, order)
    before = w.rowsBetween(-WINDOW_ROWS, -1)
    modal = F.col("modal_price")
    df = reports.withColumns(
        {
            "previous_modal_price": F.lag("modal_price").over(w),
            "rolling_7_observation_avg": F.avg("modal_price").over(before),
            "rolling_7_observation_stddev": F.stddev_samp("modal_price").over(before),
        }
    )
    prev, sd = F.col("previous_modal_price"), F.col("rolling_7_observation_stddev")
    spread = F.col("max_price") - F.col("min_price")
    return df.withColumns(
        {
            "price_change": modal - prev,
            "price_change_pct": ratio(modal - prev, prev),
            "price_range": spread,
            "relative_price_range": ratio(spread, modal),
            "previous_to_current_ratio": ratio(prev, modal),
            "z_score": ratio(modal - F.col("rolling_7_observation_avg"), sd),
        }
    )


def rolling_inclusive(reports: DataFrame) -> DataFrame:
    """The older frame of the current and six earlier rows, with the change in percent."""
    w = history()
    frame = w.rowsBetween(-(WINDOW_ROWS - 1), 0)
    prev = F.lag("modal_price").over(w)
    df = reports.withColumns({"_prev": prev, "rolling_avg_inclusive": F.avg("modal_price").over(frame), "rolling_stddev_inclusive": F.stddev_samp("modal_price").over(frame)})
    return df.withColumn("price_change_percent", 100 * ratio(F.col("modal_price") - F.col("_prev"), F.col("_prev"))).drop("_prev")


def tuning_features(reports: DataFrame) -> DataFrame:
    """Features of the tuning job, whose ratio is current to previous and whose gaps have defaults."""
    w = history()
    df = reports.withColumn("_prev", F.lag("modal_price").over(w))
    spread = F.col("max_price") - F.col("min_price")
    return df.withColumns(
        {
            "tuning_range": spread,
            "tuning_relative_range": F.coalesce(ratio(spread, F.col("modal_price")), F.lit(0.0)),
            "tuning_ratio": F.coalesce(ratio(F.col("modal_price"), F.col("_prev")), F.lit(1.0)),
        }
    ).drop("_prev")


def zscore_alerts(features: DataFrame, above: float = 2.0) -> DataFrame:
    return features.filter(F.col("z_score") > above).select(*S.ENTITY, "arrival_date", "modal_price", "rolling_7_observation_avg", "z_score")


def feature_null_rates(features: DataFrame) -> DataFrame:
    """One row: the percentage of nulls of each feature, in one pass."""
    return features.agg(*(F.round(100.0 * count_if(F.col(c).isNull()) / F.count("*"), 4).alias(c) for c in S.FEATURES))


def edge_audit(features: DataFrame) -> DataFrame:
    """One row of counts that are zero in a sound table, and its size."""
    prev, sd = F.col("previous_modal_price"), F.col("rolling_7_observation_stddev")
    null_key = F.lit(False)
    for c in S.JOIN_KEY:
        null_key = null_key | F.col(c).isNull()
    broken: dict[str, Column] = {
        "null_keys": null_key,
        "change_pct_violations": (prev.isNull() | (prev == 0)) & F.col("price_change_pct").isNotNull(),
        "ratio_violations": (prev.isNull() | (F.col("modal_price") == 0)) & F.col("previous_to_current_ratio").isNotNull(),
        "z_score_violations": (sd.isNull() | (sd == 0)) & F.col("z_score").isNotNull(),
    }
    return features.agg(F.count("*").alias("n_records"), *(count_if(v).alias(k) for k, v in broken.items()))


def on_years(df: DataFrame, first: int | None = None, end: int | None = None, column: str = "arrival_date") -> DataFrame:
    """Rows of the years [first, end) as a date range, which reaches the scan; year(column) would not."""
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(f"{first}-01-01").cast("date"))
    return df if end is None else df.filter(F.col(column) < F.lit(f"{end}-01-01").cast("date"))
