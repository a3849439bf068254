"""Record quality, duplicates and survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.numbers import count_if


def quality_flag() -> Column:
    """The first class that fits. A zero minimum alone is no defect, and a comparison with null never fits."""
    low, high, modal = F.col("min_price"), F.col("max_price"), F.col("modal_price")
    absent = lambda c: c.isNull() | (c == 0)
    rules = [
        ("MISSING_DATE", F.col("arrival_date").isNull()),
        ("MISSING_PRICE", absent(modal)),
        ("NEGATIVE_PRICE", (low < 0) | (high < 0) | (modal < 0)),
        ("ZERO_MIN_MAX", absent(low) & absent(high)),
        ("ZERO_MAX", absent(high)),
        ("MIN_GT_MAX", low > high),
        ("MODAL_OUTSIDE_RANGE", (modal < low) | (modal > high)),
    ]
    flag = F
    for name, fits in rules:
        flag = flag.when(fits, name)
    return flag.otherwise(S.VALID)


def classify(reports: DataFrame) -> DataFrame:
    return reports.withColumn("quality_flag", quality_flag())


def is_valid() -> Column:
    return F.col("quality_flag") == S.VALID


def quality_breakdown(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("quality_flag").agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), "quality_flag")


def duplicate_stats(reports: DataFrame, key: list[str] = S.BUSINESS_KEY) -> DataFrame:
    """One row: distinct keys, keys met more than once, surplus rows. Null key parts are equal to each other."""
    sizes = reports.groupBy(*key).agg(F.count("*").alias("n"))
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")
    return sizes.agg(F.count("*").alias("distinct_keys"), count_if(F.col("n") > 1).alias("duplicated_keys"), surplus)


def survivor_order() -> list[Column]:
    """Valid first, then the widest price range, then the smallest prices; the rest makes the order total."""
    spread = F.coalesce(F.col("max_price") - F.col("min_price"), F.lit(-1.0))
    ties = ("modal_price", "min_price", "max_price", "grade", "arrivals_tonnes")
    return [F.when(is_valid(), 0).otherwise(1), spread.desc(), *(F.col(c).asc_nulls_last() for c in ties)]


def dedup_survivors(flagged: DataFrame, key: list[str] = S.BUSINESS_KEY) -> DataFrame:
    """The best row of each key. The row-number filter lets Catalyst cut groups before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*survivor_order()))
    return flagged.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
