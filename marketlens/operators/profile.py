"""Profiling and descriptive statistics: one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.numbers import count_if
from .quality import is_valid


def overview(reports: DataFrame) -> DataFrame:
    d = F.col("arrival_date")
    return reports.agg(F.count("*").alias("n_records"), F.min(d).alias("first_date"), F.max(d).alias("last_date"), count_if(d.isNull()).alias("n_undated"))


def null_density(reports: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return reports.agg(*(count_if(F.col(c).isNull()).alias(c) for c in columns or reports.columns))


def cardinality(reports: DataFrame, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct values of the dimensions: sketches in one pass, or exact."""
    count = F.countDistinct if exact else lambda c: F.approx_count_distinct(c, rsd)
    return reports.agg(*(count(c).alias(c) for c in S.DIMENSIONS))


def valid_price_stats(flagged: DataFrame) -> DataFrame:
    p = "modal_price"
    stats = [F.round(F.avg(p), 2).alias("avg_price"), F.round(F.stddev_samp(p), 2).alias("stddev_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price")]
    return flagged.filter(is_valid()).agg(F.count("*").alias("n_records"), *stats)


def records_per_year(reports: DataFrame) -> DataFrame:
    dated = reports.filter(F.col("arrival_date").isNotNull())
    return dated.groupBy(F.year("arrival_date").cast("long").alias("year")).agg(F.count("*").alias("n_records")).orderBy("year")


def counts_by(reports: DataFrame, column: str) -> DataFrame:
    return reports.groupBy(column).agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), column)


def yearly_statistics(reports: DataFrame) -> DataFrame:
    """With a row for undated records."""
    return reports.groupBy(F.year("arrival_date").cast("long").alias("year")).agg(F.count("*").alias("n_records")).orderBy(F.col("year").asc_nulls_first())


def price_statistics(reports: DataFrame, by: str = "commodity") -> DataFrame:
    """Average, minimum and maximum of the price columns that exist, over all records, defective ones too."""
    stats = []
    for c in ("modal_price", "min_price", "max_price"):
        if c in reports.columns:
            stats += [F.round(F.avg(c), 4).alias(f"avg_{c}"), F.min(c).alias(f"lowest_{c}"), F.max(c).alias(f"highest_{c}")]
    return reports.groupBy(by).agg(F.count("*").alias("n_records"), *stats)


def price_quantiles(flagged: DataFrame, exact: bool = True) -> DataFrame:
    from .outliers import quantiles

    p25, p50, p75 = quantiles("modal_price", (0.25, 0.5, 0.75), exact)
    return flagged.filter(is_valid()).groupBy("source_dataset").agg(p25.alias("p25"), p50.alias("p50"), p75.alias("p75"))


def entity_catalog(reports: DataFrame) -> DataFrame:
    return reports.select(*S.ENTITY).distinct()


def calendar_parts(reports: DataFrame) -> DataFrame:
    d = F.col("arrival_date")
    first = F.make_date(F.year(d), F.month(d), F.lit(1))
    return reports.select(
        d.alias("arrival_date"), F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.dayofmonth(d).cast("long").alias("day"),
        F.last_day(d).alias("month_end"), F.date_add(first, 14).alias("mid_month"),
    ).distinct()
