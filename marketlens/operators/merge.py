"""Two sources into one canonical table, and audits of their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.numbers import count_if
from .quality import is_valid

#: Ratio buckets between the sources, inclusive, first match.
RATIO_BUCKETS = (("1x", 0.8, 1.2), ("10x", 8.0, 12.0), ("100x", 80.0, 120.0), ("1000x", 800.0, 1200.0))


def source(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("source_dataset") == name)


def canonical_merge(deduplicated: DataFrame) -> DataFrame:
    """Valid rows of both sources; source 1 wins where both have a key and takes source 2's arrivals if it has none.

    One full outer join of two sides that the survivors' key has made unique: each row is shuffled once. Keys join by
    equality, so a null key part never matches; `duplicate_keys` shows what that leaves double."""
    valid = deduplicated.filter(is_valid())
    one = source(valid, S.DAILY).withColumn("_one", F.lit(True))
    two = source(valid, S.MANDI)
    two = two.select(*(F.col(c).alias(f"_{c}") for c in two.columns), F.lit(True).alias("_two"))
    same = F.lit(True)
    for c in S.JOIN_KEY:
        same = same & (F.col(c) == F.col(f"_{c}"))
    won = F.col("_one").isNotNull()
    columns = {c: F.when(won, F.col(c)).otherwise(F.col(f"_{c}")) for c in deduplicated.columns}
    columns["arrivals_tonnes"] = F.coalesce("arrivals_tonnes", "_arrivals_tonnes")
    columns["price_source_dataset"] = F.when(won, S.DAILY).otherwise(S.MANDI)
    columns["arrivals_source_dataset"] = F.when(F.col("_two"), S.MANDI).otherwise(S.DAILY)
    return one.join(two, same, "full_outer").select(*(v.alias(c) for c, v in columns.items()))


def source2_only(one: DataFrame, two: DataFrame) -> DataFrame:
    return two.join(one.select(*S.JOIN_KEY), S.JOIN_KEY, "left_anti")


def source_union(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two, allowMissingColumns=True)


def duplicate_keys(canonical: DataFrame) -> DataFrame:
    """Keys met more than once; a canonical table has none."""
    return canonical.groupBy(*S.JOIN_KEY).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(canonical: DataFrame) -> None:
    """The gate: an error if a key is met more than once."""
    if bad := duplicate_keys(canonical).take(3):
        raise ValueError(f"canonical keys are not unique, for example {bad}")


def overlap(deduplicated: DataFrame) -> DataFrame:
    """Keys in both sources with both prices and their ratio (null if source 1's price is zero)."""
    valid = deduplicated.filter(is_valid())
    one = source(valid, S.DAILY).select(*S.JOIN_KEY, F.col("modal_price").alias("price_1"), F.col("arrivals_tonnes").alias("arrivals_1"))
    two = source(valid, S.MANDI).select(*S.JOIN_KEY, F.col("modal_price").alias("price_2"), F.col("arrivals_tonnes").alias("arrivals_2"))
    return one.join(two, S.JOIN_KEY).withColumn("ratio", F.when(F.col("price_1") != 0, F.col("price_2") / F.col("price_1")))


def overlap_price_stats(both: DataFrame) -> DataFrame:
    stats = [F.count("*").alias("n")]
    for c in ("price_1", "price_2", "ratio"):
        stats += [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"median_{c}")]
        stats += [F.round(F.avg(c), 4).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return both.agg(*stats)


def ratio_bucket() -> Column:
    out = F
    for name, low, high in RATIO_BUCKETS:
        out = out.when(F.col("ratio").between(low, high), name)
    return out.otherwise("Other")


def ratio_buckets(both: DataFrame) -> DataFrame:
    """Counts and shares; the total is the sum of the few bucket counts, not a second pass."""
    from pyspark.sql.window import Window

    counts = both.groupBy(ratio_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def discrepancies(both: DataFrame) -> DataFrame:
    return both.filter(~F.col("ratio").between(0.8, 1.2))


def merge_audit(canonical: DataFrame) -> DataFrame:
    """Rows by the sources that gave price and arrivals."""
    return canonical.groupBy("price_source_dataset", "arrivals_source_dataset").agg(
        F.count("*").alias("n_records"), F.count("arrivals_tonnes").alias("n_arrivals"), F.countDistinct("commodity").alias("n_commodities")
    )


def arrivals_compat(both: DataFrame) -> DataFrame:
    stats = [F.count("*").alias("n")]
    for c in ("arrivals_1", "arrivals_2"):
        missing = F.round(100.0 * count_if(F.col(c).isNull()) / F.count("*"), 2)
        stats += [missing.alias(f"null_pct_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 4).alias(f"mean_{c}")]
        stats += [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"median_{c}")]
    return both.agg(*stats)
