"""Next-observation labels, splits and entity-safe samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.numbers import count_if, uniform
from .features import history, on_years

Z_LIMIT = 2.0


def next_outlier(marked: DataFrame) -> DataFrame:
    """next_price_outlier: whether the entity's next row is an outlier, as 0.0 or 1.0; last rows go."""
    df = marked.withColumn("next_price_outlier", F.lead("price_outlier").over(history()).cast("double"))
    return df.filter(F.col("next_price_outlier").isNotNull())


def with_next_z(features: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    df = features.withColumn("next_z_score", F.lead("z_score").over(history()))
    return df.withColumn("target_anomaly", F.when(F.abs("next_z_score") > limit, 1.0).otherwise(0.0))


def next_zscore(features: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """target_anomaly of each row whose next z-score exists; short histories and constant prices go too."""
    return with_next_z(features, limit).filter(F.col("next_z_score").isNotNull())


def target_audit(features: DataFrame) -> DataFrame:
    """Counts before rows without a next z-score go."""
    t = with_next_z(features)
    conditions = {
        "null_next_z": F.col("next_z_score").isNull(), "null_target": F.col("target_anomaly").isNull(),
        "target_0": F.col("target_anomaly") == 0, "target_1": F.col("target_anomaly") == 1,
    }
    return t.agg(F.count("*").alias("n_records"), *(count_if(c).alias(k) for k, c in conditions.items()))


def temporal_split(df: DataFrame, validate: int = 2024, test: int = 2025) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train before `validate`, validation up to `test`, test from then on; as date ranges."""
    return on_years(df, end=validate), on_years(df, validate, test), on_years(df, test)


def split_name(validate: int, test: int) -> Column:
    year = F.year("arrival_date")
    return F.when(year < validate, "train").when(year < test, "validation").when(year >= test, "test")


def prevalence(labelled: DataFrame, label: str = "target_anomaly", validate: int = 2024, test: int = 2025) -> DataFrame:
    rows = labelled.filter(F.col("arrival_date").isNotNull()).groupBy(split_name(validate, test).alias("split"))
    counts = rows.agg(F.count("*").alias("n_records"), count_if(F.col(label) == 1).alias("n_positive"), count_if(F.col(label) == 0).alias("n_negative"))
    return counts.withColumn("positive_pct", F.round(100.0 * F.col("n_positive") / F.col("n_records"), 4))


def in_sample(per_mille: float, salt: str = "sample", hash_only: bool = False) -> Column:
    """Whether a row's entity is sampled: an entity is in or out as a whole, on every run and layout.

    hash_only uses Spark's own hash of the key; the default, by md5, is the same in any SQL engine."""
    if hash_only:
        return F.pmod(F.hash(*S.ENTITY), F.lit(1000)) < int(per_mille)
    return uniform(*S.ENTITY, salt=salt) < per_mille / 1000.0


def entity_sample(df: DataFrame, per_mille: float = 10.0, salt: str = "sample") -> DataFrame:
    """All rows of the sampled entities: a filter on the key, no join."""
    return df.filter(in_sample(per_mille, salt))


def rows_of_entities(df: DataFrame, entities: DataFrame) -> DataFrame:
    """The rows of given entities; null key parts match nothing."""
    return df.join(entities.select(*S.ENTITY), S.ENTITY, "left_semi")


def sampling_fractions(labelled: DataFrame, per_milles: tuple[float, ...] = (1.0, 5.0, 10.0), label: str = "target_anomaly") -> DataFrame:
    """Entities, records and positive share at several sampling rates, in one pass over the labelled rows."""
    by_entity = labelled.groupBy(*S.ENTITY).agg(F.count("*").alias("n"), count_if(F.col(label) == 1).alias("p"))
    rated = by_entity.withColumn("u", uniform(*S.ENTITY, salt="sample")).withColumn("per_mille", F.explode(F.array(*(F.lit(x) for x in per_milles))))
    chosen = rated.filter(F.col("u") < F.col("per_mille") / 1000.0).groupBy("per_mille")
    counts = chosen.agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_records"), F.sum("p").alias("n_positive"))
    return counts.withColumn("positive_pct", F.round(100.0 * F.col("n_positive") / F.col("n_records"), 4))


def sample_checksum(entities: DataFrame) -> DataFrame:
    """n_entities and a checksum of a frozen sample: the md5 of its entities' md5s, by their first three digits first, so
    that a task sees 1/4096 of them and the last one 4096 rows."""
    rows = entities.select(F.md5(F.concat_ws("|", *S.ENTITY)).alias("h")).distinct()
    joined = lambda c: F.md5(F.array_join(F.sort_array(F.collect_list(c)), ""))
    parts = rows.groupBy(F.substring("h", 1, 3).alias("part")).agg(F.count("*").alias("n"), joined("h").alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_entities"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "")).alias("checksum"))


def poisson_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Rows drawn with replacement."""
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)
