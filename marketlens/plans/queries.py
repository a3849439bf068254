"""Every operator as a query over the driver's tables, with the SQL that gives the same rows.

Sums and means are rounded on both sides, as they are added in another order; plain arithmetic is exact and is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.numbers import uniform
from ..functions.text import normalize_text, parse_date
from ..operators import dashboard, features, labels, merge, metrics, ml, outliers, profile, quality, synth
from ..session import work_folder
from ..streaming import events, scoring
from . import pipelines
from .fixture import market_report, with_market

#: The split of the driver's dates, 1995 to 2001.
VALIDATE, TEST = 2000, 2001
#: Least rows of the outlier ranking at this data's size.
LEAST_RANKED = 100

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, market: bool = True):
    """Register a function of (spark, sf_dir); sql: its oracle, by default over the market tables."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_market(sql) if market else sql
        return f

    return put


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """To four places with a threshold that no price of this data meets exactly: means of one price are often halfway
    between two results, and engines round such ties differently."""
    return df.withColumns({c: F.floor(F.col(c) * 10000 + 0.5003) / 10000 for c in columns})


def settled_sql(*columns: str) -> str:
    return ", ".join(f"floor({c} * 10000 + 0.5003::DOUBLE) / 10000 AS {c.split()[-1]}" for c in columns)


def rounded(df: DataFrame, places: int = 6, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns or [n for n, t in df.dtypes if t == "double"]})


def flagged(spark, d):
    return quality.classify(market_report(spark, d))


def survivors(spark, d):
    return quality.dedup_survivors(flagged(spark, d))


def marked(spark, d):
    f = flagged(spark, d)
    return outliers.flag_outliers(quality.dedup_survivors(f), outliers.learn_bounds(f, exact=True))


def canonical(spark, d):
    return merge.canonical_merge(survivors(spark, d))


def featured(spark, d):
    return features.price_features(canonical(spark, d))


def target(spark, d):
    return labels.next_zscore(featured(spark, d))


def scored(spark, d):
    """A score that needs no model: a quarter of |z|, at most 1."""
    s = F.round(F.least(F.abs(F.coalesce("z_score", F.lit(0.0))) / 4, F.lit(1.0)), 6)
    return target(spark, d).select(*S.JOIN_KEY, "modal_price", "target_anomaly", s.alias("score"))


def stream_scored(spark, d):
    s = scored(spark, d).withColumn("timestamp", F.col("arrival_date").cast("timestamp")).withColumn("anomaly_probability", F.col("score"))
    return s.withColumn("anomaly_prediction", (F.col("score") >= 0.5).cast("int")).drop("score", "target_anomaly")


KEY = ", ".join(S.JOIN_KEY)
MONEY = "min_price, max_price, modal_price"

# Sources, projections, scalar functions

TEXTS = ["  Wheat   (Dara) ", "NA", "n/a", "null", "-", "", "   ", "a\t b", "Rice", "N A", "-1", None]
DATES = ["2024-01-31", "31 Jan 2024", " 05 Feb 2023 ", "2023-13-01", "31 Feb 2024", "", "2024-02-29", "29 Feb 2023", "x", None]


def _literals(values):
    return ", ".join("(%d, %s)" % (i, "NULL" if v is None else "'" + v.replace("\t", "' || chr(9) || '") + "'") for i, v in enumerate(values))


@query("normalize_text", f"SELECT id, CASE WHEN upper(t) NOT IN ('', 'NA', 'N/A', 'NULL', '-') THEN t END AS text FROM (SELECT id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS t FROM (VALUES {_literals(TEXTS)}) v(id, x))", market=False)
def _(spark, d):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string").select("id", normalize_text(F.col("x")).alias("text"))


@query("parse_dates", f"SELECT id, coalesce(try_strptime(trim(x), '%d %b %Y')::DATE, try_strptime(trim(x), '%Y-%m-%d')::DATE) AS day FROM (VALUES {_literals(DATES)}) v(id, x)", market=False)
def _(spark, d):
    return spark.createDataFrame(list(enumerate(DATES)), "id int, x string").select("id", parse_date(F.col("x"), "dd MMM yyyy", "yyyy-MM-dd").alias("day"))


@query("calendar_parts", "SELECT DISTINCT arrival_date, year(arrival_date)::BIGINT AS year, month(arrival_date)::BIGINT AS month, day(arrival_date)::BIGINT AS day, last_day(arrival_date) AS month_end, (date_trunc('month', arrival_date)::DATE + 14)::DATE AS mid_month FROM market_report")
def _(spark, d):
    return profile.calendar_parts(market_report(spark, d))


@query("quarantine_undated", f"SELECT state, district, market, commodity, variety, grade, {MONEY}, source_dataset FROM marked WHERE arrival_date IS NULL")
def _(spark, d):
    return outliers.undated(marked(spark, d)).select(*S.DIMENSIONS, "min_price", "max_price", "modal_price", "source_dataset")


@query("replay_batch", f"SELECT {KEY}, modal_price FROM (SELECT * FROM canonical WHERE arrival_date >= DATE '{TEST}-01-01' ORDER BY arrival_date, state, district, market, commodity, variety LIMIT 5000)")
def _(spark, d):
    batch = events.from_json(events.replay_batch(canonical(spark, d), TEST).select("value", F.current_timestamp().alias("event_timestamp")))
    return batch.select(*S.ENTITY, F.to_date("arrival_date").alias("arrival_date"), "modal_price")


@query("entity_hash_sample", "SELECT DISTINCT state, district, market, commodity, variety FROM market_report WHERE ('0x' || substr(md5(state || '|' || district || '|' || market || '|' || commodity || '|' || variety || '|sample'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def _(spark, d):
    return profile.entity_catalog(labels.entity_sample(market_report(spark, d), 100.0))


# Quality, duplicates, outliers


@query("quality_flags", f"SELECT source_dataset, {KEY}, grade, {MONEY}, quality_flag FROM flagged")
def _(spark, d):
    return flagged(spark, d).select("source_dataset", *S.JOIN_KEY, "grade", "min_price", "max_price", "modal_price", "quality_flag")


@query("quality_breakdown", "SELECT quality_flag, count(*) AS n_records FROM flagged GROUP BY quality_flag")
def _(spark, d):
    return quality.quality_breakdown(flagged(spark, d))


@query("duplicate_stats", f"SELECT count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows FROM (SELECT count(*) AS n FROM market_report GROUP BY source_dataset, {KEY})")
def _(spark, d):
    return quality.duplicate_stats(market_report(spark, d))


@query("dedup_survivors", f"SELECT source_dataset, {KEY}, grade, {MONEY}, arrivals_tonnes, quality_flag FROM survivors")
def _(spark, d):
    return survivors(spark, d).select("source_dataset", *S.JOIN_KEY, "grade", "min_price", "max_price", "modal_price", "arrivals_tonnes", "quality_flag")


BOUNDS = "p25, p75, median, n_valid, iqr, bound_type, lower_bound, upper_bound"


@query("outlier_bounds", f"SELECT commodity, {BOUNDS} FROM bounds")
def _(spark, d):
    return outliers.learn_bounds(flagged(spark, d), exact=True)


@query("outlier_bounds_approx")
def _(spark, d):
    return outliers.learn_bounds(flagged(spark, d), exact=False)


@query("outlier_flags", f"SELECT source_dataset, {KEY}, modal_price, price_outlier FROM marked")
def _(spark, d):
    return marked(spark, d).select("source_dataset", *S.JOIN_KEY, "modal_price", "price_outlier")


@query("outlier_rate_topk", f"SELECT commodity, count(*) AS n_records, sum(price_outlier::INTEGER)::BIGINT AS n_outliers, round(100.0::DOUBLE * sum(price_outlier::INTEGER) / count(*), 3) AS outlier_pct FROM marked GROUP BY commodity HAVING count(*) >= {LEAST_RANKED} ORDER BY outlier_pct DESC, commodity LIMIT 10")
def _(spark, d):
    return outliers.outlier_rates(marked(spark, d), LEAST_RANKED)


@query("preprocess_summary", "SELECT *, records_raw - records_written - records_undated AS duplicates_removed FROM (SELECT count(arrival_date) AS records_written, count(*) - count(arrival_date) AS records_undated, count(*) FILTER (arrival_date IS NOT NULL AND quality_flag = 'VALID') AS records_valid, count(*) FILTER (arrival_date IS NOT NULL AND price_outlier) AS records_outlier, min(arrival_date) AS first_date, max(arrival_date) AS last_date, (SELECT count(*) FROM flagged) AS records_raw FROM marked)")
def _(spark, d):
    return outliers.preprocess_summary(market_report(spark, d), marked(spark, d))


@query("preprocess_pipeline", f"SELECT source_dataset, {KEY}, grade, {MONEY}, quality_flag, price_outlier, year(arrival_date)::INTEGER AS year FROM marked WHERE arrival_date IS NOT NULL")
def _(spark, d):
    out = pipelines.preprocess(market_report(spark, d), exact=True).filter("arrival_date IS NOT NULL")
    return out.select("source_dataset", *S.JOIN_KEY, "grade", "min_price", "max_price", "modal_price", "quality_flag", "price_outlier", "year")


# Joins and set operations


@query("overlap_inner", f"SELECT {KEY}, price_1, price_2, ratio FROM overlap")
def _(spark, d):
    return merge.overlap(survivors(spark, d)).select(*S.JOIN_KEY, "price_1", "price_2", "ratio")


@query("canonical_merge", f"SELECT {KEY}, source_dataset, modal_price, arrivals_tonnes, price_source_dataset, arrivals_source_dataset FROM canonical")
def _(spark, d):
    return canonical(spark, d).select(*S.JOIN_KEY, "source_dataset", "modal_price", "arrivals_tonnes", "price_source_dataset", "arrivals_source_dataset")


@query("canonical_duplicate_gate", f"SELECT {KEY}, count(*) AS n FROM canonical GROUP BY {KEY} HAVING count(*) > 1")
def _(spark, d):
    return merge.duplicate_keys(canonical(spark, d))


@query("source2_only_anti", f"SELECT {KEY} FROM two ANTI JOIN one USING ({KEY})")
def _(spark, d):
    valid = survivors(spark, d).filter(quality.is_valid())
    return merge.source2_only(merge.source(valid, S.DAILY), merge.source(valid, S.MANDI)).select(*S.JOIN_KEY)


@query("source_union", "SELECT source_dataset, count(*) AS n_records, count(arrivals_tonnes) AS n_arrivals FROM flagged GROUP BY source_dataset")
def _(spark, d):
    f = flagged(spark, d)
    both = merge.source_union(merge.source(f, S.DAILY).drop("arrivals_tonnes"), merge.source(f, S.MANDI))
    return both.groupBy("source_dataset").agg(F.count("*").alias("n_records"), F.count("arrivals_tonnes").alias("n_arrivals"))


@query("entity_catalog", "SELECT DISTINCT state, district, market, commodity, variety FROM market_report")
def _(spark, d):
    return profile.entity_catalog(market_report(spark, d))


U_ENTITY = "('0x' || substr(md5(state || '|' || district || '|' || market || '|' || commodity || '|' || variety || '|sample'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("entity_sample_join", f"SELECT {KEY}, target_anomaly FROM target WHERE {U_ENTITY} < 0.1")
def _(spark, d):
    t = target(spark, d)
    return labels.rows_of_entities(t, profile.entity_catalog(labels.entity_sample(market_report(spark, d), 100.0))).select(*S.JOIN_KEY, "target_anomaly")


@query("copy_detection", "SELECT count(*) AS n_distinct, count(hit) AS n_copied FROM (SELECT DISTINCT market, commodity, arrival_date, modal_price FROM two) LEFT JOIN (SELECT DISTINCT market, commodity, arrival_date, modal_price, 1 AS hit FROM one) USING (market, commodity, arrival_date, modal_price)")
def _(spark, d):
    valid = survivors(spark, d).filter(quality.is_valid())
    return synth.copies(merge.source(valid, S.MANDI), merge.source(valid, S.DAILY))


# Features


@query("price_features", f"SELECT {KEY}, " + ", ".join(S.FEATURES[:6]) + " FROM featured")
def _(spark, d):
    return featured(spark, d).select(*S.JOIN_KEY, *S.FEATURES[:6])


@query("rolling_zscore", f"SELECT {KEY}, {settled_sql(*S.FEATURES[6:])} FROM featured")
def _(spark, d):
    return settled(featured(spark, d).select(*S.JOIN_KEY, *S.FEATURES[6:]), *S.FEATURES[6:])


@query("rolling7_inclusive", f"""SELECT {KEY}, {settled_sql("rolling_avg_inclusive", "rolling_stddev_inclusive", "price_change_percent")} FROM (
  SELECT *, avg(modal_price) OVER f AS rolling_avg_inclusive, stddev_samp(modal_price) OVER f AS rolling_stddev_inclusive,
  CASE WHEN lag(modal_price) OVER w <> 0 THEN 100 * ((modal_price - lag(modal_price) OVER w) / lag(modal_price) OVER w) END AS price_change_percent
  FROM canonical WINDOW w AS (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date),
  f AS (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
def _(spark, d):
    out = features.rolling_inclusive(canonical(spark, d))
    names = ("rolling_avg_inclusive", "rolling_stddev_inclusive", "price_change_percent")
    return settled(out.select(*S.JOIN_KEY, *names), *names)


@query("tuning_features", f"""SELECT {KEY}, max_price - min_price AS tuning_range, CASE WHEN modal_price <> 0 THEN (max_price - min_price) / modal_price ELSE 0 END AS tuning_relative_range,
  coalesce(CASE WHEN prev <> 0 THEN modal_price / prev END, 1) AS tuning_ratio
  FROM (SELECT *, lag(modal_price) OVER (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date) AS prev FROM canonical)""")
def _(spark, d):
    out = features.tuning_features(canonical(spark, d))
    return out.select(*S.JOIN_KEY, "tuning_range", "tuning_relative_range", "tuning_ratio")


@query("zscore_alerts", f"SELECT {KEY}, modal_price, {settled_sql('rolling_7_observation_avg', 'z_score')} FROM featured WHERE z_score > 2")
def _(spark, d):
    return settled(features.zscore_alerts(featured(spark, d)), "rolling_7_observation_avg", "z_score")


@query("feature_null_rates", "SELECT " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 4) AS {c}" for c in S.FEATURES) + " FROM featured")
def _(spark, d):
    return features.feature_null_rates(featured(spark, d))


@query("feature_edge_audit", "SELECT count(*) AS n_records, count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in S.JOIN_KEY) + ") AS null_keys, count(*) FILTER ((previous_modal_price IS NULL OR previous_modal_price = 0) AND price_change_pct IS NOT NULL) AS change_pct_violations, count(*) FILTER ((previous_modal_price IS NULL OR modal_price = 0) AND previous_to_current_ratio IS NOT NULL) AS ratio_violations, count(*) FILTER ((rolling_7_observation_stddev IS NULL OR rolling_7_observation_stddev = 0) AND z_score IS NOT NULL) AS z_score_violations FROM featured")
def _(spark, d):
    return features.edge_audit(featured(spark, d))


# Profiling and analytics


@query("profile_overview", "SELECT count(*) AS n_records, min(arrival_date) AS first_date, max(arrival_date) AS last_date, count(*) FILTER (arrival_date IS NULL) AS n_undated FROM market_report")
def _(spark, d):
    return profile.overview(market_report(spark, d))


@query("null_density", "SELECT " + ", ".join(f"count(*) FILTER ({f.name} IS NULL) AS {f.name}" for f in S.CANONICAL) + " FROM market_report")
def _(spark, d):
    return profile.null_density(market_report(spark, d))


@query("dimension_cardinality", "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in S.DIMENSIONS) + " FROM market_report")
def _(spark, d):
    return profile.cardinality(market_report(spark, d), exact=True)


@query("dimension_cardinality_approx")
def _(spark, d):
    return profile.cardinality(market_report(spark, d))


@query("valid_price_stats", "SELECT count(*) AS n_records, round(avg(modal_price), 2) AS avg_price, round(stddev_samp(modal_price), 2) AS stddev_price, min(modal_price) AS min_price, max(modal_price) AS max_price FROM valid")
def _(spark, d):
    return profile.valid_price_stats(flagged(spark, d))


@query("records_per_year", "SELECT year(arrival_date)::BIGINT AS year, count(*) AS n_records FROM market_report WHERE arrival_date IS NOT NULL GROUP BY 1")
def _(spark, d):
    return profile.records_per_year(market_report(spark, d))


for _name, _column in (("commodity_statistics", "commodity"), ("state_statistics", "state")):
    query(_name, f"SELECT {_column}, count(*) AS n_records FROM market_report GROUP BY {_column}")(lambda spark, d, c=_column: profile.counts_by(market_report(spark, d), c))


@query("yearly_statistics", "SELECT year(arrival_date)::BIGINT AS year, count(*) AS n_records FROM market_report GROUP BY 1")
def _(spark, d):
    return profile.yearly_statistics(market_report(spark, d))


@query("price_statistics", "SELECT commodity, count(*) AS n_records, " + ", ".join(f"round(avg({c}), 4) AS avg_{c}, min({c}) AS lowest_{c}, max({c}) AS highest_{c}" for c in ("modal_price", "min_price", "max_price")) + " FROM market_report GROUP BY commodity")
def _(spark, d):
    return profile.price_statistics(market_report(spark, d))


@query("price_quantiles", "SELECT source_dataset, " + ", ".join(f"quantile_disc(modal_price, {p}) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))) + " FROM valid GROUP BY source_dataset")
def _(spark, d):
    return profile.price_quantiles(flagged(spark, d))


def _overlap_stats(c):
    return f"quantile_disc({c}, 0.5) AS median_{c}, round(avg({c}), 4) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}"


@query("overlap_price_stats", f"SELECT count(*) AS n, {', '.join(map(_overlap_stats, ('price_1', 'price_2', 'ratio')))} FROM overlap")
def _(spark, d):
    return merge.overlap_price_stats(merge.overlap(survivors(spark, d)))


@query("price_ratio_buckets", "SELECT bucket, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS share_pct FROM (SELECT CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN '1x' WHEN ratio BETWEEN 8 AND 12 THEN '10x' WHEN ratio BETWEEN 80 AND 120 THEN '100x' WHEN ratio BETWEEN 800 AND 1200 THEN '1000x' ELSE 'Other' END AS bucket, count(*) AS n FROM overlap GROUP BY 1)")
def _(spark, d):
    return merge.ratio_buckets(merge.overlap(survivors(spark, d)))


@query("overlap_discrepancies", f"SELECT {KEY}, price_1, price_2, ratio FROM overlap WHERE NOT ratio BETWEEN 0.8 AND 1.2")
def _(spark, d):
    return merge.discrepancies(merge.overlap(survivors(spark, d))).select(*S.JOIN_KEY, "price_1", "price_2", "ratio")


@query("merge_audit", "SELECT price_source_dataset, arrivals_source_dataset, count(*) AS n_records, count(arrivals_tonnes) AS n_arrivals, count(DISTINCT commodity) AS n_commodities FROM canonical GROUP BY 1, 2")
def _(spark, d):
    return merge.merge_audit(canonical(spark, d))


def _arrival_stats(c):
    return f"round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 4) AS mean_{c}, quantile_disc({c}, 0.5) AS median_{c}"


@query("arrivals_compat", f"SELECT count(*) AS n, {', '.join(map(_arrival_stats, ('arrivals_1', 'arrivals_2')))} FROM overlap")
def _(spark, d):
    return merge.arrivals_compat(merge.overlap(survivors(spark, d)))


# Learned distributions and synthetic workloads


@query("price_model_lognormal", "SELECT source_dataset, commodity, market, round(log_mu, 6) AS log_mu, round(log_sigma, 6) AS log_sigma, round(spread_ratio, 6) AS spread_ratio, n_obs FROM price_model")
def _(spark, d):
    return rounded(synth.price_model(flagged(spark, d)))


@query("seasonal_factors", "SELECT commodity, month, seasonal_factor, n_obs FROM seasonal")
def _(spark, d):
    return synth.seasonal_factors(flagged(spark, d), exact=True)


@query("arrivals_model", "SELECT commodity, round(arr_log_mu, 6) AS arr_log_mu, round(arr_log_sigma, 6) AS arr_log_sigma, n_obs FROM arrivals")
def _(spark, d):
    return rounded(synth.arrivals_model(flagged(spark, d)))


@query("quality_rates", "SELECT source_dataset, n_total, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("rate_zero_min_max", "rate_zero_max", "rate_missing_price", "rate_modal_outside")) + " FROM rates")
def _(spark, d):
    return rounded(synth.quality_rates(flagged(spark, d)))


@query("year_shape", "SELECT source_dataset, year(arrival_date)::BIGINT AS year, count(*) AS n_records FROM market_report WHERE arrival_date IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return synth.year_shape(market_report(spark, d))


@query("synthetic_skeleton", "SELECT source_dataset, state, district, market, commodity, variety, grade, year, month FROM skeleton")
def _(spark, d):
    return synth.skeleton(market_report(spark, d)).drop("commodity_group")


@query("synthetic_enrich_star", """SELECT source_dataset, commodity, market, month, count(*) AS n_rows, round(max(log_mu), 6) AS log_mu, round(max(seasonal_factor), 6) AS seasonal_factor, round(max(arr_log_mu), 6) AS arr_log_mu, round(max(rate_zero_max), 6) AS rate_zero_max
  FROM skeleton LEFT JOIN price_model USING (source_dataset, commodity, market) LEFT JOIN seasonal USING (commodity, month) LEFT JOIN arrivals USING (commodity) LEFT JOIN rates USING (source_dataset) GROUP BY ALL""")
def _(spark, d):
    f = flagged(spark, d)
    out = synth.enrich(synth.skeleton(f), synth.profile(f, exact=True)).groupBy("source_dataset", "commodity", "market", "month")
    return rounded(out.agg(F.count("*").alias("n_rows"), *(F.max(c).alias(c) for c in ("log_mu", "seasonal_factor", "arr_log_mu", "rate_zero_max"))))


WORKLOAD_KEY = ["source_dataset", *S.DIMENSIONS, "year", "month"]


def _workload() -> str:
    """SQL of the generator, in the steps of its definition."""
    text = " || '|' || ".join(f"coalesce({c}::VARCHAR, '')" for c in WORKLOAD_KEY)
    digests = ", ".join(f"md5({text} || '|{synth.BASE_SEED}:{g}') AS h{g}" for g in range(-(-len(synth.EVERY) // 4)))
    draws = ", ".join(f"('0x' || substr(h{i // 4}, {8 * (i % 4) + 1}, 8))::BIGINT / 4294967296.0::DOUBLE AS {d}" for i, d in enumerate(synth.EVERY))
    normal = lambda u: f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos(2.0::DOUBLE * pi() * {u}_2))"
    sql = lambda x: f"{x!r}::DOUBLE"
    price = f"exp(coalesce(log_mu, {sql(synth.DEFAULT_MU)}) + coalesce(log_sigma, {sql(synth.DEFAULT_SIGMA)}) * {normal('u_price')})"
    (spike, wide), (drop, deep) = synth.SPIKE, synth.DROP
    return f"""
WITH star AS (
  SELECT * FROM skeleton LEFT JOIN (SELECT * EXCLUDE (n_obs) FROM price_model) USING (source_dataset, commodity, market) LEFT JOIN (SELECT * EXCLUDE (n_obs) FROM seasonal) USING (commodity, month)
    LEFT JOIN (SELECT * EXCLUDE (n_obs) FROM arrivals) USING (commodity) LEFT JOIN (SELECT * EXCLUDE (n_total) FROM rates) USING (source_dataset)),
drawn AS (SELECT *, {draws} FROM (SELECT *, {digests} FROM star)),
priced AS (SELECT *, u_anomaly < {sql(synth.ANOMALY_RATE)} AS odd, {price} * coalesce(seasonal_factor, 1) * (1 + 0.05::DOUBLE * {normal('u_noise')}) AS p FROM drawn),
modal AS (
  SELECT *, round(greatest(CASE WHEN NOT odd THEN p WHEN u_kind < 0.5 THEN p * ({sql(spike)} + {sql(wide)} * u_size) ELSE p * ({sql(drop)} + {sql(deep)} * u_size) END, {sql(synth.FLOOR_PRICE)}), 2) AS m,
    coalesce(spread_ratio, {sql(synth.SPREAD[0])}) / 2 AS half, coalesce(rate_zero_min_max, 0) AS zero, coalesce(rate_zero_min_max, 0) + coalesce(rate_zero_max, 0) AS zero_max,
    coalesce(rate_zero_min_max, 0) + coalesce(rate_zero_max, 0) + coalesce(rate_missing_price, 0) AS missing, make_date(year, month, 1) AS first FROM priced),
made AS (
  SELECT state, district, market, commodity, variety, grade, (first + CAST(floor(u_day * day(last_day(first))) AS INTEGER))::DATE AS arrival_date,
    CASE WHEN u_defect < zero THEN 0 ELSE round(m / (1 + half * u_low), 2) END AS min_price, CASE WHEN u_defect < zero_max THEN 0 ELSE round(m * (1 + half * u_high), 2) END AS max_price,
    CASE WHEN u_defect >= zero_max AND u_defect < missing THEN 0 ELSE m END AS modal_price,
    CASE WHEN source_dataset = '{S.MANDI}' THEN round(exp(coalesce(arr_log_mu, 0) + coalesce(arr_log_sigma, {sql(synth.ARRIVAL_SIGMA[0])}) * {normal('u_arrivals')}), 2) END AS arrivals_tonnes,
    commodity_group, source_dataset, 'synthetic_scaled' AS data_source, odd AS synthetic_injected_anomaly, year FROM modal)
SELECT *, CASE WHEN modal_price IS NULL OR modal_price = 0 THEN 'MISSING_PRICE' WHEN min_price < 0 OR max_price < 0 OR modal_price < 0 THEN 'NEGATIVE_PRICE'
  WHEN min_price = 0 AND max_price = 0 THEN 'ZERO_MIN_MAX' WHEN max_price = 0 THEN 'ZERO_MAX' WHEN min_price > max_price THEN 'MIN_GT_MAX'
  WHEN modal_price < min_price OR modal_price > max_price THEN 'MODAL_OUTSIDE_RANGE' ELSE 'VALID' END AS quality_flag FROM made"""


@query("synthetic_workload", f"SELECT * FROM ({_workload()})")
def _(spark, d):
    f = flagged(spark, d)
    return synth.generate(synth.enrich(synth.skeleton(f), synth.profile(f, exact=True)), key=WORKLOAD_KEY)


@query("uniform_draws", f"SELECT DISTINCT state, district, market, commodity, variety, {U_ENTITY} AS u FROM market_report")
def _(spark, d):
    return profile.entity_catalog(market_report(spark, d)).withColumn("u", uniform(*S.ENTITY, salt="sample"))


@query("price_invariants", "SELECT count(*) AS n_records, count(*) FILTER (quality_flag = 'VALID' AND (min_price > modal_price OR modal_price > max_price)) AS broken_order, count(*) FILTER (min_price < 0 OR max_price < 0 OR modal_price < 0) AS broken_negative, count(*) FILTER (arrival_date IS NULL) AS broken_date, count(*) FILTER (data_source IS NULL OR data_source NOT IN ('real', 'synthetic_scaled')) AS broken_provenance FROM flagged")
def _(spark, d):
    return synth.invariants(flagged(spark, d))


COVER = " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, source_dataset FROM market_report" for c in S.DIMENSIONS)


@query("category_coverage", f"SELECT dimension, sum(r)::BIGINT AS n_real, sum(o)::BIGINT AS n_other, sum(r * o)::BIGINT AS n_common FROM (SELECT dimension, value, max((source_dataset = 'daily_market_prices')::INTEGER) AS r, max((source_dataset = 'india_mandi')::INTEGER) AS o FROM ({COVER}) WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    m = market_report(spark, d)
    return synth.category_coverage(merge.source(m, S.DAILY), merge.source(m, S.MANDI))


@query("quality_mix_compare", "SELECT quality_flag, n_real, n_other, round(100.0::DOUBLE * n_real / sum(n_real) OVER (), 4) AS pct_real, round(100.0::DOUBLE * n_other / sum(n_other) OVER (), 4) AS pct_other FROM (SELECT quality_flag, count(*) FILTER (source_dataset = 'daily_market_prices') AS n_real, count(*) FILTER (source_dataset = 'india_mandi') AS n_other FROM flagged GROUP BY 1)")
def _(spark, d):
    f = flagged(spark, d)
    return synth.quality_mix(merge.source(f, S.DAILY), merge.source(f, S.MANDI))


# Labels, splits, samples


@query("label_next_outlier", f"SELECT source_dataset, {KEY}, nxt::DOUBLE AS next_price_outlier FROM (SELECT *, lead(price_outlier::INTEGER) OVER (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date) AS nxt FROM marked WHERE source_dataset = 'daily_market_prices' AND arrival_date IS NOT NULL) WHERE nxt IS NOT NULL")
def _(spark, d):
    m = merge.source(marked(spark, d), S.DAILY).filter("arrival_date IS NOT NULL")
    return labels.next_outlier(m).select("source_dataset", *S.JOIN_KEY, "next_price_outlier")


@query("label_next_zscore", f"SELECT {KEY}, {settled_sql('next_z_score')}, target_anomaly FROM target")
def _(spark, d):
    return settled(target(spark, d).select(*S.JOIN_KEY, "next_z_score", "target_anomaly"), "next_z_score")


@query("target_audit", "SELECT count(*) AS n_records, count(*) FILTER (next_z_score IS NULL) AS null_next_z, count(*) FILTER (target_anomaly IS NULL) AS null_target, count(*) FILTER (target_anomaly = 0) AS target_0, count(*) FILTER (target_anomaly = 1) AS target_1 FROM labelled")
def _(spark, d):
    return labels.target_audit(featured(spark, d))


SPLIT = f"CASE WHEN year(arrival_date) < {VALIDATE} THEN 'train' WHEN year(arrival_date) < {TEST} THEN 'validation' ELSE 'test' END AS split"


@query("temporal_split", f"SELECT {KEY}, {SPLIT} FROM target")
def _(spark, d):
    return target(spark, d).select(*S.JOIN_KEY, labels.split_name(VALIDATE, TEST).alias("split"))


@query("class_prevalence", f"SELECT split, count(*) AS n_records, count(*) FILTER (target_anomaly = 1) AS n_positive, count(*) FILTER (target_anomaly = 0) AS n_negative, round(100.0::DOUBLE * count(*) FILTER (target_anomaly = 1) / count(*), 4) AS positive_pct FROM (SELECT *, {SPLIT} FROM target) GROUP BY split")
def _(spark, d):
    return labels.prevalence(target(spark, d), validate=VALIDATE, test=TEST)


@query("sampling_fractions", f"SELECT per_mille, count(*) AS n_entities, sum(n)::BIGINT AS n_records, sum(p)::BIGINT AS n_positive, round(100.0::DOUBLE * sum(p) / sum(n), 4) AS positive_pct FROM (SELECT *, unnest([10.0::DOUBLE, 50.0, 100.0]) AS per_mille FROM (SELECT {U_ENTITY} AS u, count(*) AS n, count(*) FILTER (target_anomaly = 1) AS p FROM target GROUP BY state, district, market, commodity, variety)) WHERE u < per_mille / 1000 GROUP BY 1")
def _(spark, d):
    return labels.sampling_fractions(target(spark, d), (10.0, 50.0, 100.0))


@query("entity_sample_checksum", f"SELECT sum(n)::BIGINT AS n_entities, md5(string_agg(p, '' ORDER BY part)) AS checksum FROM (SELECT substr(h, 1, 3) AS part, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS p FROM (SELECT DISTINCT md5(state || '|' || district || '|' || market || '|' || commodity || '|' || variety) AS h FROM market_report WHERE {U_ENTITY} < 0.1) GROUP BY 1)")
def _(spark, d):
    return labels.sample_checksum(profile.entity_catalog(labels.entity_sample(market_report(spark, d), 100.0)))


@query("poisson_sample")
def _(spark, d):
    return labels.poisson_sample(synth.skeleton(market_report(spark, d)).drop("commodity_group"), 0.5, 42)


# Metrics


def _rates(source: str, keep: str = "") -> str:
    """SQL that adds the rates to tp, tn, fp, fn."""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
    pr, re = share("tp", "tp + fp"), share("tp", "tp + fn")
    return f"""SELECT {keep}tp, tn, fp, fn, round({share("tp + tn", "tp + tn + fp + fn")}, 6) AS accuracy, round(({re} + {share("tn", "tn + fp")}) / 2, 6) AS balanced_accuracy, round({pr}, 6) AS precision, round({re}, 6) AS recall,
      round(CASE WHEN {pr} + {re} > 0 THEN 2 * ({pr}) * ({re}) / (({pr}) + ({re})) ELSE 0 END, 6) AS f1, round({share("fp", "fp + tn")}, 6) AS fpr FROM ({source})"""


def _counts(positive: str) -> str:
    return f"count(*) FILTER (target_anomaly = 1 AND {positive}) AS tp, count(*) FILTER (target_anomaly <> 1 AND NOT {positive}) AS tn, count(*) FILTER (target_anomaly <> 1 AND {positive}) AS fp, count(*) FILTER (target_anomaly = 1 AND NOT {positive}) AS fn"


SWEEP = _rates(f"SELECT threshold, {_counts('score >= threshold')} FROM (SELECT *, unnest([{', '.join(f'{t}::DOUBLE' for t in metrics.THRESHOLDS)}]) AS threshold FROM scored) GROUP BY threshold", "threshold, ")


@query("confusion_matrix", _rates(f"SELECT {_counts('score >= 0.5')} FROM scored"))
def _(spark, d):
    return metrics.confusion_matrix(scored(spark, d).withColumn("prediction", (F.col("score") >= 0.5).cast("double")))


@query("threshold_sweep", SWEEP)
def _(spark, d):
    return metrics.threshold_sweep(scored(spark, d))


def _rule(name: str, condition: str, best: tuple[str, ...]) -> str:
    order = ", ".join(f"{c} DESC" for c in best)
    return f"SELECT * FROM (SELECT '{name}' AS rule, ({condition}) AS met, threshold, f1, recall, precision, accuracy FROM sweep ORDER BY met DESC, {order}, threshold LIMIT 1)"


@query("threshold_selection", f"SELECT * FROM (WITH sweep AS ({SWEEP}) " + " UNION ALL ".join(_rule(k, c, b) for k, (c, b) in metrics.RULES.items()) + ")")
def _(spark, d):
    return metrics.select_thresholds(metrics.threshold_sweep(scored(spark, d)))


@query("class_weights", "SELECT label, n, round(sum(n) OVER () / (2.0::DOUBLE * n), 6) AS weight, round(sqrt(sum(n) OVER () / (2.0::DOUBLE * n)), 6) AS sqrt_weight FROM (SELECT target_anomaly AS label, count(*) AS n FROM target GROUP BY 1)")
def _(spark, d):
    return metrics.class_weights(target(spark, d))


@query("majority_baseline", "SELECT n_records, n_positive, round(greatest(n_positive, n_records - n_positive)::DOUBLE / n_records, 6) AS baseline_accuracy FROM (SELECT count(*) AS n_records, count(*) FILTER (target_anomaly = 1) AS n_positive FROM target)")
def _(spark, d):
    return metrics.majority_baseline(target(spark, d))


@query("forest_predictions")
def _(spark, d):
    train, _, test = labels.temporal_split(target(spark, d).select(*S.JOIN_KEY, "modal_price", *S.FEATURES, "target_anomaly"), VALIDATE, TEST)
    model = ml.pipeline(ml.random_forest(10, 5)).fit(train)
    return ml.score(model, test).select(*S.JOIN_KEY, "target_anomaly", "anomaly_probability", "anomaly_prediction")


# Streaming


STREAMED = ("previous_modal_price", "rolling_7_observation_avg", "rolling_7_observation_stddev", "z_score")


@query("stream_features", f"SELECT {KEY}, {settled_sql(*STREAMED)} FROM featured")
def _(spark, d):
    out = scoring.replayed_features(canonical(spark, d))
    return settled(out.select(*S.ENTITY, F.to_date("arrival_date").alias("arrival_date"), *STREAMED), *STREAMED)


def _zscore_share(rows: DataFrame) -> DataFrame:
    share = F.least(F.abs(F.coalesce("z_score", F.lit(0.0))) / 4, F.lit(1.0)).alias("anomaly_probability")
    out = settled(rows.select("*", share), "anomaly_probability")
    return out.withColumn("anomaly_prediction", (F.col("anomaly_probability") >= 0.5).cast("int"))


@query("stream_scored_sink", f"SELECT *, (anomaly_probability >= 0.5)::INTEGER AS anomaly_prediction FROM (SELECT {KEY}, modal_price, floor(least(abs(coalesce(z_score, 0)) / 4, 1) * 10000 + 0.5003::DOUBLE) / 10000 AS anomaly_probability FROM featured)")
def _(spark, d):
    """Events as files, a file stream, keyed state, scores and the Parquet sink, until the stream is at its end."""
    folder = work_folder(spark)
    events.write_events(events.to_json(canonical(spark, d)), f"{folder}/in", files=8)
    stream = events.usable(events.from_json(events.read_files(spark, f"{folder}/in", max_files=1000)))
    out = scoring.run_to_end(stream, _zscore_share, f"{folder}/out", f"{folder}/state")
    return out.select(*S.ENTITY, F.to_date("arrival_date").alias("arrival_date"), "modal_price", "anomaly_probability", "anomaly_prediction")


# Dashboard


for _name, _column in (("dash_top_states", "state"), ("dash_top_commodities", "commodity")):
    query(_name, f"SELECT {_column}, count(*) AS n_records FROM market_report GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda spark, d, c=_column: dashboard.top_counts(market_report(spark, d), c))


@query("dash_stream_kpis", "SELECT count(*) AS n_records, sum(anomaly_prediction)::BIGINT AS n_anomalies, round(100.0::DOUBLE * sum(anomaly_prediction) / count(*), 4) AS anomaly_pct, max(timestamp) AS last_timestamp, (SELECT anomaly_probability FROM stream_scored ORDER BY timestamp DESC, state DESC, district DESC, market DESC, commodity DESC, variety DESC LIMIT 1) AS last_probability FROM stream_scored")
def _(spark, d):
    return dashboard.stream_kpis(stream_scored(spark, d))


@query("dash_top_anomalous", "SELECT commodity, count(*) AS n_records FROM stream_scored WHERE anomaly_prediction = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return dashboard.top_anomalous(stream_scored(spark, d), "commodity")


@query("dash_recent_alerts", f"SELECT {KEY}, timestamp, modal_price, anomaly_probability, anomaly_prediction FROM stream_scored WHERE anomaly_prediction = 1 ORDER BY timestamp DESC, state, district, market, commodity, variety LIMIT 50")
def _(spark, d):
    return dashboard.recent_alerts(stream_scored(spark, d))


@query("dash_top_anomalous_markets", "SELECT market, count(*) AS n_records FROM stream_scored WHERE anomaly_prediction = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return dashboard.top_anomalous(stream_scored(spark, d), "market")


CHOSEN = {"states": ["ASIA", "EUROPE"], "commodities": ["ECONOMY", "PROMO"]}
IN_STATES, IN_COMMODITIES = (f"('{"', '".join(x)}')" for x in CHOSEN.values())


@query("dash_price_statistics", f"SELECT commodity, count(*) AS n_records, round(avg(modal_price), 4) AS avg_modal_price, max(modal_price) AS highest_modal_price FROM market_report WHERE commodity IN {IN_COMMODITIES} GROUP BY commodity ORDER BY commodity LIMIT 50")
def _(spark, d):
    return dashboard.price_statistics(profile.price_statistics(market_report(spark, d)), CHOSEN["commodities"]).select("commodity", "n_records", "avg_modal_price", "highest_modal_price")


@query("dash_filtered", f"SELECT state, count(*) AS n_records FROM stream_scored WHERE anomaly_prediction = 1 AND state IN {IN_STATES} GROUP BY 1")
def _(spark, d):
    return dashboard.top_anomalous(dashboard.live(stream_scored(spark, d), states=CHOSEN["states"]), "state")
