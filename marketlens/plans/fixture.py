"""Market reports made of the driver's tables, with every quality class in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of lineitem with part, supplier, nation and region. Nation and region are of fixed size."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    p = F.col("l_extendedprice") / F.col("l_quantity")
    every = lambda n: F.col("l_orderkey") % n == 0
    columns = {
        "state": F.col("r_name"), "district": F.col("n_name"), "market": F.col("s_name"), "commodity": F.col("p_type"), "variety": F.col("l_returnflag"),
        "grade": F.col("p_brand"), "arrival_date": F.when(~every(67), F.to_date("l_shipdate")),
        "min_price": F.when(every(79), -p).when(every(97), 0.0).when(every(73), p * (1 + F.col("l_tax")) + 1).otherwise(p * (1 - F.col("l_discount"))),
        "max_price": F.when(every(97) | every(89), 0.0).when(every(73), p * (1 - F.col("l_discount"))).otherwise(p * (1 + F.col("l_tax"))),
        "modal_price": F.when(every(83), None).when(every(71), 10 * p).otherwise(p),
        "arrivals_tonnes": F.when(F.col("l_linestatus") == "O", F.col("l_quantity")), "commodity_group": F.lit(None),
        "source_dataset": F.when(F.col("l_linestatus") == "F", S.DAILY).otherwise(S.MANDI), "data_source": F.lit("real"),
    }
    return rows.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in S.CANONICAL))


MARKET_SQL = """
market_report AS (
  SELECT r_name AS state, n_name AS district, s_name AS market, p_type AS commodity, l_returnflag AS variety, p_brand AS grade,
    CASE WHEN l_orderkey % 67 <> 0 THEN l_shipdate::DATE END AS arrival_date,
    CASE WHEN l_orderkey % 79 = 0 THEN -p WHEN l_orderkey % 97 = 0 THEN 0.0::DOUBLE WHEN l_orderkey % 73 = 0 THEN p * (1 + l_tax) + 1 ELSE p * (1 - l_discount) END AS min_price,
    CASE WHEN l_orderkey % 97 = 0 OR l_orderkey % 89 = 0 THEN 0.0::DOUBLE WHEN l_orderkey % 73 = 0 THEN p * (1 - l_discount) ELSE p * (1 + l_tax) END AS max_price,
    CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN l_orderkey % 71 = 0 THEN 10 * p ELSE p END AS modal_price,
    CASE WHEN l_linestatus = 'O' THEN l_quantity END AS arrivals_tonnes, NULL::VARCHAR AS commodity_group,
    CASE WHEN l_linestatus = 'F' THEN 'daily_market_prices' ELSE 'india_mandi' END AS source_dataset, 'real' AS data_source
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
flagged AS (
  SELECT *, CASE WHEN arrival_date IS NULL THEN 'MISSING_DATE' WHEN modal_price IS NULL OR modal_price = 0 THEN 'MISSING_PRICE'
      WHEN min_price < 0 OR max_price < 0 OR modal_price < 0 THEN 'NEGATIVE_PRICE'
      WHEN (min_price IS NULL OR min_price = 0) AND (max_price IS NULL OR max_price = 0) THEN 'ZERO_MIN_MAX'
      WHEN max_price IS NULL OR max_price = 0 THEN 'ZERO_MAX' WHEN min_price > max_price THEN 'MIN_GT_MAX'
      WHEN modal_price < min_price OR modal_price > max_price THEN 'MODAL_OUTSIDE_RANGE' ELSE 'VALID' END AS quality_flag FROM market_report),
valid AS (SELECT * FROM flagged WHERE quality_flag = 'VALID'),
survivors AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY source_dataset, state, district, market, commodity, variety, arrival_date
      ORDER BY quality_flag <> 'VALID', coalesce(max_price - min_price, -1) DESC NULLS LAST, modal_price NULLS LAST, min_price NULLS LAST, max_price NULLS LAST,
        grade NULLS LAST, arrivals_tonnes NULLS LAST) AS rk FROM flagged) WHERE rk = 1),
bounds AS (
  SELECT *, CASE WHEN wide THEN 'wide_median' ELSE 'iqr' END AS bound_type, CASE WHEN wide THEN median / 10 ELSE greatest(p25 - 3 * iqr, 0) END AS lower_bound,
    CASE WHEN wide THEN median * 10 ELSE p75 + 3 * iqr END AS upper_bound
  FROM (SELECT *, p75 - p25 AS iqr, n_valid < 100 OR p75 - p25 <= 0 AS wide FROM (
    SELECT commodity, quantile_disc(modal_price, 0.25) AS p25, quantile_disc(modal_price, 0.75) AS p75, quantile_disc(modal_price, 0.5) AS median, count(*) AS n_valid
    FROM valid GROUP BY commodity))),
marked AS (
  SELECT s.*, coalesce(s.quality_flag = 'VALID' AND (s.modal_price > b.upper_bound OR s.modal_price < b.lower_bound), false) AS price_outlier
  FROM survivors s LEFT JOIN bounds b ON s.commodity IS NOT DISTINCT FROM b.commodity AND b.n_valid >= 10),
one AS (SELECT * FROM survivors WHERE quality_flag = 'VALID' AND source_dataset = 'daily_market_prices'),
two AS (SELECT * FROM survivors WHERE quality_flag = 'VALID' AND source_dataset = 'india_mandi'),
overlap AS (
  SELECT a.state, a.district, a.market, a.commodity, a.variety, a.arrival_date, a.modal_price AS price_1, a.arrivals_tonnes AS arrivals_1,
    b.modal_price AS price_2, b.arrivals_tonnes AS arrivals_2, CASE WHEN a.modal_price <> 0 THEN b.modal_price / a.modal_price END AS ratio
  FROM one a JOIN two b USING (state, district, market, commodity, variety, arrival_date)),
canonical AS (
  SELECT a.* EXCLUDE (arrivals_tonnes), coalesce(a.arrivals_tonnes, b.arrivals_tonnes) AS arrivals_tonnes, 'daily_market_prices' AS price_source_dataset,
    CASE WHEN b.state IS NOT NULL THEN 'india_mandi' ELSE 'daily_market_prices' END AS arrivals_source_dataset
  FROM one a LEFT JOIN two b USING (state, district, market, commodity, variety, arrival_date)
  UNION ALL BY NAME
  SELECT b.*, 'india_mandi' AS price_source_dataset, 'india_mandi' AS arrivals_source_dataset
  FROM two b ANTI JOIN one a USING (state, district, market, commodity, variety, arrival_date)),
featured AS (
  SELECT *, modal_price - previous_modal_price AS price_change,
    CASE WHEN previous_modal_price <> 0 THEN (modal_price - previous_modal_price) / previous_modal_price END AS price_change_pct,
    max_price - min_price AS price_range, CASE WHEN modal_price <> 0 THEN (max_price - min_price) / modal_price END AS relative_price_range,
    CASE WHEN modal_price <> 0 THEN previous_modal_price / modal_price END AS previous_to_current_ratio,
    CASE WHEN rolling_7_observation_stddev <> 0 THEN (modal_price - rolling_7_observation_avg) / rolling_7_observation_stddev END AS z_score
  FROM (
    SELECT *, lag(modal_price) OVER w AS previous_modal_price,
      avg(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7_observation_avg,
      stddev_samp(modal_price) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7_observation_stddev
    FROM canonical WINDOW w AS (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date))),
labelled AS (
  SELECT *, CASE WHEN abs(next_z_score) > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_anomaly FROM (
    SELECT *, lead(z_score) OVER (PARTITION BY state, district, market, commodity, variety ORDER BY arrival_date) AS next_z_score FROM featured)),
target AS (SELECT * FROM labelled WHERE next_z_score IS NOT NULL),
scored AS (
  SELECT state, district, market, commodity, variety, arrival_date, modal_price, target_anomaly, round(least(abs(coalesce(z_score, 0)) / 4, 1), 6) AS score FROM target),
stream_scored AS (
  SELECT state, district, market, commodity, variety, arrival_date, arrival_date::TIMESTAMP AS timestamp, modal_price, score AS anomaly_probability,
    (score >= 0.5)::INTEGER AS anomaly_prediction FROM scored),
price_model AS (
  SELECT source_dataset, commodity, market, log_mu, least(greatest(coalesce(s, 0.25), 0.05), 1.5) AS log_sigma, least(greatest(coalesce(r, 0.10), 0), 2) AS spread_ratio, n_obs
  FROM (SELECT source_dataset, commodity, market, avg(ln(modal_price)) AS log_mu, stddev_samp(ln(modal_price)) AS s,
      avg(CASE WHEN modal_price > 0 THEN (max_price - min_price) / modal_price END) AS r, count(*) AS n_obs FROM valid GROUP BY ALL)),
seasonal AS (
  SELECT commodity, month, least(greatest(m / a, 0.4), 2.5) AS seasonal_factor, n_obs
  FROM (SELECT commodity, month(arrival_date) AS month, quantile_disc(modal_price, 0.5) AS m, count(*) AS n_obs FROM valid GROUP BY ALL)
    JOIN (SELECT commodity, quantile_disc(modal_price, 0.5) AS a FROM valid GROUP BY ALL) USING (commodity)),
arrivals AS (
  SELECT commodity, arr_log_mu, least(greatest(coalesce(s, 0.5), 0.1), 2) AS arr_log_sigma, n_obs
  FROM (SELECT commodity, avg(ln(arrivals_tonnes)) AS arr_log_mu, stddev_samp(ln(arrivals_tonnes)) AS s, count(*) AS n_obs FROM flagged WHERE arrivals_tonnes > 0 GROUP BY ALL)),
rates AS (
  SELECT source_dataset, count(*) AS n_total, avg((quality_flag = 'ZERO_MIN_MAX')::INTEGER) AS rate_zero_min_max, avg((quality_flag = 'ZERO_MAX')::INTEGER) AS rate_zero_max,
    avg((quality_flag = 'MISSING_PRICE')::INTEGER) AS rate_missing_price, avg((quality_flag = 'MODAL_OUTSIDE_RANGE')::INTEGER) AS rate_modal_outside FROM flagged GROUP BY ALL),
skeleton AS (
  SELECT source_dataset, state, district, market, commodity, variety, grade, commodity_group, year(arrival_date)::BIGINT AS year, month(arrival_date)::BIGINT AS month
  FROM market_report WHERE arrival_date IS NOT NULL)"""


def with_market(sql: str) -> str:
    """A query over the tables above."""
    return f"WITH {MARKET_SQL}\n{sql}"
