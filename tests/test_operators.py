"""Operators on small hand-made frames: nulls, zeros, NaN, ties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import features, labels, merge, metrics, ml, outliers, quality, synth

DAY = dt.date(2024, 1, 1)


def reports(spark, rows):
    """Canonical rows of dicts; what is left out is null, but for key parts."""
    base = {"state": "s", "district": "d", "market": "m", "commodity": "c", "variety": "v", "source_dataset": S.DAILY, "arrival_date": DAY, "data_source": "real"}
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in S.CANONICAL) for r in rows], S.CANONICAL)


@pytest.mark.parametrize(
    ("low", "high", "modal", "flag"),
    [
        (None, 5.0, 4.0, "VALID"), (None, 5.0, 9.0, "MODAL_OUTSIDE_RANGE"), (0.0, 5.0, 4.0, "VALID"), (None, -5.0, 4.0, "NEGATIVE_PRICE"),
        (-1.0, 5.0, None, "MISSING_PRICE"), (1.0, math.nan, 4.0, "VALID"), (math.nan, 5.0, 4.0, "MIN_GT_MAX"), (1.0, 5.0, math.nan, "MODAL_OUTSIDE_RANGE"),
        (0.0, 0.0, 900.0, "ZERO_MIN_MAX"), (6125.0, 0.0, 6125.0, "ZERO_MAX"), (1.0, 2.0, 0.0, "MISSING_PRICE"), (None, None, None, "MISSING_PRICE"), (9.0, 5.0, 6.0, "MIN_GT_MAX"),
    ],
)
def test_quality_flag(spark, low, high, modal, flag):
    assert quality.classify(reports(spark, [{"min_price": low, "max_price": high, "modal_price": modal}])).first()["quality_flag"] == flag


def test_missing_date_comes_first(spark):
    assert quality.classify(reports(spark, [{"arrival_date": None, "modal_price": -1.0}])).first()["quality_flag"] == "MISSING_DATE"


def test_survivor_is_valid_then_widest_and_order_is_total(spark):
    df = reports(spark, [{"min_price": 1.0, "max_price": 2.0, "modal_price": 1.5, "grade": g} for g in ("B", "A")] + [{"min_price": 1.0, "max_price": 99.0, "modal_price": 500.0}])
    out = quality.dedup_survivors(quality.classify(df)).collect()
    assert [r["grade"] for r in out] == ["A"]


def test_duplicate_stats_of_nothing_and_of_nulls(spark):
    assert tuple(quality.duplicate_stats(reports(spark, [])).first()) == (0, 0, 0)
    assert tuple(quality.duplicate_stats(reports(spark, [{"variety": None}] * 3)).first()) == (1, 1, 2)


# Golden rows (p25, p75, median, n_valid) -> (iqr, type, lower, upper).
GOLDEN = [
    ((1800.0, 4525.0, 3350.0, 464932), (2725.0, "iqr", 0.0, 12700.0)),
    ((5650.0, 7150.0, 6300.0, 92307), (1500.0, "iqr", 1150.0, 11650.0)),
    ((2751.0, 2890.0, 2800.0, 10), (139.0, "wide_median", 280.0, 28000.0)),
    ((120000.0, 125000.0, 125000.0, 5), (5000.0, "wide_median", 12500.0, 1250000.0)),
]


@pytest.mark.parametrize(("given", "want"), GOLDEN)
def test_bounds(spark, given, want):
    r = outliers.bounds_of(spark.createDataFrame([given], "p25 double, p75 double, median double, n_valid long")).first()
    assert (r["iqr"], r["bound_type"], r["lower_bound"], r["upper_bound"]) == want


def test_outlier_flag_is_strict_and_never_null(spark):
    rows = [{"commodity": c, "min_price": 1.0, "max_price": 1e9, "modal_price": p} for c, p in (("c", 100.0), ("c", 1000.0), ("c", 1001.0), ("few", 5e5), (None, 7.0))]
    df = quality.classify(reports(spark, rows))
    b = spark.createDataFrame([("c", 10.0, 1000.0, 10), ("few", 1.0, 2.0, 9), (None, 10.0, 20.0, 10)], "commodity string, lower_bound double, upper_bound double, n_valid long")
    got = {(r["commodity"], r["modal_price"]): r["price_outlier"] for r in outliers.flag_outliers(df, b).collect()}
    assert got == {("c", 100.0): False, ("c", 1000.0): False, ("c", 1001.0): True, ("few", 5e5): False, (None, 7.0): True}


def test_merge_takes_source_1_and_marks_arrivals(spark):
    ok = {"min_price": 1.0, "max_price": 9.0, "modal_price": 5.0}
    two = {"source_dataset": S.MANDI}
    df = reports(spark, [ok, ok | two | {"modal_price": 6.0, "arrivals_tonnes": None}, ok | two | {"market": "only2"}, ok | {"market": "only1"}])
    got = {r["market"]: (r["modal_price"], r["price_source_dataset"], r["arrivals_source_dataset"]) for r in merge.canonical_merge(quality.classify(df)).collect()}
    assert got == {"m": (5.0, S.DAILY, S.MANDI), "only2": (5.0, S.MANDI, S.MANDI), "only1": (5.0, S.DAILY, S.DAILY)}


def test_null_key_trips_the_gate(spark):
    ok = {"min_price": 1.0, "max_price": 9.0, "modal_price": 5.0, "variety": None}
    canonical = merge.canonical_merge(quality.classify(reports(spark, [ok, ok | {"source_dataset": S.MANDI}])))
    with pytest.raises(ValueError, match="not unique"):
        merge.require_unique(canonical)


def test_features_of_short_and_constant_series(spark):
    prices = [5.0] * 4 + [0.0, 6.0]
    df = reports(spark, [{"arrival_date": DAY + dt.timedelta(i), "modal_price": p, "min_price": 1.0, "max_price": 9.0} for i, p in enumerate(prices)])
    out = sorted(features.price_features(df).collect(), key=lambda r: r["arrival_date"])
    assert out[0]["previous_modal_price"] is None and out[1]["rolling_7_observation_stddev"] is None
    assert out[2]["rolling_7_observation_stddev"] == 0 and out[2]["z_score"] is None
    assert out[4]["relative_price_range"] is None and out[5]["price_change_pct"] is None
    assert out[5]["rolling_7_observation_avg"] == 4.0


def test_features_share_one_shuffle_and_one_sort(spark):
    plan = features.price_features(reports(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_year_ranges_reach_the_scan(spark, tmp_path):
    reports(spark, [{}]).write.parquet(str(tmp_path / "p"))
    plan = features.on_years(spark.read.parquet(str(tmp_path / "p")).select("arrival_date"), 2024, 2025)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(arrival_date,2024-01-01)" in plan and "ReadSchema: struct<arrival_date:date>" in plan


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = quality.dedup_survivors(quality.classify(reports(spark, [{}])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_label_drops_rows_without_a_next_z(spark):
    df = spark.createDataFrame([("s", "d", "m", "c", "v", DAY + dt.timedelta(i), z) for i, z in enumerate((1.0, 3.0, None, -2.5))], "state string, district string, market string, commodity string, variety string, arrival_date date, z_score double")
    got = [r["target_anomaly"] for r in labels.next_zscore(df).orderBy("arrival_date").collect()]
    assert got == [1.0, 1.0]


def test_sample_keeps_entities_whole(spark):
    df = reports(spark, [{"market": f"m{i % 50}", "arrival_date": DAY + dt.timedelta(i)} for i in range(500)])
    got = {r["market"]: r["count"] for r in labels.entity_sample(df, 300.0).groupBy("market").count().collect()}
    assert 5 < len(got) < 30 and set(got.values()) == {10}


def test_sweep_counts_every_row_once(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.5), (1.0, 0.2), (0.0, 0.1), (1.0, None)], "target_anomaly double, score double")
    got = {r["threshold"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in metrics.threshold_sweep(df, (0.2, 0.5, 0.95)).collect()}
    assert got == {0.2: (2, 1, 1, 0), 0.5: (1, 1, 1, 1), 0.95: (0, 2, 0, 2)}


def test_selection_falls_back(spark):
    sweep = metrics.threshold_sweep(spark.createDataFrame([(0.0, 0.5)], "target_anomaly double, score double"), (0.4,))
    got = {r["rule"]: r["met"] for r in metrics.select_thresholds(sweep).collect()}
    assert got["max_f1"] and not got["max_accuracy_recall_precision"]


def test_forest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*[float(i % 7 + j) for j in range(8)], float(i % 2) * 3, float(i % 2)) for i in range(200)] + [(*[None] * 9, 1.0)], ", ".join(f"{c} double" for c in S.FEATURES) + ", target_anomaly double")
    model = ml.pipeline(ml.random_forest(5, 3)).fit(df)
    ml.save(model, str(tmp_path / "m"))
    out = ml.score(ml.load(str(tmp_path / "m")), df)
    assert ml.areas(model, df)["areaUnderROC"] > 0.95 and ml.importances(model)[0][0] == "z_score"
    ml.save_predictions(out, str(tmp_path / "p"), 2)
    with pytest.raises(ValueError, match="rows"):
        ml.verify_predictions(spark, str(tmp_path / "p"), 7)
    assert ml.verify_predictions(spark, str(tmp_path / "p"), 201) == 201


def test_tuning_sweeps_each_candidate(spark):
    df = spark.createDataFrame([(*[float(i % 5)] * 8, float(i % 2), float(i % 2)) for i in range(60)], ", ".join(f"{c} double" for c in S.FEATURES) + ", target_anomaly double")
    got = ml.tune(df, df, [("a", 1.0, ml.random_forest(3, 2, weight="class_weight")), ("b", 2.0, ml.boosted_trees(2, 2, weight="class_weight"))], (0.3, 0.6))
    assert got.count() == 4 and got.select("model").distinct().count() == 2


def test_generated_workload_is_sound(spark, sf, tmp_path):
    from marketlens.plans.queries import flagged

    f = flagged(spark, sf)
    learned = {k: v.cache() for k, v in synth.profile(f).items()}
    made = synth.generate(synth.enrich(synth.skeleton(f), learned), key=["source_dataset", *S.DIMENSIONS, "year", "month"])
    checks = synth.verify(f.filter("quality_flag <> 'NEGATIVE_PRICE'"), made)
    assert all(checks.values()), checks
    assert made.filter("quality_flag IN ('MIN_GT_MAX', 'NEGATIVE_PRICE', 'MODAL_OUTSIDE_RANGE')").count() == 0
    assert synth.generate_to(f, learned, str(tmp_path / "w"), 1, 0.2) == 1
    assert spark.read.parquet(str(tmp_path / "w")).filter(F.col("year").isNull()).count() == 0
