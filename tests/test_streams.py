"""Keyed state, scores and sinks on file streams; the dashboard's filters; checks that fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens import schema as S
from marketlens.operators import dashboard, features, labels, ml, synth
from marketlens.plans.queries import canonical, flagged
from marketlens.session import work_folder
from marketlens.streaming import events, scoring


def test_rolled_equals_brute_force():
    r = np.random.default_rng(2)
    prices, cuts = r.normal(size=60), sorted(r.choice(60, 12, replace=False).tolist())
    first = np.array([max([c for c in cuts if c <= i], default=0) for i in range(60)])
    got = scoring.rolled(prices, first)
    for i in range(60):
        own = prices[max(first[i], i - features.WINDOW_ROWS) : i]
        prev, mean, sd = (x[i] for x in got.values())
        assert np.isnan(prev) if not len(own) else prev == own[-1] and abs(mean - own.mean()) < 1e-12
        assert np.isnan(sd) if len(own) < 2 else abs(sd - own.std(ddof=1)) < 1e-12
    assert all(len(x) == 0 for x in scoring.rolled(np.empty(0), np.empty(0, int)).values())


def test_state_goes_on_between_batches():
    frame = pd.DataFrame({"arrival_date": [f"2024-01-{d:02}" for d in range(1, 21)], "event_timestamp": 0, "modal_price": np.arange(20.0) ** 2})
    whole, last = scoring.step(frame, [])
    one, history = scoring.step(frame[:9].sample(frac=1, random_state=1), [])
    two, end = scoring.step(frame[9:], history)
    assert last == end and len(end) == features.WINDOW_ROWS
    pd.testing.assert_frame_equal(pd.concat([one, two]), whole)


def test_replay_carries_prices_over_batches(spark, sf):
    rows = canonical(spark, sf)
    want = scoring.replayed_features(rows).select(*S.JOIN_KEY, *scoring.ROLLED).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = scoring.replayed_features(rows).select(*S.JOIN_KEY, *scoring.ROLLED).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    close = lambda a, b: a == b or a is not None and b is not None and abs(a - b) < 1e-9 * max(1, abs(a))
    key = lambda r: tuple(map(str, r[:6]))
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert key(a) == key(b) and all(map(close, a[6:], b[6:]))


def test_a_model_scores_a_stream_as_it_scores_a_table(spark, sf, tmp_path):
    rows = canonical(spark, sf).filter("year(arrival_date) = 1996").cache()
    batch = scoring.replayed_features(rows)
    model = ml.pipeline(ml.random_forest(3, 3)).fit(labels.next_zscore(features.price_features(canonical(spark, sf))))
    events.write_events(events.to_json(rows), str(tmp_path / "in"), files=3)
    stream = events.usable(events.from_json(events.read_files(spark, str(tmp_path / "in"), max_files=100)))
    out = scoring.run_to_end(stream, lambda df: ml.score(model, df), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.columns == ["timestamp", *S.ENTITY, "arrival_date", "modal_price", "anomaly_probability", "anomaly_prediction"]
    key = [*S.ENTITY, "arrival_date"]
    a = {tuple(r[:6]): (round(r[6], 9), r[7]) for r in out.select(*key, "anomaly_probability", "anomaly_prediction").collect()}
    b = {tuple(r[:6]): (round(r[6], 9), r[7]) for r in ml.score(model, batch).select(*key, "anomaly_probability", "anomaly_prediction").collect()}
    assert a == b and len(a) == rows.count()
    again = scoring.run_to_end(stream, lambda df: ml.score(model, df), str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == len(a)  # the checkpoint knows what was scored


def test_rejected_events_are_the_others(spark):
    good = '{"state":"s","district":"d","market":"m","commodity":"c","variety":"v","arrival_date":"2024-01-01","modal_price":3.5}'
    raw = spark.createDataFrame([(good,), (good.replace("3.5", "null"),), ("no json",), (None,), (good.replace('"market":"m",', ""),)], "value string").withColumn("timestamp", F.current_timestamp())
    parsed = events.from_json(raw)
    assert (events.usable(parsed).count(), events.rejected(parsed).count()) == (1, 4)


def test_kafka_options():
    assert events.kafka_options("a:1,b:2", "prices") == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "prices", "startingOffsets": "earliest"}


def test_dashboard_filters(spark):
    rows = spark.createDataFrame([("a", "m1", "c1", 1), ("a", "m2", "c2", 1), ("b", "m1", "c1", 0), ("b", "m1", "c2", 1), (None, "m3", "c1", 1)], "state string, market string, commodity string, anomaly_prediction int")
    assert [tuple(r) for r in dashboard.top_counts(rows, "state", within=["b"]).collect()] == [("b", 2)]
    assert dashboard.live(rows).count() == 5 and dashboard.live(rows, ["a"], ["c1"]).count() == 1
    assert [tuple(r) for r in dashboard.top_anomalous(rows, "market").collect()] == [("m1", 2), ("m2", 1), ("m3", 1)]
    stats = spark.createDataFrame([(f"c{i:03}", i) for i in range(80)], "commodity string, n_records int")
    assert [r[0] for r in dashboard.price_statistics(stats).collect()] == [f"c{i:03}" for i in range(50)]
    assert [r[1] for r in dashboard.price_statistics(stats, ["c070", "c007"]).collect()] == [7, 70]


def test_dashboard_loads_what_is_there(spark, tmp_path):
    path = str(tmp_path / "d")
    assert dashboard.load(spark, path, "state string, n_records long").count() == 0
    spark.createDataFrame([("a", 3, 1.0)], "state string, n_records long, more double").write.parquet(path)
    got = dashboard.load(spark, path, "state string, n_records long")
    assert got.columns == ["state", "n_records"] and [tuple(r) for r in got.collect()] == [("a", 3)]


def test_poisson_sample_draws_with_replacement(spark):
    rows = spark.range(0, 20_000, 1, 4)
    drawn = labels.poisson_sample(rows, 0.5, 42).groupBy("id").count().cache()
    total = drawn.agg(F.sum("count")).first()[0]
    assert abs(total - 10_000) < 5 * 100 and drawn.filter("count > 1").count() > 1000  # 1 - 1.5 exp(-1/2) of the rows: 1,804
    assert labels.poisson_sample(rows, 0.5, 42).agg(F.sum("id")).first() == labels.poisson_sample(rows, 0.5, 42).agg(F.sum("id")).first()
    assert labels.poisson_sample(rows, 0.5, 43).agg(F.sum("id")).first() != labels.poisson_sample(rows, 0.5, 42).agg(F.sum("id")).first()


def test_hash_sample_keeps_entities_whole(spark):
    df = spark.range(2000).select(*(F.concat(F.lit(c[0]), F.col("id") % 100).alias(c) for c in S.ENTITY))
    got = {r["count"] for r in df.filter(labels.in_sample(300.0, hash_only=True)).groupBy(*S.ENTITY).count().collect()}
    assert got == {20}


def test_wide_grid():
    names = [n for n, _, _ in ml.wide_grid()]
    assert len(names) == len(set(names)) == 60 and names[0] == "rf_50x6_w1" and len(ml.WIDE_THRESHOLDS) == 10


def test_unsound_workloads_are_errors(spark, sf, tmp_path):
    f = flagged(spark, sf)
    with pytest.raises(ValueError, match="copies"):
        synth.require_sound(f, f.withColumn("synthetic_injected_anomaly", F.lit(False)))
    learned = {k: v.cache() for k, v in synth.profile(f).items()}
    with pytest.raises(RuntimeError, match="1 batches"):
        synth.generate_to(f, learned, str(tmp_path / "w"), 1 << 40, 0.1, max_batches=1)


def test_work_folder_is_the_cluster_s(spark):
    from types import SimpleNamespace

    def on(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert work_folder(spark) != work_folder(spark)
    assert work_folder(on("spark://host:7077", "hdfs://x/shared/")).startswith("hdfs://x/shared/")
    assert work_folder(on("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            work_folder(on(master))
