"""Readers, sinks and streams on generated files."""

import datetime as dt

from marketlens import schema as S
from marketlens.plans import pipelines
from marketlens.sources import readers, sinks
from marketlens.streaming import events, scoring


def test_daily_reader(spark, tmp_path):
    head = "State,District,Market,Commodity,Variety,Grade,Arrival_Date,Min_Price,Max_Price,Modal_Price,Commodity_Code\n"
    (tmp_path / "2001.csv").write_text(head + '  Uttar   Pradesh ,NA,M,"Sesamum (Sesame,Gingelly,Til)",-,N/A,2001-02-03,1400,3200.0,x,7\n')
    (tmp_path / "2002.csv").write_text(head + "A,B,C,D,E,F,2002-13-45,1,2,3,7\nA,B\n")
    got = sorted(readers.read_daily(spark, [str(tmp_path / f"{y}.csv") for y in (2001, 2002)]).collect(), key=lambda r: (r["arrival_date"] is None, r["commodity"] or ""))
    assert got[0]["state"] == "Uttar Pradesh" and got[0]["district"] is None and got[0]["commodity"] == "Sesamum (Sesame,Gingelly,Til)"
    assert (got[0]["min_price"], got[0]["max_price"], got[0]["modal_price"]) == (1400.0, 3200.0, None) and got[0]["arrival_date"] == dt.date(2001, 2, 3)
    assert [r["arrival_date"] for r in got[1:]] == [None, None] and got[0].__fields__ == S.CANONICAL.names


def test_mandi_reader_binds_by_position_and_takes_the_file_name(spark, tmp_path):
    one = "State Name,District Name,Market Name,Variety,Group,Arrivals (Tonnes),Min Price (Rs./Quintal),Max Price (Rs./Quintal),Modal Price (Rs./Quintal),Reported Date\n"
    two = "State_Name,District_Name,Market_Name,Variety,Group,Arrivals,Min_Price,Max_Price,Modal_Price,Reported_Date\n"
    (tmp_path / "Arhar Dal(Tur Dal).csv").write_text(one + "S,D,M,V,Pulses,1.5,10,20,15,05 Feb 2023\n")
    (tmp_path / "C++ seed.csv").write_text(two + "S,D,M,V,null,2,10,20,15,2023-02-06\n")
    (tmp_path / "Empty.csv").write_text("\n")
    got = {r["commodity"]: r for r in readers.read_mandi(spark, str(tmp_path)).collect()}
    assert set(got) == {"Arhar Dal(Tur Dal)", "C++ seed"}
    assert got["Arhar Dal(Tur Dal)"]["arrival_date"] == dt.date(2023, 2, 5) and got["C++ seed"]["arrival_date"] == dt.date(2023, 2, 6)
    assert got["C++ seed"]["commodity_group"] is None and got["C++ seed"]["grade"] is None and got["C++ seed"]["source_dataset"] == S.MANDI


def test_preprocess_writes_years_and_quarantine(spark, sf, tmp_path):
    from marketlens.plans.fixture import market_report

    got = pipelines.preprocess_to(market_report(spark, sf), str(tmp_path / "out"))
    assert got["undated"] > 0 and got["written"] + got["undated"] <= got["raw"]
    assert sinks.read_back(spark, str(tmp_path / "out_undated")).count() == got["undated"]
    assert sinks.size_of(spark, str(tmp_path / "out")) > 0
    sinks.clear(spark, str(tmp_path / "out"))
    assert sinks.size_of(spark, str(tmp_path / "out")) == 0
    sinks.write_report(sinks.rows_of(spark, [("a", 1)], ["k", "v"]), str(tmp_path / "r"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "r"))
    assert back.collect()[0]["k"] == "a" and len(sinks.describe(back)["files"]) == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    """Events in date order through keyed state give the batch features."""
    from marketlens.operators.features import price_features
    from marketlens.plans.queries import canonical

    reports = canonical(spark, sf).filter("market IN ('Supplier#000000001', 'Supplier#000000002')").select(*S.JOIN_KEY, "min_price", "max_price", "modal_price").cache()
    src = str(tmp_path / "in")
    for first, end in ((1990, 1998), (1998, 2010)):  # two files, two micro-batches
        batch = reports.filter(f"year(arrival_date) >= {first} AND year(arrival_date) < {end}")
        events.write_events(events.to_json(batch), src)
    spark.createDataFrame([('{"state": "s", "modal_price": 5}',), ("no json",)], "value string").coalesce(1).write.mode("append").text(src)
    import os
    import time

    names = sorted((f for f in os.listdir(src) if f.endswith(".txt")), key=lambda f: os.path.getmtime(f"{src}/{f}"))
    for i, f in enumerate(names):  # files are read by age
        os.utime(f"{src}/{f}", (time.time() - 100 + i, time.time() - 100 + i))
    parsed = events.from_json(events.read_files(spark, src))
    q = scoring.stream_features(events.usable(parsed)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["market"], r["commodity"], r["variety"], r["arrival_date"]): r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    want = price_features(reports).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w["market"], w["commodity"], w["variety"], str(w["arrival_date"])]
        for c in S.FEATURES:
            assert (g[c] is None) == (w[c] is None), (c, g, w)
            assert g[c] is None or abs(g[c] - w[c]) <= 1e-6 * max(1, abs(w[c]))
