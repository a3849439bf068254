"""What the operators share."""

import gc
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marketlens.llm import common as C


def session(master, folder=None):
    got = []
    defined = SimpleNamespace(isDefined=lambda: bool(got), get=lambda: got[0])
    sc = SimpleNamespace(master=master, setCheckpointDir=got.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: defined)))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: folder))


def test_the_shared_folder_is_the_cluster_s_or_an_error():
    assert C.shared_folder(session("spark://a:7077", "hdfs://b/c")) == "hdfs://b/c"
    assert os.path.isdir(C.shared_folder(session("local[4]"))) and os.path.isdir(C.shared_folder(session("local")))
    for master in ("spark://a:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            C.shared_folder(session(master))


def test_stored_files_are_deleted(spark):
    df = C.stored(spark.range(5).toDF("x"))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(folder)
    C.discard(df)
    assert not os.path.exists(folder)


def test_a_filter_stays_above_settled_columns(spark):
    df = C.settled(spark.range(10).withColumn("y", F.expr("aggregate(sequence(0L, id), 0L, (a, x) -> a + x)")), [F.col("id"), F.col("y")])
    assert [r["y"] for r in df.filter("y > 30").orderBy("y").collect()] == [36, 45]
    plan = df.filter("y > 30")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.index("Filter") < plan.index("aggregate(")


def test_collection_is_on_again_after_an_error():
    with pytest.raises(ZeroDivisionError), C.uncollected():
        assert not gc.isenabled()
        1 / 0  # noqa: B018
    assert gc.isenabled()
