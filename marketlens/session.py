"""Session settings of the engine."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that change results or plans; masters, memory and partitions are the deployment's.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}


def session(app: str = "marketlens", **conf: str) -> SparkSession:
    """The running session, or a new one with these settings; local unless a master is configured."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A folder for files between jobs: the checkpoint folder of the cluster, or on a single machine one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="work-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> None:
    """Let Python workers on a shared file system import this package; elsewhere ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
