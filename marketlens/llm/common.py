"""What the operators of this subpackage share: reading, lineage cuts and worker imports."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows or bytes up to which a side is broadcast; its size is checked first and beyond it another plan runs.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers on a shared file system import this package; elsewhere ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a single machine gets a folder of its own; a cluster an error,
    as its driver and executors see different folders."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared folder and read again: smaller than a checkpoint where rows hold texts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that a frame of `stored` reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, columns: list) -> DataFrame:
    """df.select(columns), computed once a row: no later filter or projection is merged into them. Merged, a condition
    would repeat the expressions of its columns inside their own lambdas, once an element."""
    held = F.when(F.monotonically_increasing_id() >= 0, F.struct(*columns))
    return df.select(held.alias("_held")).select("_held.*")


def slices(batches, rows: int):
    """Arrow batches in parts of so many rows, so that what Python makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def uncollected():
    """No collection passes inside: for millions of strings and tuples without cycles."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def give_back() -> None:
    """Return what a Python worker has freed to the system, for the tasks that follow in it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
