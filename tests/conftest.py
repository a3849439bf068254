import os
import sys
import tempfile
import warnings

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
warnings.filterwarnings("ignore", category=DeprecationWarning)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")).config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    env = s.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join([ROOT, env.get("PYTHONPATH", "")])
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df):
    """Rows of a Spark or DuckDB frame as sorted tuples of comparable text, columns by name."""
    p = df.toPandas() if hasattr(df, "toPandas") else df
    p = p[sorted(p.columns)]

    def text(x):
        if x is None or x != x:
            return "-"
        if hasattr(x, "isoformat"):
            return str(x)[:10] if str(x)[10:] in ("", " 00:00:00") else str(x)
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(int(x))
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple("-" if str(x) in ("NaT", "<NA>") else text(x) for x in r) for r in p.itertuples(index=False))
