import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows_of(frame):
    """Rows as sorted text, columns by name: what the two engines must agree on."""

    def one(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return str(list(v))
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return int(v)
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(one(v) for v in r)) for r in frame.astype(object).itertuples(index=False, name=None))
