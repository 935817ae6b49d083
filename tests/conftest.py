import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).iterdir():
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Rows of a registered query and of its SQL, sorted, on the smallest tables."""

    def run(query, sql):
        frame = query(spark, SMALL)
        columns = sorted(frame.columns)
        got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in frame.collect()), key=repr)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in found.fetchall()), key=repr)
        assert got == want
        return got

    return run
