import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def pytest_configure(config):
    config.addinivalue_line("markers", "data: needs the tables of the driver")


DATA = "/root/testdata"


def compare(frame, sql, directory):
    """Rows and columns of ``frame`` and of ``sql`` run by DuckDB on the tables of ``directory``, in comparable form."""
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(directory):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{directory}/{f}'")
    cursor = c.execute(sql)
    columns = [d[0] for d in cursor.description]

    def form(rows, names):
        order = sorted(range(len(names)), key=names.__getitem__)
        cells = [tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
        return sorted(names), sorted(cells)

    return form([tuple(r) for r in frame.collect()], frame.columns), form(cursor.fetchall(), columns)
