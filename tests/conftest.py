from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from planeforge.session import ship

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(tables):
    """A DuckDB connection with the driver's tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return con


@pytest.fixture
def same(duck):
    """Asserts that a frame holds exactly the rows of an SQL query."""

    def check(df, sql: str) -> None:
        duck.register("mine", df.toArrow())
        names = ", ".join(f'"{r[0]}"' for r in duck.execute("DESCRIBE mine").fetchall())
        kinds = [dict((r[0], r[1]) for r in duck.execute(f"DESCRIBE {q}").fetchall()) for q in ("mine", sql)]
        assert kinds[0] == kinds[1]
        left, right = (f"(SELECT {names} FROM ({sql}))", f"(SELECT {names} FROM mine)")
        for a, b in ((left, right), (right, left)):
            assert duck.execute(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall() == []
        duck.unregister("mine")

    return check
