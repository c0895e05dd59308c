from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

EVENT = "session long, aid long, ts long, type string"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def random_events(seed: int = 1, rows: int = 600, sessions: int = 12, items: int = 15, hot: float = 0.34):
    """Events with many equal times and copies; session 1 holds a third of all rows."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        session = 1 if rng.random() < hot else rng.randint(2, sessions)
        aid = 3 if rng.random() < hot else rng.randint(0, items)
        ts = 1_700_000_000_000 + rng.randint(0, 60) * 1_800_000
        out.append((session, aid, ts, rng.choice(["clicks", "clicks", "carts", "orders"])))
    return out + out[: rows // 10]


@pytest.fixture(scope="session")
def events(spark):
    return spark.createDataFrame(random_events(), EVENT)


@pytest.fixture(scope="session")
def event_rows():
    return random_events()
