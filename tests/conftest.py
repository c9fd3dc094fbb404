import datetime as dt

import pytest
from pyspark.sql import SparkSession

from duewise.schema import RECORDS


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def records(spark):
    """Makes records from (uid, debtor, creditor, cents, first day, last day) with days counted from 2025-01-01 as 1."""

    def make(rows, cohort="2025"):
        day = lambda k: dt.date(2025, 1, 1) + dt.timedelta(days=k - 1)
        return spark.createDataFrame([(u, f"company:{a}", f"company:{b}", q, day(i), day(j), "", "", "", cohort) for u, a, b, q, i, j in rows], RECORDS)

    return make


@pytest.fixture(scope="session")
def six(records):
    return records([("r1", "A", "B", 10000, 1, 10), ("r2", "B", "C", 8000, 3, 8), ("r3", "C", "A", 5000, 5, 9), ("r4", "D", "B", 6000, 2, 4), ("r5", "B", "E", 6000, 2, 4), ("r6", "F", "G", 3000, 6, 12)])
