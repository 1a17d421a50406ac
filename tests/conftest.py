import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column expression over one row."""

    def value(column, **columns):
        from pyspark.sql import functions as F

        frame = spark.range(1).select(*[(c if hasattr(c, "_jc") else F.lit(c)).alias(k) for k, c in columns.items()]) if columns else spark.range(1)
        got = frame.select(column.alias("v")).first()["v"]
        return got

    return value
