import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sourcemine.packaging import ship_package

    session = (
        SparkSession.builder.master("local[8]")
        .appName("sourcemine-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sourcemine-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Source files from ``{path: text}`` or ``{(repo, path): text}``."""

    def build(texts):
        rows = [
            (*(key if isinstance(key, tuple) else ("repo", key)), text)
            for key, text in texts.items()
        ]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return build
