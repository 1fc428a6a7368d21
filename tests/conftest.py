import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from sitegrain.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("sitegrain-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session, str(Path(__file__).resolve().parent / "extractors.py"))
    session.stop()


def rows(df, *names):
    """Rows as sorted tuples."""
    return sorted(tuple(row) for row in (df.select(*names) if names else df).collect())


@pytest.fixture
def urls_frame(spark):
    def make(*urls, name="url"):
        return spark.createDataFrame([(url,) for url in urls], f"{name} string")

    return make
