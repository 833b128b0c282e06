import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stage(spark):
    """A stage that also keeps the plans of what it writes."""
    from recallspark.runtime import Stage

    class Recording(Stage):
        def __init__(self, spark):
            super().__init__(spark)
            self.plans = []

        def write(self, df, name):
            self.plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, name)

    with Recording(spark) as used:
        yield used
