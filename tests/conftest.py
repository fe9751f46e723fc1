import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def pixels(spark):
    """Make pixels from drawings: {image: [row strings]}, digits are labels."""

    def make(images):
        rows = [(name, y, x, int(c)) for name, lines in images.items() for y, line in enumerate(lines) for x, c in enumerate(line)]
        return spark.createDataFrame(rows, "image_id string, y int, x int, label int")

    return make
