import pytest
from pyspark.sql import SparkSession

from tessera.session import session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    built = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("OFF")
    return session()
