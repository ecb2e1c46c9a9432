import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.log.level": "ERROR"}
    return SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
