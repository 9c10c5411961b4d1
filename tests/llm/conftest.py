import pytest


@pytest.fixture(scope="session")
def words(spark):
    return spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
