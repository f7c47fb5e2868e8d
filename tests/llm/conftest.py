import pytest


@pytest.fixture
def table(spark):
    """A small DataFrame from rows and a schema, over a few partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
