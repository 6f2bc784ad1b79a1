import pytest

from hostloom.session import local_session

SMALL = "/root/testdata/sf0.001"


#: Started on import: column expressions at the top of a test module need a session.
SPARK = local_session("tests", cores=8, shuffle=4)


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate one column expression over one row of named values."""

    def run(expression, schema="x int", values=(1,)):
        return spark.createDataFrame([tuple(values)], schema).select(expression.alias("out")).collect()[0][0]

    return run
