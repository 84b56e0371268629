import pytest

from pagemill import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression of ``x`` over a list of Python values."""
    from pyspark.sql import functions as F

    def run(build, items, kind="string"):
        frame = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
        rows = frame.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in rows]

    return run
