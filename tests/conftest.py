import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from mirrorset.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "mirrorset-tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a column function over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(function, values):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, "i int, x string")
        out = df.select("i", function(F.col("x")).alias("o")).collect()
        return [r["o"] for r in sorted(out, key=lambda r: r["i"])]

    return run
