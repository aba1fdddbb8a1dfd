import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import CLASHES, ODD  # noqa: E402

from mirrorset.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "mirrorset-llm-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, repeated ids, and columns with common names."""
    from pyspark.sql import functions as F

    rows = [(i, t, "en" if i != 7 else None, "s", len(t or "")) for i, t in ODD]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.select("*", *(F.lit("x").alias(c) for c in CLASHES)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
