import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sitelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression over literal columns: value(fn, 'a', 'b') is fn(lit('a'), lit('b'))."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        # A real row instead of literals, so that nothing is folded away before it runs.
        row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
        return row.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return run
