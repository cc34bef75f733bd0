import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from worktide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", "4g")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def values(spark):
    """Evaluate an expression over literal rows and return the results in order."""

    def run(make, rows, schema="s string"):
        from pyspark.sql import functions as F

        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"i int, {schema}")
        names = [c for c in df.columns if c != "i"]
        out = df.select("i", make(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.i)]

    return run
