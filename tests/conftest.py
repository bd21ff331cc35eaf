import os
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordweave.session import local_session  # noqa: E402


# started on import, since test modules build columns at module level
SPARK = local_session(8, "tests", partitions=4, checkpoint_dir=tempfile.gettempdir() + "/recordweave-tests")
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over one row of named strings or numbers."""

    def run(expr, **row):
        kinds = {float: "double", int: "bigint"}
        df = spark.range(1).select(*[F.lit(v).cast(kinds.get(type(v), "string")).alias(k) for k, v in row.items()] or ["id"])
        return df.select(expr.alias("out")).first()["out"]

    return run
