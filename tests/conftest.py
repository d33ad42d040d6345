import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session("8")
    if not made.conf.get("spark.checkpoint.dir", None):
        made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield made
    made.stop()


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("the given tables are not here")
    return TABLES


@pytest.fixture(scope="session")
def three(spark):
    """Three articles whose weights are known."""
    rows = [(1, "cats chase mice"), (2, "Cats sleep."), (3, "")]
    return spark.createDataFrame(rows, "docid long, text string").repartition(2)
