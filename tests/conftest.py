import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    return session("8", "4")


@pytest.fixture
def small_tasks(spark):
    """Make every key too large for one task and every side too large to broadcast."""
    spark.conf.set("gridlake.window.rowsPerTask", "7")
    spark.conf.set("gridlake.broadcast.maxRows", "1")
    yield
    spark.conf.unset("gridlake.window.rowsPerTask")
    spark.conf.unset("gridlake.broadcast.maxRows")
