import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from plotwise.session import build_session

    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def many_chunks(spark):
    """Every second row becomes a cut point, so pieces are tiny."""
    spark.conf.set("plotwise.cut.rate", "2")
    yield
    spark.conf.unset("plotwise.cut.rate")
