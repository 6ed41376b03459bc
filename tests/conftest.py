import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, **{
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "localhost"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_cells(spark):
    """Cut ranks into many cells, as large inputs are."""
    spark.conf.set("sievewright.cell.rows", "40")
    yield
    spark.conf.unset("sievewright.cell.rows")
