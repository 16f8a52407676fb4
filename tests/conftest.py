import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidetable.session import build

    folder = tmp_path_factory.mktemp("spark")
    session = build("tests", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(folder / "shared"), "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.log.level": "ERROR"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
