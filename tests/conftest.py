import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tamis.session import build_session

    folder = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g",
                                                       "spark.checkpoint.dir": str(folder)})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
