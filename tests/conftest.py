import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT / 'tests'}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import session

    got = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/folioforge-warehouse"})
    got.sparkContext.setLogLevel("ERROR")
    yield got
    got.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF
