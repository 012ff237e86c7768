import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).parent
sys.path[:0] = [str(HERE), str(HERE.parent)]
os.environ["PYTHONPATH"] = f"{HERE}:{HERE.parent}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

from framewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
