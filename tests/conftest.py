import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltstone.session import session

    out = session("local[4]", 4, spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
