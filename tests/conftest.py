import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparklayout.sources.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, partitions=4, memory="4g", **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()
