import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from kontor.session import local_session

    session = local_session(8, shuffle_partitions=4, app="kontor-tests")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.formatVersion", "5")
    yield session
    session.stop()
