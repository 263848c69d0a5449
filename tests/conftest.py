from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rollbook.session import local_session

    s = local_session(cores=4, app="tests", memory="3g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
