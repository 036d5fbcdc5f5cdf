import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kerbline.testing import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kerbline-test-"))
    yield s
    s.stop()
