import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clientlens.session import local_session
    scratch = tempfile.mkdtemp(prefix="clientlens-test-")
    s = local_session(cores=4, shuffle_partitions=4, app="clientlens-tests",
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="clientlens-t-")
