import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortlake.session import get_spark

    s = get_spark(
        app_name="cohortlake-tests",
        master="local[4]",
        shuffle_partitions=8,
        extra={"spark.default.parallelism": "8"},
    )
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cl-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="cl-test-")
