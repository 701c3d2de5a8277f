import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, 'tests'))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from mathtide.session import get_session, remove_scratch
    s = get_session("local[4]", shuffle_partitions=4,
                    conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="mathtide-test-ckpt-")})
    yield s
    remove_scratch(s)
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="mathtide-test-")
