import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("VELLUM_DRIVER_MEMORY", "8g")

SF = os.environ.get("VELLUM_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from vellum.session import get_spark
    s = get_spark("local[*]", app="vellum-tests", shuffle_partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vellum-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="vellum-test-")
