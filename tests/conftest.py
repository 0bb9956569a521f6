import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weft.session import checkpoint_dir, get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="weft-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
    s.stop()
