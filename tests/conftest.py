import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from larder.session import get_spark
    s = get_spark("local[4]", 4, app="larder-tests")
    # Tests own their checkpoint folder; on a cluster it comes from spark.checkpoint.dir.
    if s.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
