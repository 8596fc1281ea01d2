import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from funnelwise import build_session
    warehouse = tempfile.mkdtemp(prefix="funnelwise-warehouse-")
    session = build_session("local[*]", shuffle_partitions=8, extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()
