import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from protspark.session import local_session

    s = local_session("tests", cpus="4", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "3")  # tiny tables
    return s


@pytest.fixture
def small_groups(spark):
    """Make every group of more than five rows count as hot."""
    from protspark.functions.ordered import HOT_GROUP_CONF

    spark.conf.set(HOT_GROUP_CONF, "5")
    yield
    spark.conf.unset(HOT_GROUP_CONF)
