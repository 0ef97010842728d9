import os
import sys
import time

import pytest

# Naive datetimes of test data mean UTC.
os.environ["TZ"] = "UTC"
time.tzset()

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugelake.session import local_session  # noqa: E402
from gaugelake.sources.kafka import MESSAGE_SCHEMA  # noqa: E402
from times import utc  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make_messages(spark):
    """Messages from (topic, offset, value[, timestamp[, timestampType]]) tuples."""

    def make(*rows):
        full = []
        for row in rows:
            topic, offset, value, ts, kind = (*row, utc(2024, 1, 1), 1)[:5] if len(row) < 4 else (*row, 1)[:5]
            if isinstance(value, str):
                value = value.encode()
            full.append((None, value if value is None else bytearray(value), topic, 0, offset, ts, kind))
        return spark.createDataFrame(full, MESSAGE_SCHEMA)

    return make
