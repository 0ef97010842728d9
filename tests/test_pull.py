"""The pull job."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugelake.plans import pull as P
from gaugelake.sources import incremental as I

T0 = datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")

    def add(first, last):
        rows = [(i, T0 + timedelta(seconds=i // 2)) for i in range(first, last)] + [(-1, None)]  # two rows have one time
        spark.createDataFrame(rows, "id bigint, timestamp timestamp_ntz").write.mode("append").parquet(path)

    return add, P.StoredTable("sensor_data", lambda s: s.read.parquet(path))


def pulled(spark, target):
    return sorted(r.id for r in spark.read.parquet(target).collect())


def test_pulls_take_each_row_once(spark, source, tmp_path):
    add, table = source
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    add(0, 100)
    assert P.high_water(spark, state, "sensor_data") is None
    assert P.pull(spark, table, target, state) == 100
    assert P.high_water(spark, state, "sensor_data") == T0 + timedelta(seconds=49)
    assert P.pull(spark, table, target, state) == 0
    add(100, 130)
    assert P.pull(spark, table, target, state) == 30
    assert pulled(spark, target) == list(range(130))
    assert P.high_water(spark, state, "another") is None


def test_a_pull_that_breaks_off_is_repeated(spark, source, tmp_path, monkeypatch):
    add, table = source
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    add(0, 10)
    P.pull(spark, table, target, state)
    add(10, 20)
    with monkeypatch.context() as patch:
        patch.setattr(P.lake, "read_folders", lambda *_: 1 / 0)  # rows are there, the mark is not
        with pytest.raises(ZeroDivisionError):
            P.pull(spark, table, target, state)
    add(20, 30)
    assert P.pull(spark, table, target, state) == 20
    assert pulled(spark, target) == list(range(30))


def test_empty_source(spark, tmp_path):
    empty = P.StoredTable("none", lambda s: s.createDataFrame([], "id bigint, timestamp timestamp"))
    assert P.pull(spark, empty, str(tmp_path / "target"), str(tmp_path / "state")) == 0
    assert not (tmp_path / "target").exists()


def test_the_database_answers_for_its_bounds(monkeypatch):
    assert I.bounds_query("t", "ts") == "(SELECT MIN(ts) AS low, MAX(ts) AS high FROM t) AS bounds"
    assert "WHERE ts > TIMESTAMP '2024-01-01 00:00:00'" in I.bounds_query("t", "ts", T0)
    # the pull is split between the bounds that the database named
    options = I.jdbc_options("jdbc:x", "t", "ts", T0, T0 + timedelta(days=1))
    assert options["partitionColumn"] == "ts" and options["lowerBound"] == "2024-01-01 00:00:00" and options["numPartitions"] == "16"


def test_jdbc_pull_over_the_source_interface(spark, tmp_path):
    """The JDBC source against a reader that records what it is asked for."""
    asked = []
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(5)], "id bigint, timestamp timestamp")

    class Reader:
        def format(self, kind):
            return self

        def options(self, **options):
            asked.append(options)
            return self

        def load(self):
            if "MIN(" in asked[-1]["dbtable"]:
                return rows.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
            return rows

    class Session:
        read = Reader()

    table = P.JdbcTable("jdbc:x", "sensor_data", user="u")
    bounds = table.newest(Session, None)
    assert bounds == (T0, T0 + timedelta(hours=4))
    assert table.rows(Session, None, bounds).count() == 5
    assert table.rows(Session, T0 + timedelta(hours=2), bounds).count() == 2
    # a first pull is split as well: its bounds are known
    assert asked[1]["lowerBound"] == "2024-01-01 00:00:00" and asked[1]["upperBound"] == "2024-01-01 04:00:00" and asked[1]["user"] == "u"
