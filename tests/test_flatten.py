import json

import pytest
from pyspark.sql import functions as F

from gaugelake.operators import flatten as FL
from gaugelake.operators import parse as P
from gaugelake.operators.union import union_by_name

FULL = json.dumps({
    "asset_id": "asset_001", "sensor_id": "quad_ch1", "timestamp": "2024-01-15T10:00:00+00:00",
    "temperature": 25.5, "humidity": 60, "status": "normal", "ok": True, "note": None, "tags": ["a", 1],
    "metadata": {"location": "B1", "floor": 3, "deep": {"x": 1}},
})


@pytest.fixture
def routed(make_messages):
    def make(*payloads):
        return P.routed_messages(make_messages(*[("sensor-data-quad_ch1", i, p) for i, p in enumerate(payloads)]))
    return make


def test_maps(routed):
    r = FL.flatten_maps(routed(FULL)).first()
    assert r.measures == {"temperature": 25.5, "humidity": 60.0, "metadata_floor": 3.0}
    assert r.attrs == {
        "asset_id": "asset_001", "sensor_id": "quad_ch1", "timestamp": "2024-01-15T10:00:00+00:00",
        "status": "normal", "ok": "true", "note": None, "tags": '["a",1]', "metadata_location": "B1",
        "metadata_deep": '{"x":1}',
    }


def test_payloads_that_are_no_objects(routed):
    rows = {r.offset: r for r in FL.flatten_maps(routed("42", '"s"', "[1]", "plain", "{}", "null")).collect()}
    assert rows[0].measures == {"value": 42.0} and rows[0].attrs == {}
    assert rows[1].attrs == {"value": "s"}
    assert rows[2].attrs == {"value": "[1]"}
    assert rows[3].attrs == {"value": "plain"}
    assert rows[4].measures == {} and rows[4].attrs == {}
    assert rows[5].attrs == {"value": None}


def test_colliding_names_do_not_fail(routed):
    r = FL.flatten_maps(routed('{"a":{"b":1},"a_b":2,"c_d":{"e":3},"c":{"d_e":4}}')).first()
    assert r.measures == {"a_b": 2.0, "a_b__2": 1.0, "c_d_e": 3.0, "c_d_e__2": 4.0}


def test_reserved_names_are_no_measures(routed):
    r = FL.flatten_maps(routed('{"partition":1,"offset":2,"timestamp":3,"v":4}')).first()
    assert r.measures == {"v": 4.0}


def test_canonical_keys_are_not_opened(routed):
    r = FL.flatten_maps(routed('{"value":{"x":1}}')).first()
    assert r.measures == {} and r.attrs == {"value": '{"x":1}'}


def test_kafka_timestamp_is_opt_in(routed):
    assert FL.flatten_maps(routed('{"v":1}')).first().measures == {"v": 1.0}
    got = FL.flatten_maps(routed('{"v":1}'), include_kafka_timestamp=True).first().measures
    assert got == {"v": 1.0, "kafka_timestamp": 1704067200000.0}


def test_explode(routed):
    long = FL.explode_measures(FL.flatten_maps(routed('{"a":1,"b":2}', '{"s":"x"}')))
    assert sorted((r.offset, r.measure, r.value) for r in long.collect()) == [(0, "a", 1.0), (0, "b", 2.0)]


def test_wide(routed):
    wide = FL.flatten_wide(
        routed(FULL, "42"), {"temperature": ["temperature"], "floor": ["metadata", "floor"], "value": ["value"],
                             "status": ["status"]},
        {"location": ["metadata", "location"]},
    )
    a, b = sorted(wide.collect(), key=lambda r: r.offset)
    assert (a.temperature, a.floor, a.value, a.status, a.location) == (25.5, 3.0, None, None, "B1")
    assert (b.temperature, b.value, b.location) == (None, 42.0, None)


def test_collision_policies(routed):
    attributes = {"asset_id": ["asset_id"]}
    kept = FL.flatten_wide(routed(FULL, "{}"), {}, attributes).orderBy("offset").collect()
    assert [(r.asset_id, r.payload_asset_id) for r in kept] == [("unknown_asset", "asset_001"), ("unknown_asset", None)]
    replaced = FL.flatten_wide(routed(FULL, "{}"), {}, attributes, "payload").orderBy("offset").collect()
    assert [r.asset_id for r in replaced] == ["asset_001", "unknown_asset"]


def test_wide_from_maps_and_fields(routed):
    flat = FL.flatten_maps(routed(FULL))
    r = FL.wide_from_maps(flat, ["temperature", "none"], ["status"]).first()
    assert (r.temperature, r.none, r.status) == (25.5, None, "normal")
    fields = {(r.field, r.type): r.rows for r in FL.discover_fields(routed(FULL, '{"humidity":"x"}')).collect()}
    assert fields[("humidity", "BIGINT")] == 1 and fields[("humidity", "STRING")] == 1
    assert fields[("metadata_deep", "OBJECT")] == 1


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, 2, "x")], "id bigint, v int, only_a string")
    b = spark.createDataFrame([(2, 2.5, True)], "id int, v double, only_b boolean")
    u = union_by_name(a, b)
    assert dict(u.dtypes) == {"id": "bigint", "v": "double", "only_a": "string", "only_b": "boolean"}
    assert sorted(map(tuple, u.collect())) == [(1, 2.0, "x", None), (2, 2.5, None, True)]
    mixed = union_by_name(a.select("id", F.col("v")), a.select("id", F.col("only_a").alias("v")))
    assert dict(mixed.dtypes)["v"] == "string"
