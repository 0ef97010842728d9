"""Alert rules."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gaugelake.operators import alerts as A

T0 = datetime(2024, 1, 1)


def metrics(spark, **series):
    rows = [(T0 + timedelta(seconds=s), name, "q=1", float(v) if v is not None else None) for name, samples in series.items() for s, v in samples]
    return spark.createDataFrame(rows, "ts timestamp, name string, series string, value double")


def fired(df, rules, **options):
    return sorted((r.rule, int((r.held_from - T0).total_seconds()), r.held_seconds, round(r.peak, 6)) for r in A.fired(df, rules, **options).collect())


def test_gauge_holds_and_gaps(spark):
    df = metrics(spark, lag=[(60 * i, 5 if i == 7 else 20 + i) for i in range(20)] + [(60 * 40, 99), (60 * 41, None)])
    rules = [A.AlertRule("lag", "lag", ">", 10, 300), A.AlertRule("long", "lag", ">", 10, 700), A.AlertRule("low", "lag", "<", 6, 0)]
    assert fired(df, rules) == [("lag", 0, 360, 26.0), ("lag", 480, 660, 39.0), ("low", 420, 0, 5.0)]
    assert fired(df, rules[1:2], max_gap_s=3600) == [("long", 480, 1920, 99.0)]


def test_rates_with_resets(spark):
    # one failure a second for ten minutes, a reset, then rest
    up = [(10 * i, 10 * i) for i in range(61)]
    df = metrics(spark, failures_total=up + [(600 + 10 * i, 0 if i else 600) for i in range(1, 200)])
    rule = A.AlertRule("failures", "failures_total", ">", 0.5, 300, 300, "critical")
    [(name, start, held, peak)] = fired(df, [rule])
    # 50 + 60 + 60 in the five minutes up to the third are above 150, 3 * 60 + 10 up to minute 11 too, 2 * 60 + 10 are not
    assert (name, start, held, peak) == ("failures", 120, 540, 1.0)
    assert A.fired(df, [rule]).first().severity == "critical"
    quiet = A.AlertRule("quiet", "failures_total", "=", 0, 900, 300)
    assert [(n, s) for n, s, _, _ in fired(df, [quiet])] == [("quiet", 900)]


def test_many_samples_of_a_step_count_as_one(spark):
    many = metrics(spark, gauge=[(s, 50 + s % 7) for s in range(1200)])
    few = metrics(spark, gauge=[(60 * i + 59, 50 + (60 * i + 59) % 7) for i in range(20)])
    rules = [A.AlertRule("high", "gauge", ">", 49, 300)]
    assert fired(many, rules) == fired(few, rules) == [("high", 0, 1140, 56.0)]
    assert A.steps(many).count() == 20


def test_all_rules_read_the_samples_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    metrics(spark, consumer_lag=[(60 * i, 20_000) for i in range(20)], storage_usage=[(60 * i, 0.9) for i in range(10)]).write.parquet(path)
    out = A.fired(spark.read.parquet(path))
    assert {r.rule for r in out.collect()} == {"consumer_lag", "disk_usage"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Generate" not in plan
    assert A.fired(spark.read.parquet(path).where(F.lit(False))).count() == 0
