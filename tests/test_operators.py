import json
import os
import random
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell import schemas
from stridewell.operators import health as h
from stridewell.operators import joins, sessions
from stridewell.operators import timeseries as ts
from stridewell.operators.measures import measures
from stridewell.sources import driver_tables, readers, sinks
from stridewell.streaming import ingest

D0 = date(2024, 1, 1)


def series(spark, values, athlete=1):
    return spark.createDataFrame([(athlete, D0 + timedelta(days=i), v) for i, v in enumerate(values)], "athlete_id long, date date, x double")


def values(df, column):
    return [r[column] for r in df.orderBy("athlete_id", "date").collect()]


def test_rolling_needs_full_windows(spark):
    df = series(spark, [1.0, None, 3.0, 4.0])
    assert values(df.withColumn("y", ts.rolling_sum(F.col("x"), 2)), "y") == [None, 1.0, 3.0, 7.0]
    assert values(df.withColumn("y", ts.rolling_mean(F.col("x"), 2)), "y") == [None, 1.0, 3.0, 3.5]
    assert values(series(spark, [None, None]).withColumn("y", ts.rolling_sum(F.col("x"), 2)), "y") == [None, 0.0]
    assert values(df.withColumn("y", ts.rolling_sd(F.col("x"), 2)), "y")[:3] == [None, None, None]
    assert values(df.withColumn("y", ts.rolling_median(F.col("x"), 4, 3)), "y") == [None, None, None, 3.0]


def test_spine_has_no_gaps(spark):
    df = spark.createDataFrame([(1, D0), (1, D0 + timedelta(days=5)), (2, D0)], "athlete_id long, date date")
    assert ts.date_spine(df).count() == 7
    assert ts.date_spine(df, until=D0 + timedelta(days=9)).count() == 20


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 400])
def test_ewma_is_the_recursion(spark, n):
    rng = random.Random(n)
    x = [None, None] + [rng.choice([None, 0.0, rng.random() * 100]) for _ in range(n)]
    rates = {"a": 7, "b": 42}
    got = ts.ewma(series(spark, x), "x", rates)
    for name, span in rates.items():
        r, e, want = 2 / (span + 1), None, []
        for v in x:
            e = v if e is None else (1 - r) * e + r * (v or 0.0)
            want.append(e)
        assert [None if v is None else pytest.approx(v, abs=1e-9) for v in want] == values(got, name)


def test_consecutive_flags(spark):
    f = lambda x: values(ts.consecutive_flag(series(spark, x), "x", "f", 5, 3), "f")
    assert f([0.0, 6.0, 6.0, 6.0, 0.0, 6.0, 0.0]) == [False, True, True, True, False, False, False]
    assert f([6.0, None, 6.0, 6.0, 6.0]) == [False, False, True, True, True]


def test_nearest_join_is_a_function_of_the_left_row(spark):
    rng, t0 = random.Random(3), datetime(2024, 1, 1)
    left = [(i, t0 + timedelta(seconds=rng.randrange(20000))) for i in range(150)]
    right = [(i, t0 + timedelta(seconds=rng.randrange(20000)), float(i)) for i in range(120)]
    got = joins.nearest_join(spark.createDataFrame(left, "a long, t timestamp"), spark.createDataFrame(right, "b long, u timestamp, v double"), "t", "u", "a", "b")
    want = {a: min(((abs((t - u).total_seconds()), b) for b, u, _ in right if abs((t - u).total_seconds()) <= 120), default=(0, None))[1] for a, t in left}
    rows = got.collect()
    assert len(rows) == len(left) and {r["a"]: r["b"] for r in rows} == want


def test_preceding_mean(spark):
    o = spark.createDataFrame([(1, D0 + timedelta(days=i), 50.0 + i) for i in range(5)], "athlete_id long, date date, rhr double")
    t = spark.createDataFrame([(1, D0 + timedelta(days=i)) for i in (-1, 0, 2, 5, 6, 90)], "athlete_id long, date date")
    assert values(joins.preceding_mean(t, o, "rhr", "m", fallback=40.0), "m") == [40.0, 40.0, 50.5, 52.0, 40.0, 40.0]


def test_anti_join_treats_nulls_as_equal(spark):
    schema = "athlete_id long, date date, metric string, value double"
    a = spark.createDataFrame([(1, D0, "x", None), (1, D0, "y", 1.0), (1, D0, "z", 2.0)], schema)
    b = spark.createDataFrame([(1, D0, "x", None), (1, D0, "y", 1.5)], schema)
    assert sorted(r["metric"] for r in joins.changed_rows(a, b).collect()) == ["y", "z"]


def run_samples(first, second, n=3600):
    t0 = datetime(2024, 1, 1)
    return [(1, t0 + timedelta(seconds=i), first if i < 600 + (n - 600) / 2 else second, 150.0) for i in range(n)]


@pytest.mark.parametrize(("first", "second", "low", "high"), [(3.0, 2.75, 6, 11), (3.0, 3.0, -1, 1), (2.8, 3.0, -15, 0)])
def test_decoupling(spark, first, second, low, high):
    df = spark.createDataFrame(run_samples(first, second), "activity_id long, ts timestamp, speed double, heart_rate double")
    r = sessions.decoupling(df).first()
    assert low < r["decoupling_pct"] < high and r["width"] == 30


def test_decoupling_leaves_out_uneven_and_short_sessions(spark):
    schema = "activity_id long, ts timestamp, speed double, heart_rate double"
    assert sessions.decoupling(spark.createDataFrame(run_samples(3.0, 2.0), schema)).count() == 0
    assert sessions.decoupling(spark.createDataFrame(run_samples(3.0, 3.0, 605), schema)).count() == 0
    assert sessions.decoupling(spark.createDataFrame([], schema)).count() == 0


def test_zones_sum_to_100(spark):
    schema = "athlete_id long, activity_id long, session_start timestamp, sport string, " + ", ".join(f"z{i}_s double" for i in range(1, 6))
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(days=7 * i), "running", *map(float, rng.integers(1, 900, 5))) for i in range(20)], schema)
    z = sessions.device_zones(a)
    for r in z.monthly.collect():
        assert r["z1_pct"] + r["z2_pct"] + r["z3_pct"] == pytest.approx(100)
    assert z.per_activity.count() == 20


def test_clean_sources(spark):
    schema = "athlete_id long, date date, metric string, value double, source string, seq long"
    rows = [
        (1, D0, "resting_heart_rate", 50.0, "watch", 1), (1, D0, "resting_heart_rate", 60.0, "watch Connect", 2),
        (1, D0 + timedelta(days=1), "resting_heart_rate", 61.0, "Connect", 3),
        (1, D0, "sleep_totalSleep", 17.0, "a", 4), (1, D0, "sleep_deep", 1.0, "a", 5),
        (1, D0 + timedelta(days=2), "sleep_totalSleep", 1.0, "b", 6), (1, D0 + timedelta(days=2), "sleep_inBed", 6.0, "b", 7),
        (1, D0 + timedelta(days=3), "sleep_totalSleep", 1.0, "b", 8),
    ]
    assert sorted(r["seq"] for r in h.clean_sources(spark.createDataFrame(rows, schema)).collect()) == [1, 3, 8]


def push(day, qty):
    return {"data": {"metrics": [{"name": "step_count", "units": "count", "data": [{"date": f"{day} 10:00:00 +0100", "qty": qty, "source": "watch"}]}]}}


def test_readers(spark, tmp_path):
    with open(tmp_path / "2024-05-01T10-00-00+00_7_summary.json", "w") as f:
        json.dump({"summaryDTO": {"maxHR": 180.0}, "maxHR": 1.0}, f)
    with open(tmp_path / "2024-05-01T10-00-00+00_7_details.json", "w") as f:
        json.dump({"summaryDTO": {"recoveryHeartRate": 30.0}}, f)
    with open(tmp_path / "2024-05-02T10-00-00+00_8_summary.json", "w") as f:
        json.dump({"maxHR": 170.0}, f)
    rows = {r["prefix"]: r for r in readers.device_metrics(spark, str(tmp_path)).collect()}
    old, new = rows["2024-05-01T10-00-00+00_7"], rows["2024-05-02T10-00-00+00_8"]
    assert (old["maxHR"], old["recoveryHeartRate"]) == (180.0, 30.0) and old["device_ts"] == datetime(2024, 5, 1, 10)
    assert (new["maxHR"], new["recoveryHeartRate"]) == (170.0, None)
    with open(tmp_path / "rhr.csv", "w") as f:
        f.write("day,bpm,from\n2024-01-01,50,watch\nbad,x,y\n")
    assert [tuple(r) for r in readers.resting_hr(spark, str(tmp_path / "rhr.csv")).collect()] == [(0, D0, 50.0, "watch")]
    assert readers.activities(spark, str(tmp_path / "none")).count() == 0
    point = "<Trackpoint><Time>2024-01-01T10:00:{:02d}Z</Time><HeartRateBpm><Value>140</Value></HeartRateBpm><Extensions><TPX><Speed>3.1</Speed></TPX></Extensions></Trackpoint>"
    with open(tmp_path / "run.TCX", "w") as f:
        f.write("<Track>" + "".join(point.format(i) for i in range(3)) + "</Track>")
    assert readers.tcx_samples(spark, str(tmp_path)).agg(F.count("*"), F.avg("speed")).first() == (3, pytest.approx(3.1))
    assert readers.tcx_files(spark, str(tmp_path)).count() == 1


def test_sinks(spark, tmp_path):
    df = series(spark, [1.0, 2.0])
    assert sinks.save_table(df, str(tmp_path / "x.jsonl")) == "jsonl"
    assert spark.read.json(str(tmp_path / "x.jsonl")).agg(F.sum("x")).first()[0] == 3.0
    with pytest.raises(ValueError):
        sinks.save_table(df, str(tmp_path / "x.foo"))
    e = sinks.envelope(df)
    assert e["summary"] == {"record_count": 2, "date_range": ["2024-01-01", "2024-01-02"]} and len(e["details"]) == 2


def test_xlsx_holds_all_rows_or_none(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr("pandas.DataFrame.to_excel", lambda table, path, **_: written.append(len(table)))
    assert sinks.save_table(spark.range(3), str(tmp_path / "x.xlsx")) == "xlsx"
    with pytest.raises(ValueError, match="csv or parquet"):
        sinks.save_table(spark.range(1_000_001), str(tmp_path / "y.xlsx"))
    assert written == [3]


def test_cached_results_are_worked_out_once(spark, tmp_path):
    from stridewell.operators.incremental import cached

    seen = []

    def compute(new):
        seen.append(sorted(r["activity_id"] for r in new.collect()))
        return new.where("activity_id % 2 = 0").select("activity_id", (F.col("activity_id") * 10).alias("x"))

    path = str(tmp_path / "cache")
    run = lambda n, p: sorted(r["x"] for r in cached(spark.range(n).withColumnRenamed("id", "activity_id"), compute, path, {"p": p}).collect())
    assert run(4, 1) == [0, 20] and run(4, 1) == [0, 20] and run(6, 1) == [0, 20, 40] and run(2, 2) == [0]
    assert seen == [[0, 1, 2, 3], [4, 5], [0, 1]]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_joins_on_time_against_brute_force(spark, keys):
    """Ties in time and in distance, null times, several keys, a dense and a sparse stretch."""
    rng = random.Random(len(keys))
    t0 = datetime(2024, 1, 1)
    moment = lambda: rng.choice([None, t0 + timedelta(seconds=rng.randrange(900)), t0 + timedelta(seconds=rng.randrange(60) * 0.5), t0 + timedelta(hours=rng.randrange(9))])
    left = [(i, moment(), rng.randrange(2)) for i in range(250)]
    right = [(rng.randrange(400), moment(), float(i), rng.randrange(2)) for i in range(250)]
    right = list({r[0]: r for r in right}.values())
    a, b = spark.createDataFrame(left, "a long, ta timestamp, k int"), spark.createDataFrame(right, "b long, tb timestamp, v double, k int")
    if not keys:
        b = b.drop("k")
    same = lambda x, y: not keys or x[2] == y[3]
    got = {r["a"]: (r["b"], r["v"]) for r in joins.nearest_join(a, b, "ta", "tb", "a", "b", keys=keys).collect()}
    near = {r["a"] for r in joins.near_duplicates(a, b, "ta", "tb", keys=keys).collect()}
    assert len(got) == len(left)
    for x in left:
        gaps = sorted((abs((x[1] - y[1]).total_seconds()), y[0], y[2]) for y in right if same(x, y) and x[1] and y[1])
        assert got[x[0]] == ((gaps[0][1], gaps[0][2]) if gaps and gaps[0][0] <= 120 else (None, None)), x
        assert (x[0] in near) == bool(gaps and gaps[0][0] < 2), x
    plan = joins.nearest_join(a, b, "ta", "tb", "a", "b", keys=keys)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_ewma_of_span_one_is_the_value(spark):
    df = series(spark, [None, 2.0, None, *map(float, range(200))])
    assert values(ts.ewma(df, "x", {"a": 1, "b": 3}), "a") == [None, 2.0, 0.0, *map(float, range(200))]


SLEEP = [
    {"date": "2026-01-05 00:00:00 +0100", "totalSleep": 7.0, "core": 4.0, "deep": 1.2, "rem": 1.8, "awake": 0.3, "inBed": 0, "asleep": 0, "sleepStart": "2026-01-04 23:30:00 +0100", "sleepEnd": "2026-01-05 06:30:00 +0100", "inBedStart": "", "source": "watch"},
    {"startDate": "2026-01-06 22:00:00 +0100", "endDate": "2026-01-07 01:00:00 +0100", "value": "K\u00e4rna", "qty": 3.0, "source": "watch"},
    {"startDate": "2026-01-07 01:00:00 +0100", "endDate": "2026-01-07 02:30:00 +0100", "value": "Djup", "qty": 1.5, "source": "watch"},
    {"startDate": "2026-01-07 01:00:00 +0100", "endDate": "2026-01-07 02:30:00 +0100", "value": "Djup", "qty": 1.5, "source": "watch"},
    {"start": "2026-01-06 22:00:00 +0100", "end": "2026-01-07 07:00:00 +0100", "value": "I s\u00e4ngen", "qty": 9.0, "source": "phone"},
    {"startDate": "2026-01-07 02:30:00 +0100", "endDate": "2026-01-07 03:00:00 +0100", "value": "no stage", "qty": 0.5, "source": "watch"},
    {"date": "2026-01-07", "qty": 5.0},
]
NIGHTS = {
    (date(2026, 1, 5), "sleep_totalSleep"): 7.0, (date(2026, 1, 5), "sleep_deep"): 1.2, (date(2026, 1, 5), "sleep_sleepStart"): 23.5, (date(2026, 1, 5), "sleep_sleepEnd"): 6.5,
    (date(2026, 1, 7), "sleep_totalSleep"): 4.5, (date(2026, 1, 7), "sleep_core"): 3.0, (date(2026, 1, 7), "sleep_deep"): 1.5, (date(2026, 1, 7), "sleep_inBed"): 0.0, (date(2026, 1, 7), "sleep_sleepStart"): 22.0, (date(2026, 1, 7), "sleep_sleepEnd"): 2.5,
}


def test_sleep_in_files(spark, tmp_path):
    """Both formats in one file, told apart sample by sample; repeated segments count once; unknown stages and other samples don't."""
    heart = {"name": "heart_rate", "units": "bpm", "data": [{"date": "2026-01-05 10:00:00 +0100", "Min": 50, "Avg": 60, "Max": 90, "source": "watch"}]}
    os.makedirs(tmp_path / "push")
    with open(tmp_path / "push" / "a.json", "w") as f:
        json.dump({"data": {"metrics": [{"name": "sleep_analysis", "units": "hr", "data": SLEEP}, heart]}}, f)
    with open(tmp_path / "push" / "bad.json", "w") as f:
        f.write("{bad")
    os.makedirs(tmp_path / "canonical")
    for name, metric in (("s", {"metric": "sleep_analysis", "samples": SLEEP}), ("h", {"metric": "heart_rate", "samples": heart["data"]}), ("e", {"metric": "step_count", "samples": []})):
        with open(tmp_path / "canonical" / f"{name}.json", "w") as f:
            json.dump({"date": "2026-01-05", "units": "u", **metric}, f)
    for read, folder in ((readers.health_pushes, "push"), (readers.canonical, "canonical")):
        rows = read(spark, str(tmp_path / folder), athlete_id=7).collect()
        got = {(r["date"], r["metric"]): r["value"] for r in rows}
        assert {r["athlete_id"] for r in rows} == {7} and len(got) == len(rows)
        for key, value in NIGHTS.items():
            assert got[key] == pytest.approx(value), key
        assert {d for d, _ in got} == {date(2026, 1, 5), date(2026, 1, 7)} and (date(2026, 1, 5), "sleep_inBedStart") not in got
        assert [got[(date(2026, 1, 5), f"heart_rate_{x}")] for x in ("min", "avg", "max")] == [50, 60, 90]
        assert {r["source"] for r in rows if r["date"] == date(2026, 1, 7)} == {"watch"}


def test_no_task_gets_a_day_of_samples_whole(spark):
    """However many samples a day or a night has, they are dealt over the tasks; repeated quantities stay, repeated segments count once."""
    q = spark.range(6000).select(F.lit("steps").alias("name"), F.struct(F.lit("2026-01-07").alias("date"), (F.col("id") % 3000).cast("double").alias("qty"), F.lit("watch").alias("source")).alias("sample"))
    clock = lambda minute: F.concat(F.lit("2026-01-07 0"), F.floor(minute / 60), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"), F.lit(":00 +0100"))
    minute = F.col("id") % 480
    s = spark.range(960).select(F.lit("sleep_analysis").alias("name"), F.struct(clock(minute).alias("startDate"), clock(minute + 1).alias("endDate"), F.lit("Deep").alias("value"), F.lit(0.25).alias("qty"), F.lit("ring").alias("source")).alias("sample"))
    text = s.select("name", F.to_json("sample").alias("sample")).unionByName(q.select("name", F.to_json("sample").alias("sample")))
    samples = text.select(F.lit(1).cast("long").alias("athlete_id"), "name", F.from_json("sample", schemas.SAMPLE).alias("sample"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = measures(samples).withColumn("task", F.spark_partition_id()).collect()
        plan = measures(samples)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    steps = [r for r in rows if r["metric"] == "steps"]
    assert sorted(r["value"] for r in steps) == sorted(float(i % 3000) for i in range(6000))
    assert len({r["task"] for r in steps}) > 1
    night = {r["metric"]: r["value"] for r in rows if r["metric"] != "steps"}
    assert (night["sleep_deep"], night["sleep_totalSleep"], night["sleep_sleepStart"], night["sleep_sleepEnd"]) == (120.0, 120.0, 0.0, 8.0)
    assert plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 2 and plan.count(" Range (") == 2


def test_more_samples_give_more_files_not_longer_ones(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet") if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test data")
    for n in (1, 3):
        e.crossJoin(spark.range(n).withColumnRenamed("id", "c")).withColumns({k: F.col(k) + F.col("c") * by for k, by in (("event_id", 168_000), ("user_id", 1600))}).drop("c").write.parquet(str(tmp_path / f"{n}/events.parquet"))
    one, three = (driver_tables.canonical_bodies(spark, str(tmp_path / str(n))).agg(F.max(F.length("body")), F.sum(F.length("body")), F.count("*")).first() for n in (1, 3))
    assert three[0] == one[0] and three[1:] == (3 * one[1], 3 * one[2])


def test_windows_and_sessions_on_a_stream(spark, tmp_path):
    """The streaming operators run on a stream with a watermark and give the batch's rows."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + timedelta(minutes=17 * i), "a" if i % 2 else "b", float(i)) for i in range(150)]
    ddl = "event_id long, user_id long, ts timestamp, event_type string, value double"
    df = spark.createDataFrame(rows, ddl)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(999, 9, t0 + timedelta(days=99), "z", 0.0)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    for name, op in (("daily", ingest.daily_load), ("sessions", ingest.sessions)):
        stream = op(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), late="1 hour")
        stream.writeStream.format("memory").queryName(f"{name}_out").outputMode("append").option("checkpointLocation", str(tmp_path / f"check_{name}")).trigger(availableNow=True).start().awaitTermination()
        got, want = ({tuple(r) for r in x.collect()} for x in (spark.table(f"{name}_out"), op(df)))
        assert got == want and want, name


def test_readers_and_sinks_on_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/weight.csv", "Date,Weight (kg),Fat mass (kg)\n2024-01-01 07:00:00,80,16\n2024-01-01 07:00:00,81,17\nbad,1,1\n")
        z.writestr("README.txt", "x")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("user.csv", "a")
    w = readers.weight_archive(spark, str(tmp_path), athlete_id=3)
    assert {(r["athlete_id"], r["weight"], r["fat_mass"], r["seq"]) for r in w.where("ts is not null").collect()} == {(3, 80.0, 16.0, 0), (3, 81.0, 17.0, 1)}
    (r,) = h.body_composition(w.where("ts is not null")).collect()
    assert (r["fat_pct"], r["lean_mass"]) == (20.0, 64.0)
    with open(tmp_path / "t.csv", "w") as f:
        f.write("a;b\n1;x\nz;y\n2\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv"), "a int, b string", ";").collect()] == [(1, "x"), (None, "y"), (2, None)]
    acts = spark.createDataFrame([(1, i % 5, datetime(2020 + i % 3, 1, 1 + i % 5)) for i in range(40)], "athlete_id long, activity_id long, session_start timestamp")
    sinks.save_activities(acts, str(tmp_path / "acts"))
    saved = spark.read.parquet(str(tmp_path / "acts"))
    assert saved.count() == 15 and {r["year"] for r in saved.collect()} == {2020, 2021, 2022} and saved.dropDuplicates(["athlete_id", "session_start"]).count() == 15
    with pytest.raises(ValueError, match="xlsx"):
        sinks.save_table(spark.range(sinks.XLSX_ROWS + 5), str(tmp_path / "big.xlsx"))


def test_rollup_of_track_files(spark, tmp_path):
    """Track files -> samples -> one row for each activity."""
    point = "<Trackpoint><Time>2024-01-01T10:00:{:02d}Z</Time><HeartRateBpm><Value>{}</Value></HeartRateBpm><Extensions><TPX><Speed>{}</Speed></TPX></Extensions></Trackpoint>"
    for name, n in (("a.tcx", 3), ("b.TCX", 5)):
        with open(tmp_path / name, "w") as f:
            f.write("<Track>" + "".join(point.format(i, 140 + i, 3.0) for i in range(n)) + "</Track>")
    rows = sessions.rollup(readers.tcx_samples(spark, str(tmp_path))).collect()
    assert sorted((r["n_samples"], r["max_hr"], r["avg_speed"]) for r in rows) == [(3, 142.0, 3.0), (5, 144.0, 3.0)]
