"""Imports of changed files, the device cache, and counts of what readers drop."""

import json
import os

import pytest
from pyspark.sql import Observation

from stridewell.sources import imports, readers


def write(path, body, age=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))
    if age is not None:
        os.utime(path, (1_700_000_000 + age,) * 2)


def canonical(metric, day, *samples):
    return {"metric": metric, "date": day, "units": "u", "samples": [{"date": f"{day} {t}", "qty": q, "source": "watch"} for t, q in samples]}


def files_of(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table) for f in names if f.endswith(".parquet")}


@pytest.fixture
def place(tmp_path):
    at = lambda x: str(tmp_path / x)
    return at, lambda athlete, metric, day, *samples: write(f"{at('in')}/{athlete}/{metric}/{day}.json", canonical(metric, day, *samples))


def stored(spark, table):
    return sorted((r["athlete_id"], r["metric"], r["at"], r["value"]) for r in imports.imported_samples(spark, table).collect())


def test_rewritten_files_leave_what_they_hold(spark, place):
    at, put = place
    run = lambda **more: imports.import_canonical(spark, at("in"), at("table"), at("state"), **more)
    put(1, "steps", "2024-01-01", ("08", 1), ("09", 1), ("10", 1))
    put(1, "steps", "2024-01-02", ("08", 4))
    put(2, "steps", "2024-01-01", ("08", 5))
    put(1, "steps", "2024-02-01", ("08", 6))
    put(1, "hrv", "2024-03-01", ("08", 7))
    write(f"{at('in')}/1/heart_rate/2024-01-01.json", {"metric": "heart_rate", "date": "2024-01-01", "samples": [{"date": "2024-01-01 09", "Min": 50, "Avg": 60, "Max": 70}]})
    write(f"{at('in')}/1/steps/2024-01-03.json", "{bad")
    assert run() == {"files": 7, "changed": 7, "unreadable": 1, "samples": 10}
    first = files_of(at("table"))
    assert run() == {"files": 7, "changed": 0, "unreadable": 0, "samples": 0} and files_of(at("table")) == first
    put(1, "steps", "2024-01-01", ("09", 2))
    put(1, "hrv", "2024-03-01")
    assert run()["changed"] == 2
    assert stored(spark, at("table")) == sorted([(1, "steps", "2024-01-01 09", 2.0), (1, "steps", "2024-01-02 08", 4.0), (2, "steps", "2024-01-01 08", 5.0), (1, "steps", "2024-02-01 08", 6.0), *[(1, f"heart_rate_{k}", "2024-01-01 09", v) for k, v in (("min", 50.0), ("avg", 60.0), ("max", 70.0))]])
    after = files_of(at("table"))
    untouched = {f for f in first if "metric=hrv" not in f and not ("metric=steps" in f and "2024-01" in f)}
    assert untouched and untouched <= after and not {f for f in after if "metric=hrv" in f}
    put(1, "steps", "2024-01-01", ("08", 1), ("09", 1), ("10", 1))  # as it was at first
    assert run()["changed"] == 1 and len(stored(spark, at("table"))) == 9
    put(1, "other", "2024-01-01", ("08", 1))
    assert run(metrics=["steps"])["changed"] == 0 and len(stored(spark, at("table"))) == 9


def test_a_run_that_dies_is_completed(spark, place, monkeypatch):
    at, put = place
    run = lambda: imports.import_canonical(spark, at("in"), at("table"), at("state"), athlete_id=4)
    put(1, "steps", "2024-01-01", ("08", 1))
    put(1, "steps", "2024-01-02", ("08", 2))
    run()
    put(1, "steps", "2024-01-01", ("08", 3))
    real, calls = imports._delete, []

    def dies(session, path):
        calls.append(path)
        if path.endswith("/merge") and len(calls) > 1:
            raise RuntimeError("lost")
        real(session, path)

    monkeypatch.setattr(imports, "_delete", dies)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(imports, "_delete", real)
    assert run()["changed"] == 0 and stored(spark, at("table")) == [(4, "steps", "2024-01-01 08", 3.0), (4, "steps", "2024-01-02 08", 2.0)]
    monkeypatch.setattr(imports, "_applied", lambda *_: None)
    put(1, "steps", "2024-01-02", ("08", 9))
    run()  # ends before it touches the table
    monkeypatch.undo()
    assert run()["changed"] == 0 and stored(spark, at("table"))[1] == (4, "steps", "2024-01-02 08", 9.0)


def test_device_cache_reads_touched_pairs(spark, tmp_path, monkeypatch):
    folder, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    name = lambda i, kind: f"{folder}/2024-05-0{i}T10-00-00+00_{i}_{kind}.json"
    read, real = [], readers.device_metrics

    def noted(session, path, only=None):
        out = real(session, path, only)
        read.append(sorted(r["prefix"][-1] for r in out.collect()))
        return out

    monkeypatch.setattr(readers, "device_metrics", noted)
    values = lambda: {r["prefix"][-1]: (r["maxHR"], r["recoveryHeartRate"]) for r in imports.device_metrics(spark, folder, cache).collect()}
    os.makedirs(folder)
    assert values() == {}
    for i in (1, 2, 3):
        write(name(i, "summary"), {"maxHR": 170.0 + i}, i)
    write(name(1, "details"), {"summaryDTO": {"recoveryHeartRate": 30.0}}, 1)
    first = {"1": (171.0, 30.0), "2": (172.0, None), "3": (173.0, None)}
    assert values() == first and values() == first
    write(name(2, "details"), {"summaryDTO": {"recoveryHeartRate": 20.0}}, 9)  # a second file of an old pair
    write(name(3, "summary"), {"maxHR": 150.0}, 0)  # older than before
    assert values() == {"1": (171.0, 30.0), "2": (172.0, 20.0), "3": (150.0, None)}
    os.remove(name(1, "summary"))
    assert len(values()) == 3
    assert read == [[], ["1", "2", "3"], ["2", "3"]]


def test_counts_come_with_the_result(spark, tmp_path):
    """Unreadable bodies and samples that give no row, in the pass that reads the files."""
    good = {"data": {"metrics": [{"name": "steps", "units": "n", "data": [{"date": "2024-01-01", "qty": 1}, {"date": "never", "qty": 2}, {"date": "2024-01-01"}]}, {"name": "sleep_analysis", "data": [{"startDate": "2024-01-01 23", "endDate": "2024-01-02 01", "value": "no stage"}, {"date": "2024-01-01", "totalSleep": 7.0}]}]}}
    for i, body in enumerate([good, {"metrics": []}, "{bad", {"data": {}}]):
        write(str(tmp_path / f"push/{i}.json"), body)
    counted = readers.Counted()
    df = readers.health_pushes(spark, str(tmp_path / "push"), counted=counted)
    assert sorted(r["metric"] for r in df.collect()) == ["sleep_totalSleep", "steps"]
    assert counted.get() == {"bodies": 4, "unreadable": 2, "samples": 5, "dropped": 3}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == plan.count("Initial Plan") + 1
    for i, body in enumerate([canonical("steps", "2024-01-01", ("08", 1)), "{bad", canonical("steps", "2024-01-02")]):
        write(str(tmp_path / f"canonical/{i}.json"), body)
    counted = readers.Counted()
    assert readers.canonical(spark, str(tmp_path / "canonical"), counted=counted).count() == 1
    assert counted.get() == {"bodies": 3, "unreadable": 1, "samples": 1, "dropped": 0}


def test_unreadable_device_files_are_counted(spark, tmp_path):
    for i, (summary, details) in enumerate([({"maxHR": 1.0}, "{bad"), ("{bad", {"summaryDTO": {"minHR": 2.0}}), ({"summaryDTO": {"maxHR": 3.0}}, None), ({}, {})]):
        write(f"{tmp_path}/in/{i}_summary.json", summary)
        if details is not None:
            write(f"{tmp_path}/in/{i}_details.json", details)
    summaries, details = Observation(), Observation()
    rows = readers.device_metrics(spark, f"{tmp_path}/in", summaries=summaries, details=details).collect()
    assert {r["prefix"]: (r["maxHR"], r["minHR"]) for r in rows} == {"0": (1.0, None), "1": (None, 2.0), "2": (3.0, None), "3": (None, None)}
    assert (summaries.get, details.get) == ({"bodies": 4, "unreadable": 1}, {"bodies": 3, "unreadable": 1})
