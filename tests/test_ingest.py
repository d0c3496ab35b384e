"""Streams of pushed files: identity of samples, archives, bad files, batches, insights, workouts, nights."""

import json
import os
import shutil
import time
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from stridewell.streaming import ingest
from stridewell.streaming.ingest import Inbox

from .test_operators import NIGHTS, SLEEP


def put(folder, name, metrics, age=0):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        json.dump({"data": {"metrics": metrics}}, f)
    os.utime(f"{folder}/{name}", (1_700_000_000 - age, 1_700_000_000 - age))


def steps(*samples, name="step_count"):
    return {"name": name, "units": "count", "data": [{"date": at, "qty": q, "source": s} for at, q, s in samples]}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def at(tmp_path):
    return lambda name: str(tmp_path / name)


def test_samples_are_known_by_their_full_time(spark, at):
    """Equal values of a day stay apart; a repeated push adds nothing; another value at a known time is ignored, in a batch as well as later."""
    times = [f"2024-01-01 {h:02}:00:00 +0100" for h in (8, 9, 10)]
    put(at("inbox"), "a.json", [steps(*[(t, 10, "watch") for t in times])], age=50)
    ingest.ingest_pushes(spark, at("inbox"), at("table"), at("check")).awaitTermination()
    stored = lambda: rows(ingest.stored_samples(spark, at("table")), "at", "value", "source")
    assert stored() == [(t, 10.0, "watch") for t in times]
    put(at("inbox"), "again.json", [steps(*[(t, 10, "watch") for t in times])], age=40)
    put(at("inbox"), "changed.json", [steps((times[0], 99, "watch"), (times[0], 7, "ring"))], age=30)
    put(at("inbox"), "z.json", [steps(("2024-01-02 07:00:00 +0100", 5, "watch"))], age=20)
    put(at("inbox"), "b.json", [steps(("2024-01-02 07:00:00 +0100", 6, "watch"), ("2023-12-01 07:00:00 +0100", 1, None), ("2023-12-01 07:00:00 +0100", 2, ""))], age=10)
    ingest.ingest_pushes(spark, at("inbox"), at("table"), at("check")).awaitTermination()
    assert rows(ingest.stored_samples(spark, at("table")).withColumn("source", F.coalesce("source", F.lit(""))), "at", "value", "source") == sorted([("2023-12-01 07:00:00 +0100", 1.0, ""), *[(t, 10.0, "watch") for t in times], (times[0], 7.0, "ring"), ("2024-01-02 07:00:00 +0100", 5.0, "watch")])
    shutil.rmtree(at("check"))  # everything is taken again
    ingest.ingest_pushes(spark, at("inbox"), at("table"), at("check")).awaitTermination()
    assert len(stored()) == 6


def test_athletes_share_a_table(spark, at):
    for athlete in ("7", "athlete_id=8", "none"):
        put(at(f"inbox/{athlete}"), "a.json", [steps(("2024-01-01 08:00:00", 1, "watch"))])
    inbox = Inbox(at("inbox"), at("check"))
    ingest.ingest_pushes(spark, inbox, at("table")).awaitTermination()
    assert rows(ingest.stored_samples(spark, at("table")), "athlete_id", "value") == [(0, 1.0), (7, 1.0), (8, 1.0)]
    assert ingest.stored_samples(spark, at("nowhere")).count() == ingest.stored_nights(spark, at("nowhere")).count() == 0


def test_archive_and_bad_files(spark, at):
    """Files that have been taken move to the archive, the last batch's when the next run begins; bad ones are listed, but for files of no bytes."""
    put(at("inbox"), "good.json", [steps(("2024-01-01 08:00:00", 1, "watch"))])
    put(at("inbox"), "good2.json", [steps(("2024-01-01 09:00:00", 2, "watch"))])
    for name, body in (("bad.json", "{bad"), ("other.json", '{"data": {"workouts": []}}'), ("empty.json", "")):
        with open(f"{at('inbox')}/{name}", "w") as f:
            f.write(body)
    inbox = Inbox(at("inbox"), at("check"), archive=at("archive"), athlete_id=3)
    ingest.ingest_pushes(spark, inbox, at("table"), rejected=at("rejected")).awaitTermination()
    bad = ingest.rejected_files(spark, at("rejected"))
    assert sorted(r["file"].rsplit("/", 1)[-1] for r in bad.collect()) == ["bad.json", "other.json"] and {r["athlete_id"] for r in bad.collect()} == {3}
    put(at("inbox"), "late.json", [steps(("2024-01-01 10:00:00", 3, "watch"))])
    ingest.ingest_pushes(spark, inbox, at("table"), rejected=at("rejected")).awaitTermination()
    for _ in range(100):  # the stream moves them in a thread of its own
        if os.listdir(at("inbox")) == ["late.json"]:
            break
        time.sleep(0.1)
    assert os.listdir(at("inbox")) == ["late.json"]
    assert sorted(f for _, _, names in os.walk(at("archive")) for f in names if not f.startswith(".")) == ["bad.json", "empty.json", "good.json", "good2.json", "other.json"]
    assert rows(ingest.stored_samples(spark, at("table")), "value") == [(1.0,), (2.0,), (3.0,)]
    assert ingest.rejected_files(spark, at("rejected")).count() == 2


def test_bounded_batches_and_failure(spark, at, monkeypatch):
    """Files come in batches; a failure in the second leaves the first alone, and the next run begins with the second."""
    for i in range(60):
        put(at("inbox"), f"{i:03}.json", [steps((f"2024-01-{i % 28 + 1:02} {i // 28:02}:00:00", i, "watch"))], age=1000 - i)
    sizes, real = [], ingest.new_samples

    def counted(batch, *more):
        sizes.append(batch.select("file").distinct().count())
        if len(sizes) == 2:
            raise RuntimeError("lost")
        return real(batch, *more)

    monkeypatch.setattr(ingest, "new_samples", counted)
    inbox = Inbox(at("inbox"), at("check"), files_per_batch=20)
    with pytest.raises(Exception, match="lost"):
        ingest.ingest_pushes(spark, inbox, at("table")).awaitTermination()
    assert ingest.stored_samples(spark, at("table")).count() == 20
    ingest.ingest_pushes(spark, inbox, at("table")).awaitTermination()
    assert sizes == [20, 20, 20, 20] and rows(ingest.stored_samples(spark, at("table")), "value") == [(float(i),) for i in range(60)]


def test_insights_on_arrival(spark, at, monkeypatch):
    """A batch's sentences compare with what was stored before it; a batch that fails after they were written, and one that is taken again, adds none."""
    hrv = lambda day, x: steps((f"2024-03-{day:02} 07:00:00", x, "watch"), name="heart_rate_variability")
    put(at("inbox"), "a.json", [hrv(d, 50) for d in (1, 2, 3, 4)] + [steps(("2024-03-04 08:00:00", 9000, "watch"))], age=100)
    run = lambda: ingest.ingest_pushes(spark, Inbox(at("inbox"), at("check"), athlete_id=5), at("table"), sleep_table=at("nights"), insights=at("texts")).awaitTermination()
    run()
    put(at("inbox"), "b.json", [hrv(5, 60), {"name": "sleep_analysis", "units": "hr", "data": [{"date": "2024-03-05", "totalSleep": 4.5, "deep": 1.0, "source": "watch"}]}], age=50)
    real, fails = ingest._append, [True]

    def once(*args):
        if fails:
            fails.pop()
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(ingest, "_append", once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    texts = [(r["athlete_id"], r["date"], r["text"]) for r in ingest.told(spark, at("texts")).orderBy("batch").collect()]
    assert texts == [(5, date(2024, 3, 4), "Health 4 Mar: heart_rate_variability 50.0"), (5, date(2024, 3, 5), "Health 5 Mar: heart_rate_variability 60.0 (+10.0 vs 7d), sleep_deep 1.0, sleep_totalSleep 4.5 (short night)")]
    commits = f"{at('check')}/commits"
    for name in ("1", ".1.crc"):
        os.remove(f"{commits}/{name}")  # the batch is taken again
    run()
    assert ingest.told(spark, at("texts")).count() == 2 and ingest.stored_samples(spark, at("table")).count() == 6


def test_sleep_and_pruning(spark, at):
    """Sleep samples are stored whole and once; nights come from what is stored; a later batch reads only its own months."""
    some = [{"name": "steps", "units": "n", "data": [{"date": "2026-01-05", "qty": 3, "source": "w"}]}]
    night = lambda *samples: {"name": "sleep_analysis", "units": "hr", "data": list(samples)}
    put(at("inbox"), "a.json", [night(*SLEEP[:3]), *some])
    ingest.ingest_pushes(spark, at("inbox"), at("table"), at("check"), at("nights")).awaitTermination()
    put(at("inbox"), "b.json", [night(*SLEEP[1:]), *some])
    put(at("inbox"), "c.json", [night({"startDate": "2026-02-02 23:00:00 +0100", "endDate": "2026-02-03 01:00:00 +0100", "value": "REM", "qty": 2.0, "source": "watch"})])
    ingest.ingest_pushes(spark, at("inbox"), at("table"), at("check"), at("nights")).awaitTermination()
    got = {(r["date"], r["metric"]): r["value"] for r in ingest.stored_nights(spark, at("nights")).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in NIGHTS.items()) and got[(date(2026, 2, 3), "sleep_rem")] == 2.0
    assert ingest.stored_samples(spark, at("table")).count() == 1
    batch = spark.createDataFrame([("steps", date(2026, 1, 1))], "metric string, month date")
    stored = ingest._stored(spark, at("table"), spark.read.parquet(at("table")).schema, batch, ("metric", "month"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan.replace("PartitionFilters: [isnotnull", "PartitionFilters: [(isnotnull") and stored.count() == 1


def test_workouts_are_files(spark, at):
    """One file a workout, with what was pushed last; a name as the device's, in ASCII."""
    body = '{"name": "%s", "start": "2026-04-06 07:00:35 +0200",  "x": [1.50, "\u00e5"]}'
    names = ["Utomhus L\u00f6pning/1", "Gym", "Gym"]
    os.makedirs(at("inbox"))
    for i, n in enumerate(names):
        with open(f"{at('inbox')}/{i}.json", "w") as f:
            f.write('{"data": {"workouts": [' + body.replace("x", f"x{i}") % n + "]}}")
        os.utime(f"{at('inbox')}/{i}.json", (1_700_000_000 + i,) * 2)
    inbox = Inbox(at("inbox"), at("check"))
    ingest.ingest_workouts(spark, inbox, at("workouts")).awaitTermination()
    shutil.rmtree(at("check"))
    ingest.ingest_workouts(spark, inbox, at("workouts")).awaitTermination()
    found = {}
    for folder, _, files in os.walk(at("workouts")):
        for f in files:
            if f.startswith("part-"):
                with open(f"{folder}/{f}") as g:
                    found.setdefault(folder.rsplit("=", 1)[-1], []).append(g.read())
    expected = lambda n: unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().replace(" ", "_").replace("/", "_") + "-20260406_070035.json"
    whole = lambda i, n: {"data": {"workouts": [json.loads(body.replace("x", f"x{i}") % n)]}}
    assert {k: list(map(json.loads, v)) for k, v in found.items()} == {expected(n): [whole(i, n)] for i, n in ((0, names[0]), (2, "Gym"))}
