"""Streaming ingestion of health pushes and workouts, and daily loads of an event stream."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from stridewell import schemas
from stridewell.functions.expr import workout_file
from stridewell.operators import health as h
from stridewell.operators import sleep
from stridewell.operators.measures import measures
from stridewell.operators.timeseries import keep_first
from stridewell.plans import insight

#: What makes a sample the same: of equal ones the first is kept. `at` is the full time as it was sent.
SAMPLE_KEY = ("athlete_id", "metric", "at", "stage", "source")
STORED = "athlete_id long, at string, date date, value double, units string, source string, stage string, metric string, month date"
REJECTED = "athlete_id long, file string, modified timestamp, batch string"
TEXTS = "athlete_id long, date date, text string, batch string"
#: Partitions of a batch that are named one by one when the stored table is read.
BOUND = 2000
#: Days before a batch's first that its insights look at.
WEEK = 7


def new_samples(batch: DataFrame, existing: DataFrame | None, order: list[str | Column] | None = None) -> DataFrame:
    """Samples of a batch that aren't stored yet, each once: existing ones win, then the first in order.

    A sample is known by athlete, metric, full time, stage and source, whatever its value; missing parts are equal to empty ones.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in SAMPLE_KEY]
    names = [f"__{c}" for c in SAMPLE_KEY]
    rows = keep_first(batch.select("*", *filled), names, order or ["value", "units"])
    if existing is not None:
        rows = rows.join(existing.select(*filled), names, "left_anti")
    return rows.drop(*names)


def exists(session: SparkSession, path: str) -> bool:
    where = session._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(session._jsc.hadoopConfiguration()).exists(where)


def _named(batch: DataFrame, parts: tuple[str, ...]) -> Column:
    """A filter for the partitions of a batch, which prunes a scan.

    They come to the driver, at most `BOUND` of them; of more, only the range of the last one, a date, does.
    """
    own = batch.select(*parts).distinct().limit(BOUND + 1).collect()
    if len(own) <= BOUND:
        by_first: dict = {}
        for *first, day in own:
            by_first.setdefault(tuple(first), set()).add(day)
        tests = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(parts, first, strict=False)] + [F.col(parts[-1]).isin(*days)]) for first, days in by_first.items()]
        return reduce(lambda a, b: a | b, tests, F.lit(False))
    low, high = batch.agg(F.min(parts[-1]), F.max(parts[-1])).first()
    return F.col(parts[-1]).between(low, high)


def _stored(session: SparkSession, table: str, schema: T.StructType, batch: DataFrame, parts: tuple[str, ...]) -> DataFrame | None:
    """What a partitioned table holds in the partitions of a batch, or None where there is no table yet."""
    return session.read.schema(schema).parquet(table).where(_named(batch, parts)) if exists(session, table) else None


def _append(rows: DataFrame, table: str, parts: tuple[str, ...]) -> None:
    """Adds rows to a partitioned table: few files a partition, and several tasks for a large one."""
    rows.hint("rebalance", *[F.col(c) for c in parts]).write.mode("append").partitionBy(*parts).parquet(table)


def _once(rows: DataFrame, table: str, batch: str) -> None:
    """Writes rows as the part of a batch: a batch that is tried again replaces its part."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)


def _read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(table) if exists(spark, table) else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Inbox:
    """Where pushed JSON files arrive, and what becomes of them.

    files_per_batch bounds a batch, so that a failure costs one batch and not everything that has arrived. With archive,
    files that a committed batch has taken are moved there by the stream itself: those of a run's last batch when the next
    run begins. athlete_id None takes the id from the name of the file's folder (0 if that isn't a number).
    """

    path: str
    checkpoint: str
    archive: str | None = None
    files_per_batch: int = 400
    athlete_id: int | None = None

    def bodies(self, spark: SparkSession) -> DataFrame:
        """athlete_id, file (its path), modified and body of files as they arrive."""
        reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", self.files_per_batch).option("maxFileAge", "36500d")
        if self.archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", self.archive)
        file = F.col("_metadata.file_path")
        folder = F.try_element_at(F.split(file, "/"), F.lit(-2))
        own = F.coalesce(F.regexp_extract(folder, r"^(?:athlete(?:_id)?=)?(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
        athlete = own if self.athlete_id is None else F.lit(self.athlete_id).cast("long")
        return reader.load(self.path).select(athlete.alias("athlete_id"), file.alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))

    def name(self, number: int) -> str:
        """A batch's name: unlike other inboxes' that write to the same tables, and the same when the batch is tried again."""
        return f"{zlib.crc32(self.checkpoint.encode()):08x}-{number:09d}"

    def each(self, spark: SparkSession, take) -> StreamingQuery:
        """Runs take(batch, name) over what has arrived, batch by batch, and ends."""
        return self.bodies(spark).writeStream.foreachBatch(lambda b, n: take(b, self.name(n))).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()


def ingest_pushes(spark: SparkSession, inbox: str | Inbox, table: str, checkpoint: str | None = None, sleep_table: str | None = None, rejected: str | None = None, insights: str | None = None) -> StreamingQuery:
    """Takes what has arrived in a folder of pushed JSON files into a table partitioned by metric and month, and ends.

    Samples are known by athlete, metric, full time, stage and source: existing ones win, then those of the file that was
    written first. Any lateness is accepted, and a repeated push or a batch that is tried again adds nothing: each batch is joined with
    what the table holds of its own metrics and months. With sleep_table, sleep samples go there whole, by the month in
    which they end, as a segment may span midnight; see `stored_nights`. With rejected, files whose body can't be read, or holds no
    metrics, are listed there (a file of no bytes isn't). With insights, each batch's sentences are written there before its samples are: what
    `insight.health_changes` finds between the stored days (and the week before) and these with the batch. Tried again
    after its samples are stored, a batch changes nothing and leaves its sentences as they are.
    """
    source = inbox if isinstance(inbox, Inbox) else Inbox(inbox, checkpoint, athlete_id=0)

    def take(batch: DataFrame, name: str) -> None:
        session = batch.sparkSession
        session.conf.set("spark.sql.adaptive.enabled", "true")  # streams begin without it; a batch's writes are split by size with it
        samples = h.push_samples(batch).persist()
        order = [F.col("modified"), F.col("file"), F.col("place")]
        rows = h.quantities(samples).where("date is not null").withColumn("stage", F.lit("")).withColumn("month", F.trunc("date", "month"))
        stored = _stored(session, table, T._parse_datatype_string(STORED), rows, ("metric", "month"))
        fresh = new_samples(rows, stored, order).select(*T._parse_datatype_string(STORED).names).persist()
        nights = samples.where(F.col("name") == h.SLEEP).select("athlete_id", "sample.*").withColumn("month", F.trunc(F.expr("try_to_date(substring(coalesce(endDate, end, date), 1, 10))"), "month")).where("month is not null").distinct()
        if sleep_table:
            known = _stored(session, sleep_table, nights.schema, nights, ("month",))
            nights = (nights if known is None else nights.exceptAll(known)).persist()
        if rejected:
            readable = F.from_json("body", schemas.PUSH).alias("j")
            bad = batch.select("athlete_id", "file", "modified", readable).where("coalesce(j.data.metrics, j.metrics) is null").drop("j")
            _once(bad, rejected, name)
        if insights:
            _once(_news(session, table, fresh, sleep_table, nights if sleep_table else None), insights, name)
        _append(fresh, table, ("metric", "month"))
        if sleep_table:
            _append(nights, sleep_table, ("month",))
            nights.unpersist()
        fresh.unpersist()
        samples.unpersist()

    return source.each(spark, take)


def _news(session: SparkSession, table: str, fresh: DataFrame, sleep_table: str | None, nights: DataFrame | None) -> DataFrame:
    """Sentences about what a batch changes: days of its metrics in the stored table, and the week before, against the same with the batch."""
    first = fresh.agg(F.min("date")).first()[0]
    months = None if first is None else F.col("month") >= F.trunc(F.date_sub(F.lit(first), WEEK), "month")
    past = _read(session, table, STORED)
    past = past.where(F.lit(False) if months is None else months & F.col("metric").isin(*[r[0] for r in fresh.select("metric").distinct().collect()]))
    daily = lambda rows: h.aggregate_daily(h.clean_sources(rows.select("athlete_id", "date", "metric", "value", "source").withColumn("seq", F.xxhash64("date", "metric", "value", "source"))))
    before, after = past, past.unionByName(fresh)
    if sleep_table:
        first = nights.agg(F.min("month")).first()[0]
        known = session.read.schema(nights.schema).parquet(sleep_table).where(F.lit(first is not None) & (F.col("month") >= F.add_months(F.lit(first), -1))) if exists(session, sleep_table) else nights.limit(0)
        before, after = (x.select("athlete_id", "date", "metric", "value", "source").unionByName(_nights(n)) for x, n in ((before, known), (after, known.unionByName(nights))))
    return insight.health_insight(insight.health_changes(daily(after), daily(before)))


def _nights(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c not in ("month", "athlete_id")]
    return measures(rows.select("athlete_id", F.lit(h.SLEEP).alias("name"), F.struct(*fields).alias("sample")))


def stored_samples(spark: SparkSession, table: str) -> DataFrame:
    """The quantities that `ingest_pushes` has stored, none where there is no table yet."""
    return _read(spark, table, STORED)


def stored_nights(spark: SparkSession, sleep_table: str) -> DataFrame:
    """sleep_* rows (athlete_id, date, metric, value, source) of the sleep samples that `ingest_pushes` has stored; none where nothing has been stored yet."""
    fields = T._parse_datatype_string(schemas.SAMPLE)
    schema = T.StructType([T.StructField("athlete_id", T.LongType()), *fields.fields, T.StructField("month", T.DateType())])
    rows = spark.read.schema(schema).parquet(sleep_table) if exists(spark, sleep_table) else spark.createDataFrame([], schema)
    return _nights(rows)


def rejected_files(spark: SparkSession, rejected: str) -> DataFrame:
    """athlete_id, file, modified and batch of files that `ingest_pushes` couldn't read."""
    return _read(spark, rejected, REJECTED)


def told(spark: SparkSession, insights: str) -> DataFrame:
    """athlete_id, date, text and batch of the sentences that `ingest_pushes` has written."""
    return _read(spark, insights, TEXTS)


def ingest_workouts(spark: SparkSession, inbox: Inbox, folder: str) -> StreamingQuery:
    """Stores the workouts of pushed JSON files, each as one file in a folder named by sport and start (`workout_file`), and ends.

    A body is the pushed workout, as compact JSON. A workout that is pushed again replaces the stored one, so that a batch that is tried again
    changes nothing; of a batch's equal names the one of the file that was written last is kept.
    """

    def take(batch: DataFrame, _: str) -> None:
        bodies = F.from_json("body", "struct<data: struct<workouts: array<string>>>")["data"]["workouts"]
        rows = batch.select("modified", "file", F.posexplode(bodies).alias("place", "workout"))
        head = F.from_json("workout", "struct<name: string, start: string>")
        rows = rows.withColumn("stored", workout_file(F.coalesce(head["name"], F.lit("workout")), F.coalesce(head["start"], F.lit(""))))
        last = keep_first(rows, ["stored"], [F.col("modified").desc(), F.col("file").desc(), F.col("place").desc()])
        out = last.select(F.concat(F.lit('{"data": {"workouts": ['), "workout", F.lit("]}}")).alias("value"), F.col("stored").alias("workout_file"))
        out.repartition("workout_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("workout_file").text(folder)

    return inbox.each(spark, take)


def daily_load(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and sum of values by day and type, of a batch or, with a watermark, of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("load"))
    return w.select(F.to_date("window.start").alias("date"), "event_type", "n_events", "load")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user's events that are less than `gap` apart."""
    e = events.withWatermark("ts", late) if late else events
    s = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("load"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "load")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, with bounded state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
