"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.functions import expr
from stridewell.functions.dates import monday_week, within
from stridewell.operators import health as h
from stridewell.operators import joins, metrics, sessions, sleep
from stridewell.operators import timeseries as ts
from stridewell.operators.smoothing import local_regression
from stridewell.plans import insight, reports
from stridewell.plans.readiness import readiness as readiness_plan
from stridewell.sources import driver_tables as t
from stridewell.sources.readers import canonical_measures, dual_format, filename_time
from stridewell.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = t.AS_OF
SMOOTH = 172_800.0


def query(sql: str | None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query under its name, floating-point columns rounded as in its SQL."""

    def register(f: Query) -> Query:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])

        QUERIES[f.__name__] = rounded
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.activities(spark, sf_dir)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.aggregate_daily(t.health(spark, sf_dir))


def r6(*columns: str) -> str:
    """SQL: columns, or expressions AS names, rounded to 6 digits, after a step that takes exact halves to the same side in both engines."""
    out = []
    for c in columns:
        e, _, name = c.rpartition(" AS ")
        out.append(f"round({e or name} + 1e-9, 6) AS {name}")
    return ", ".join(out)


A, D, H, R, S, SEG = t.A, t.D, t.H, t.R, t.S, t.SEGMENTS
TOTALS = r6("sum(distance_m) / 1000 AS km_total", "max(distance_m) / 1000 AS km_max", "avg(avg_pace_min_km) AS pace_mean") + ", count(*) AS n_runs"
DATESUM = r6("sum(distance_m) / 1000 AS km_total", "max(distance_m) / 1000 AS km_max", "avg(distance_m) / 1000 AS km_mean", "avg(avg_pace_min_km) AS pace_mean", "min(avg_pace_min_km) AS pace_best", "avg(avg_hr) AS hr_mean") + ", count(*) AS n_runs"


def spine(source: str, name: str, until: str | None = None) -> str:
    """SQL: the days of each athlete between its first and last day in source, or until a day."""
    last = f"greatest(max(date), DATE '{until}')" if until else "max(date)"
    return f"{name} AS (SELECT athlete_id, CAST(unnest(generate_series(min(date), {last}, INTERVAL 1 DAY)) AS DATE) AS date FROM {source} GROUP BY athlete_id)"


W_ = "PARTITION BY athlete_id ORDER BY date"


def full(value: str, rows: int, frame: str | None = None) -> str:
    return f"CASE WHEN row_number() OVER ({W_}) >= {rows} THEN {value} OVER ({W_} ROWS BETWEEN {frame or f'{rows - 1} PRECEDING AND CURRENT ROW'}) END"


KM = f"""{A}, km0 AS (SELECT athlete_id, date, sum(distance_m) / 1000 AS daily_km FROM r GROUP BY ALL), {spine("km0", "sp", str(AS_OF))},
km AS (SELECT athlete_id, date, coalesce(daily_km, 0) AS daily_km FROM sp LEFT JOIN km0 USING (athlete_id, date))"""


# ---- calendar reports -------------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT athlete_id, {DATESUM} FROM r WHERE session_start >= DATE '1999-01-01' AND session_start < DATE '2000-01-01' GROUP BY athlete_id")
def report_datesum(spark, sf_dir):
    return reports.datesum(_a(spark, sf_dir), (date(1999, 1, 1), date(2000, 1, 1)))


@query(f"""WITH {A}, m AS (SELECT athlete_id, strftime(session_start, '%Y-%m') AS year_month, {TOTALS}, sum(distance_m) AS km_ FROM r GROUP BY 1, 2)
SELECT * EXCLUDE (km_) FROM m QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY km_ DESC, year_month DESC) <= 10""")
def report_monthtop(spark, sf_dir):
    return reports.monthtop(_a(spark, sf_dir), 10)


def _year_sql(test: str, per_day: int) -> str:
    return f"WITH {A} SELECT athlete_id, year(session_start)::INTEGER AS year, {r6(f'sum(distance_m) / 1000 / {per_day} AS km_per_day')}, {TOTALS} FROM r WHERE {test} GROUP BY 1, 2"


@query(_year_sql("month(session_start) = 8 AND day(session_start) <= 1", 1))
def report_monthstatus(spark, sf_dir):
    return reports.monthstatus(_a(spark, sf_dir), AS_OF)


@query(_year_sql("month(session_start) = 7", 1))
def report_monthlast(spark, sf_dir):
    return reports.monthlast(_a(spark, sf_dir), AS_OF)


@query(_year_sql("true", 213))
def report_yearstop(spark, sf_dir):
    return reports.yearstop(_a(spark, sf_dir), AS_OF)


@query(_year_sql("dayofyear(session_start) <= 213", 213))
def report_yearstatus(spark, sf_dir):
    return reports.yearstatus(_a(spark, sf_dir), AS_OF)


@query(f"WITH {A} SELECT athlete_id, year(session_start)::INTEGER AS year, {r6('sum(duration_min) AS minutes', 'avg(avg_pace_min_km) AS pace_mean', 'min(avg_pace_min_km) AS pace_best')} FROM r GROUP BY 1, 2")
def pace_by_year(spark, sf_dir):
    return reports.pace_by_year(_a(spark, sf_dir))


@query(f"WITH {A} SELECT athlete_id, year(session_start)::INTEGER AS year, {r6('max(distance_m / 1000) AS km_max', 'sum(distance_m / 1000) AS km_total', 'avg(distance_m / 1000) AS km_mean')} FROM r GROUP BY 1, 2")
def distance_by_year(spark, sf_dir):
    return reports.distance_by_year(_a(spark, sf_dir))


@query(f"WITH {A} SELECT athlete_id, count(*) AS n_activities, strftime(min(session_start), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(max(session_start), '%Y-%m-%d %H:%M:%S') AS last_start, {r6('sum(distance_m) / 1000 AS km_total')} FROM a GROUP BY 1")
def report_mostrecent(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return reports.mostrecent(_a(spark, sf_dir)).select("athlete_id", "n_activities", text("first_start"), text("last_start"), "km_total")


@query(f"WITH {A} SELECT athlete_id, count(*) AS n_runs, {r6('sum(distance_m / 1000) AS km', 'avg(avg_pace_min_km) AS pace_mean')} FROM r WHERE date >= DATE '2001-07-01' AND date < DATE '2001-08-01' GROUP BY 1")
def report_month_footer(spark, sf_dir):
    return reports.month_footer(reports.runs_month(_a(spark, sf_dir), date(2001, 7, 15)))


RUN = "athlete_id, activity_id, year(session_start)::INTEGER AS year, month(session_start)::INTEGER AS month, day(session_start)::INTEGER AS day"


@query(f"WITH {A} SELECT {RUN}, {r6('distance_m / 1000 AS km', 'avg_pace_min_km AS pace', 'avg_hr AS hr')} FROM r WHERE date >= DATE '2001-07-01' AND date < DATE '2001-08-01'")
def report_runs_month(spark, sf_dir):
    return reports.runs_month(_a(spark, sf_dir), date(2001, 7, 15)).drop("session_start")


@query(f"""WITH {A} SELECT athlete_id, activity_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS started, {r6('distance_m / 1000 AS km', 'avg_hr AS hr')},
(floor(round(avg_pace_min_km * 60, 6))::BIGINT // 60)::VARCHAR || ':' || lpad((floor(round(avg_pace_min_km * 60, 6))::BIGINT % 60)::VARCHAR, 2, '0') AS pace
FROM r QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY session_start DESC, activity_id DESC) <= 10""")
def recent_runs(spark, sf_dir):
    return reports.recent_runs(_a(spark, sf_dir)).withColumn("started", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss")).drop("session_start")


@query(f"""WITH {A}, p AS (SELECT *, 'first' AS period FROM r WHERE date >= DATE '2000-01-01' AND date < DATE '2000-07-01' UNION ALL
SELECT *, 'second' AS period FROM r WHERE date >= DATE '2000-06-01' AND date < DATE '2001-01-01') SELECT athlete_id, period, {DATESUM} FROM p GROUP BY 1, 2""")
def compare_periods(spark, sf_dir):
    return reports.compare_periods(_a(spark, sf_dir), (date(2000, 1, 1), date(2000, 7, 1)), (date(2000, 6, 1), date(2001, 1, 1)))


@query(f"WITH {A} SELECT athlete_id, strftime(date, '%Y-W%V') AS bucket, {r6('sum(distance_m) / 1000 AS km')}, count(*) AS n_runs FROM r WHERE date >= DATE '2000-08-01' AND date < DATE '2001-08-01' GROUP BY 1, 2")
def datesum_buckets(spark, sf_dir):
    return reports.datesum_buckets(_a(spark, sf_dir), (date(2000, 8, 1), date(2001, 8, 1)))


@query(f"WITH {A} SELECT athlete_id, date_trunc('week', date)::DATE AS week, {r6('sum(distance_m) / 1000 AS km')}, count(*) AS n_runs FROM r WHERE date > DATE '2001-08-01' - 84 AND date <= DATE '2001-08-01' GROUP BY 1, 2")
def weekly_km(spark, sf_dir):
    return metrics.weekly_km(_a(spark, sf_dir), AS_OF)


@query(f"WITH {A} SELECT athlete_id, activity_id, sport FROM a WHERE session_start >= DATE '2000-03-01' AND session_start < DATE '2000-04-01'")
def date_range_filter(spark, sf_dir):
    return _a(spark, sf_dir).where(within(F.col("session_start"), date(2000, 3, 1), date(2000, 4, 1))).select("athlete_id", "activity_id", "sport")


# ---- scalar helpers ---------------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT activity_id, {r6('60 * avg_speed_m_s / (nullif(80 + activity_id % 13, 80) * 2) AS stride')} FROM a")
def stride_columns(spark, sf_dir):
    cadence = F.nullif(80 + F.col("activity_id") % 13, F.lit(80))
    return _a(spark, sf_dir).select("activity_id", expr.stride(F.col("avg_speed_m_s"), cadence).alias("stride"))


@query(f"WITH {A} SELECT activity_id, {r6('CASE WHEN z5_s = 0 THEN z4_s ELSE z5_s END AS duration', 'coalesce(avg_hr, max_hr) AS hr')} FROM a")
def fix_zero_moving(spark, sf_dir):
    return _a(spark, sf_dir).select("activity_id", expr.patched(F.col("z5_s"), F.col("z4_s"), True).alias("duration"), expr.patched(F.col("avg_hr"), F.col("max_hr"), False).alias("hr"))


@query(f"""WITH {A}, s AS (SELECT activity_id, floor(round(duration_min * 60, 6))::BIGINT AS s FROM a)
SELECT activity_id, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS total, (s // 60 % 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS wrapped FROM s""")
def pace_mmss(spark, sf_dir):
    d = F.col("duration_min")
    return _a(spark, sf_dir).select("activity_id", expr.pace_mmss(d).alias("total"), expr.pace_mmss(d, compat=True).alias("wrapped"))


@query(f"""WITH {A} SELECT athlete_id, CASE WHEN distance_m / 1000 < 7 THEN '<7' WHEN distance_m / 1000 < 12 THEN '7-12' WHEN distance_m / 1000 < 22 THEN '12-22'
WHEN distance_m / 1000 < 32 THEN '22-32' WHEN distance_m / 1000 < 43 THEN '32-43' ELSE '>43' END AS band, count(*) AS n_runs, {r6('sum(distance_m) / 1000 AS km')} FROM r GROUP BY 1, 2""")
def distance_bands(spark, sf_dir):
    return metrics.runs(_a(spark, sf_dir)).groupBy("athlete_id", expr.distance_band(F.col("distance_m") / 1000).alias("band")).agg(F.count("*").alias("n_runs"), (F.sum("distance_m") / 1000).alias("km"))


@query(f"WITH {A} SELECT athlete_id, year(date)::INTEGER AS year, quarter(date)::INTEGER AS quarter, {r6('avg(avg_pace_min_km) AS pace_mean')}, count(*) AS n_runs FROM r GROUP BY 1, 2, 3")
def quarter_pace(spark, sf_dir):
    return metrics.runs(_a(spark, sf_dir)).groupBy("athlete_id", F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(F.avg("avg_pace_min_km").alias("pace_mean"), F.count("*").alias("n_runs"))


def sql_piecewise(x: str, points) -> str:
    out = f"WHEN {x} <= {points[0][0]} THEN {points[0][1]} "
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out += f"WHEN {x} < {x1} THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE) "
    return f"CASE {out} WHEN {x} IS NOT NULL THEN {points[-1][1]}::DOUBLE END"


def sql_sleep(total: str, deep: str, rem: str) -> str:
    return f"least(100::DOUBLE, greatest(0::DOUBLE, {sql_piecewise(total, expr.SLEEP_POINTS)} + CASE WHEN {total} > 0 AND ({deep} + {rem}) / {total} >= 0.35 THEN 10 WHEN {total} > 0 AND ({deep} + {rem}) / {total} < 0.20 THEN -10 ELSE 0 END))"


@query(f"""WITH {A}, x AS (SELECT activity_id, (activity_id % 500)::DOUBLE / 100 - 2.5::DOUBLE AS z, 3 + (activity_id % 601)::DOUBLE / 100 AS h, (activity_id % 7)::DOUBLE / 3 AS p, CASE WHEN activity_id % 5 <> 0 THEN (activity_id % 4)::DOUBLE / 3 END AS q FROM a)
SELECT activity_id, {r6(sql_piecewise('z', expr.HRV_POINTS) + ' AS hrv', sql_piecewise('z', expr.RHR_POINTS) + ' AS rhr', sql_piecewise('z', expr.LOAD_POINTS) + ' AS load', sql_piecewise('z', expr.WRIST_POINTS) + ' AS wrist')},
CASE WHEN h IS NOT NULL THEN {sql_sleep('h', 'p', 'q').replace('least', 'round(least', 1)}, 6) END AS sleep FROM x""")
def piecewise_scores(spark, sf_dir):
    k = F.col("activity_id")
    x = _a(spark, sf_dir).select("activity_id", ((k % 500).cast("double") / 100 - 2.5).alias("z"), (3 + (k % 601).cast("double") / 100).alias("h"), ((k % 7).cast("double") / 3).alias("p"), F.when(k % 5 != 0, (k % 4).cast("double") / 3).alias("q"))
    z = F.col("z")
    return x.select("activity_id", expr.score_hrv(z).alias("hrv"), expr.score_rhr(z).alias("rhr"), expr.score_load(z).alias("load"), expr.score_wrist(z).alias("wrist"), expr.score_sleep(F.col("h"), F.col("p"), F.col("q")).alias("sleep"))


def sql_composite(weights: dict[str, float], suffix: str = "") -> str:
    top = " + ".join(f"coalesce({k}{suffix} * {w}::DOUBLE, 0)" for k, w in weights.items())
    low = " + ".join(f"CASE WHEN {k}{suffix} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for k, w in weights.items())
    return f"({top}) / nullif({low}, 0)"


@query(f"""WITH {A}, x AS (SELECT activity_id, CASE WHEN activity_id % 2 = 0 THEN (activity_id % 101)::DOUBLE END AS hrv, CASE WHEN activity_id % 3 = 0 THEN (activity_id % 97)::DOUBLE END AS sleep,
CASE WHEN activity_id % 5 = 0 THEN (activity_id % 89)::DOUBLE END AS rhr, CASE WHEN activity_id % 7 = 0 THEN (activity_id % 83)::DOUBLE END AS trimp FROM a)
SELECT activity_id, {r6(sql_composite(expr.WEIGHTS) + ' AS score')}, ((hrv IS NOT NULL)::INT + (sleep IS NOT NULL)::INT + (rhr IS NOT NULL)::INT + (trimp IS NOT NULL)::INT)::INTEGER AS n_components FROM x""")
def weighted_composite(spark, sf_dir):
    k = F.col("activity_id")
    s = {name: F.when(k % m == 0, (k % n).cast("double")) for name, m, n in (("hrv", 2, 101), ("sleep", 3, 97), ("rhr", 5, 89), ("trimp", 7, 83))}
    return _a(spark, sf_dir).select("activity_id", expr.weighted_composite(s, expr.WEIGHTS).alias("score"), expr.n_components(s).alias("n_components"))


@query("SELECT event_id, extract(hour FROM l) + extract(minute FROM l) / 60.0::DOUBLE + floor(extract(second FROM l)) / 3600.0::DOUBLE AS hour_fraction FROM (SELECT event_id, (date_trunc('second', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Stockholm' AS l FROM events)".replace("SELECT event_id, extract(hour FROM l) + extract(minute FROM l) / 60.0::DOUBLE + floor(extract(second FROM l)) / 3600.0::DOUBLE AS hour_fraction", "SELECT event_id, round(extract(hour FROM l) + extract(minute FROM l) / 60.0::DOUBLE + floor(extract(second FROM l)) / 3600.0::DOUBLE, 6) AS hour_fraction"))
def sleep_hour_fraction(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", expr.hour_fraction(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss +0000")).alias("hour_fraction"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS event_time FROM events""")
def filename_timestamp(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_summary.json"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00"), F.lit("_7_summary.json")))
    return e.select("event_id", F.date_format(filename_time(name), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query(f"""WITH {KM}, w AS (SELECT *, {full('sum(daily_km)', 7)} AS weekly_km, {full('avg(daily_km)', 28)} * 7 AS chronic FROM km)
SELECT zone, count(*) AS n_days FROM (SELECT CASE WHEN q < 0.8 THEN 'under' WHEN q <= 1.3 THEN 'optimal' WHEN q <= 1.5 THEN 'caution' WHEN q IS NOT NULL THEN 'high' END AS zone
FROM (SELECT CASE WHEN chronic > 0 THEN round(weekly_km / chronic, 9) END AS q FROM w)) GROUP BY zone""")
def acwr_zones(spark, sf_dir):
    return metrics.acwr(_a(spark, sf_dir), AS_OF).groupBy(expr.acwr_zone(F.round("acwr", 9)).alias("zone")).agg(F.count("*").alias("n_days"))


# ---- series -----------------------------------------------------------------------------------------------------------


@query(f"WITH {A}, {spine('r', 'sp', str(AS_OF))} SELECT athlete_id, date FROM sp")
def date_spine(spark, sf_dir):
    return ts.date_spine(metrics.runs(_a(spark, sf_dir)), until=AS_OF)


@query(f"WITH {KM} SELECT athlete_id, date, {r6('daily_km', full('sum(daily_km)', 7) + ' AS km7')} FROM km")
def rolling_sum7(spark, sf_dir):
    return metrics.daily_km(_a(spark, sf_dir), AS_OF).withColumn("km7", ts.rolling_sum(F.col("daily_km"), 7))


def _rolled_sql(where: str, value: str, name: str, rows: int = 28, extra: str = "") -> str:
    return f"""{A}, p AS (SELECT athlete_id, activity_id, date, distance_m / 1000 AS distance_km, {value} AS {name}{extra} FROM r WHERE {where}),
    dl AS (SELECT athlete_id, date, avg({name}) AS x FROM p GROUP BY ALL), {spine("dl", "sp")},
    ro AS (SELECT athlete_id, date, {full("avg(x)", rows)} AS {name}_rolling{rows} FROM sp LEFT JOIN dl USING (athlete_id, date)),
    o AS (SELECT p.*, {name}_rolling{rows} FROM p LEFT JOIN ro USING (athlete_id, date))"""


def _last(n: int, order: str = "date DESC, activity_id DESC") -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY {order}) <= {n}"


EF = _rolled_sql("distance_m > 5000 AND avg_hr > 0", "60 * avg_speed_m_s / avg_hr", "ef")
HRE = _rolled_sql("distance_m > 5000 AND avg_hr > 0 AND avg_pace_min_km > 0", "avg_hr * avg_pace_min_km", "hre")
REC = _rolled_sql("recovery_hr > 0", "recovery_hr", "recovery_hr", extra=", avg_hr")


def _series_sql(ctes: str, name: str, extra: str = "") -> str:
    more = [f"{extra}"] if extra else []
    return f"WITH {ctes} SELECT athlete_id, activity_id, date, {r6('distance_km', *more, name, name + '_rolling28')} FROM o"


@query(_series_sql(EF, "ef"))
def ef_rolling(spark, sf_dir):
    return metrics.efficiency(_a(spark, sf_dir))


@query(f"{_series_sql(EF, 'ef')} {_last(28)}")
def report_ef(spark, sf_dir):
    return reports.ef(_a(spark, sf_dir))


@query(_series_sql(HRE, "hre"))
def hre_rolling(spark, sf_dir):
    return metrics.heart_rate_efficiency(_a(spark, sf_dir))


@query(f"{_series_sql(HRE, 'hre')} WHERE date >= DATE '2001-01-01' AND date < DATE '2001-04-01'")
def report_hre(spark, sf_dir):
    return reports.hre(_a(spark, sf_dir), span=(date(2001, 1, 1), date(2001, 4, 1)))


@query(_series_sql(REC, "recovery_hr", "avg_hr"))
def recovery_hr(spark, sf_dir):
    return metrics.recovery(_a(spark, sf_dir))


@query(f"{_series_sql(REC, 'recovery_hr')} {_last(28)}")
def report_recovery_hr(spark, sf_dir):
    return reports.recovery_hr(_a(spark, sf_dir))


ACWR = f"""{KM}, w AS (SELECT *, {full('sum(daily_km)', 7)} AS weekly_km, {full('avg(daily_km)', 28)} * 7 AS chronic_km, {full('avg(daily_km)', 36, '35 PRECEDING AND 8 PRECEDING')} * 7 AS un FROM km),
x AS (SELECT *, lag(weekly_km, 7) OVER ({W_}) AS wa FROM w),
o AS (SELECT athlete_id, date, {r6('daily_km', 'weekly_km', 'chronic_km', 'CASE WHEN chronic_km > 0 THEN weekly_km / chronic_km END AS acwr', 'CASE WHEN un > 0 THEN weekly_km / un END AS acwr_uncoupled', 'CASE WHEN wa > 0 THEN (weekly_km - wa) / wa * 100 END AS weekly_pct_change')} FROM x)"""


@query(f"WITH {ACWR} SELECT * FROM o")
def acwr(spark, sf_dir):
    return metrics.acwr(_a(spark, sf_dir), AS_OF)


@query(f"WITH {ACWR} SELECT athlete_id, date, daily_km, weekly_km, acwr FROM o {_last(28, 'date DESC')}")
def report_acwr(spark, sf_dir):
    return reports.acwr(_a(spark, sf_dir), AS_OF)


@query(f"WITH {ACWR} SELECT * FROM o WHERE date >= DATE '2001-08-01' - 365")
def acwr_panel(spark, sf_dir):
    return reports.acwr_panel(_a(spark, sf_dir), AS_OF)


MONO = f"""{KM}, w AS (SELECT *, {full('sum(daily_km)', 7)} AS weekly_km, {full('avg(daily_km)', 7)} AS m, {full('stddev_samp(daily_km)', 7)} AS sd FROM km),
o AS (SELECT athlete_id, date, {r6('daily_km', 'weekly_km', 'CASE WHEN sd > 0 THEN m / sd END AS monotony', 'weekly_km * CASE WHEN sd > 0 THEN m / sd END AS strain')} FROM w)"""


@query(f"WITH {MONO} SELECT * FROM o")
def monotony_strain(spark, sf_dir):
    return metrics.monotony(_a(spark, sf_dir), AS_OF)


@query(f"WITH {MONO} SELECT * FROM o {_last(28, 'date DESC')}")
def report_monotony(spark, sf_dir):
    return reports.monotony(_a(spark, sf_dir), AS_OF)


@query(f"""WITH {A}, m AS (SELECT athlete_id, quantile_cont(max_hr, 0.98) AS hr_max, count(*) AS n_runs FROM r WHERE duration_min > 20 AND max_hr > 0 GROUP BY 1)
SELECT athlete_id, {r6('hr_max')}, n_runs FROM m WHERE n_runs >= 10""")
def hr_max_p98(spark, sf_dir):
    return metrics.hr_max(_a(spark, sf_dir))


@query(f"""WITH {A}, y AS (SELECT athlete_id, year(date)::INTEGER AS year, quantile_cont(max_hr, 0.98) AS p98, count(*) AS n_runs FROM r WHERE duration_min > 20 AND max_hr > 0 GROUP BY 1, 2 HAVING count(*) >= 5),
l AS (SELECT athlete_id, regr_slope(p98, year) AS slope, regr_intercept(p98, year) AS ic, count(*) AS n_years FROM y GROUP BY 1)
SELECT athlete_id, year, n_runs, n_years, {r6('p98')}, greatest(150, round(CASE WHEN n_years >= 2 THEN ic + slope * year ELSE p98 END)) AS hr_max FROM y JOIN l USING (athlete_id)""")
def hr_max_trend(spark, sf_dir):
    return metrics.hr_max_trend(_a(spark, sf_dir)).drop("slope", "intercept")


def _preceding_sql(days: str, out: str, fallback: str, name: str) -> str:
    """SQL: CTE name with days (athlete_id, date) and the mean resting heart rate of the 30 days before."""
    return f"""{name} AS (SELECT athlete_id, date, coalesce((SELECT avg(rhr) FROM rhr q WHERE q.athlete_id = x.athlete_id AND q.date BETWEEN x.date - 30 AND x.date - 1
      AND x.date >= lo AND x.date <= hi + 1), {fallback}) AS {out}
      FROM (SELECT DISTINCT athlete_id, date FROM {days}) x LEFT JOIN (SELECT athlete_id, min(date) AS lo, max(date) AS hi FROM rhr GROUP BY 1) b USING (athlete_id))"""


REST = f"{A}, {R}, {_preceding_sql('r', 'hr_rest', '50', 'rest')}"


@query(f"WITH {REST} SELECT athlete_id, date, {r6('hr_rest')} FROM rest")
def hr_rest_rolling30(spark, sf_dir):
    days = metrics.runs(_a(spark, sf_dir)).select("athlete_id", "date").distinct()
    return joins.preceding_mean(days, h.resting_hr(t.health(spark, sf_dir)), "rhr", "hr_rest", fallback=50.0)


TRIMP = f"""{REST}, tr AS (SELECT athlete_id, date, sum(duration_min * x * 0.64 * exp(1.92 * x)) AS daily_trimp FROM (
  SELECT r.athlete_id, r.date, duration_min, least(1, greatest(0, (avg_hr - hr_rest) / (190 - hr_rest))) AS x FROM r JOIN rest USING (athlete_id, date)
  WHERE avg_hr > 0 AND duration_min > 10) GROUP BY ALL)"""


@query(f"WITH {TRIMP} SELECT athlete_id, date, {r6('daily_trimp')} FROM tr")
def trimp_daily(spark, sf_dir):
    return metrics.trimp_daily(_a(spark, sf_dir), 190.0, h.resting_hr(t.health(spark, sf_dir)))


PMC = f"""{TRIMP}, {spine("tr", "tsp", str(AS_OF))}, td AS (SELECT athlete_id, date, coalesce(daily_trimp, 0) AS daily_trimp, row_number() OVER ({W_}) AS k FROM tsp LEFT JOIN tr USING (athlete_id, date)),
pmc AS (SELECT athlete_id, date, k, daily_trimp, daily_trimp AS atl, daily_trimp AS ctl FROM td WHERE k = 1 UNION ALL
  SELECT t.athlete_id, t.date, t.k, t.daily_trimp, 0.25 * t.daily_trimp + 0.75 * p.atl, 2.0::DOUBLE / 43 * t.daily_trimp + (1 - 2.0::DOUBLE / 43) * p.ctl FROM pmc p JOIN td t ON t.athlete_id = p.athlete_id AND t.k = p.k + 1)"""
PMC_OUT = r6("daily_trimp", "atl", "ctl", "ctl - atl AS tsb")


def _pmc(spark, sf_dir):
    return metrics.pmc(_a(spark, sf_dir), AS_OF, 190.0, h.resting_hr(t.health(spark, sf_dir)))


@query(f"WITH RECURSIVE {PMC} SELECT athlete_id, date, {PMC_OUT} FROM pmc")
def pmc(spark, sf_dir):
    return _pmc(spark, sf_dir)


@query(f"WITH RECURSIVE {PMC} SELECT athlete_id, date, {PMC_OUT} FROM pmc {_last(28, 'date DESC')}")
def report_pmc(spark, sf_dir):
    return reports.tail_or_range(_pmc(spark, sf_dir), 28)


TSB = "CASE WHEN tsb > 15 THEN 'rested' WHEN tsb > 5 THEN 'fresh' WHEN tsb > -10 THEN 'neutral' WHEN tsb > -20 THEN 'tired' WHEN tsb IS NOT NULL THEN 'overreached' END"


@query(f"WITH RECURSIVE {PMC} SELECT athlete_id, {TSB} AS zone, count(*) AS n_days FROM (SELECT athlete_id, round(ctl - atl, 9) AS tsb FROM pmc) GROUP BY 1, 2")
def tsb_zones(spark, sf_dir):
    return _pmc(spark, sf_dir).groupBy("athlete_id", expr.tsb_zone(F.round("tsb", 9)).alias("zone")).agg(F.count("*").alias("n_days"))


@query(f"""WITH RECURSIVE {PMC}, {ACWR.replace(A + ',', '', 1)}, p AS (SELECT athlete_id, {r6('atl', 'ctl', 'ctl - atl AS tsb')} FROM pmc {_last(1, 'date DESC')})
SELECT athlete_id, date, weekly_km, acwr, ctl, atl, tsb, CASE WHEN acwr < 0.8 THEN 'under' WHEN acwr <= 1.3 THEN 'optimal' WHEN acwr <= 1.5 THEN 'caution' WHEN acwr IS NOT NULL THEN 'high' END AS acwr_zone, {TSB} AS tsb_zone
FROM (SELECT * FROM o {_last(1, 'date DESC')}) LEFT JOIN p USING (athlete_id)""")
def overview_kpis(spark, sf_dir):
    return insight.overview(_a(spark, sf_dir), AS_OF, hr_max_bpm=190.0, resting=h.resting_hr(t.health(spark, sf_dir)))


@query(f"""WITH {KM}, f AS (SELECT athlete_id, date, daily_km, coalesce(daily_km > 8, false) AS above FROM km),
g AS (SELECT *, row_number() OVER ({W_}) - row_number() OVER (PARTITION BY athlete_id, above ORDER BY date) AS grp FROM f)
SELECT athlete_id, date, above AND count(*) OVER (PARTITION BY athlete_id, above, grp) >= 3 AS flag FROM g""")
def consecutive_flags(spark, sf_dir):
    return ts.consecutive_flag(metrics.daily_km(_a(spark, sf_dir), AS_OF), "daily_km", "flag", 8, 3).drop("daily_km")


@query(f"WITH {KM} SELECT athlete_id, date, {r6('sum(daily_km) OVER (PARTITION BY athlete_id, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) AS km_year')} FROM km")
def cumulative_km(spark, sf_dir):
    d = metrics.daily_km(_a(spark, sf_dir), AS_OF).withColumn("year", F.year("date"))
    return ts.cumulative(d, "daily_km", "km_year", ["athlete_id", "year"], ["date"]).select("athlete_id", "date", "km_year")


@query(f"WITH {A} SELECT athlete_id, {r6('corr(avg_pace_min_km, avg_hr) AS pace_hr', 'corr(avg_pace_min_km, distance_m) AS pace_distance', 'corr(avg_hr, distance_m) AS hr_distance')} FROM r GROUP BY 1")
def pace_correlations(spark, sf_dir):
    r = metrics.runs(_a(spark, sf_dir))
    return r.groupBy("athlete_id").agg(F.corr("avg_pace_min_km", "avg_hr").alias("pace_hr"), F.corr("avg_pace_min_km", "distance_m").alias("pace_distance"), F.corr("avg_hr", "distance_m").alias("hr_distance"))


# ---- health -----------------------------------------------------------------------------------------------------------


@query(f"WITH {D} SELECT athlete_id, date, metric, {r6('value')}, source FROM d")
def health_aggregate_daily(spark, sf_dir):
    return _daily(spark, sf_dir)


CLEAN = f"""{H}, h2 AS (SELECT *, bool_or(source <> 'Connect') OVER (PARTITION BY athlete_id, date, metric) AS pure FROM h),
h3 AS (SELECT athlete_id, date, metric, value, source, seq FROM h2 WHERE NOT (metric = 'resting_heart_rate' AND source = 'Connect' AND pure))"""


@query(f"""WITH {CLEAN}, n AS (SELECT athlete_id, date, 'sleep_totalSleep' AS metric, value * 2.5 - 10 AS value, source, seq FROM h3 WHERE metric = 'sleep_totalSleep'
  UNION ALL SELECT athlete_id, date, 'sleep_inBed', value / 10, source, seq FROM h3 WHERE metric = 'step_count' UNION ALL SELECT * FROM h3 WHERE metric NOT IN ('sleep_totalSleep', 'step_count')),
k AS (SELECT DISTINCT x.athlete_id, x.date FROM n x JOIN n y ON x.athlete_id = y.athlete_id AND x.date = y.date AND x.source = y.source WHERE x.metric = 'sleep_totalSleep' AND y.metric = 'sleep_inBed' AND y.value > 4),
bad AS (SELECT DISTINCT n.athlete_id, n.date, n.source FROM n LEFT JOIN k ON k.athlete_id = n.athlete_id AND k.date = n.date WHERE metric = 'sleep_totalSleep' AND (value > 16 OR (value < 2 AND k.date IS NOT NULL)))
SELECT n.athlete_id, n.date, metric, {r6('value')}, n.source, seq FROM n LEFT JOIN bad b ON b.athlete_id = n.athlete_id AND b.date = n.date AND b.source = n.source WHERE NOT (b.date IS NOT NULL AND metric LIKE 'sleep@_%' ESCAPE '@')""")
def clean_sources(spark, sf_dir):
    x, m, v = t.health(spark, sf_dir), F.col("metric"), F.col("value")
    x = x.withColumn("value", F.when(m == "sleep_totalSleep", v * 2.5 - 10).when(m == "step_count", v / 10).otherwise(v)).withColumn("metric", F.when(m == "step_count", "sleep_inBed").otherwise(m))
    return h.clean_sources(x)


@query(f"""WITH {H}, u AS (SELECT athlete_id, date, metric, value, source, seq, (seq % 3 = 0)::INT AS cached FROM h)
SELECT athlete_id, date, metric, {r6('value')}, source, seq FROM u QUALIFY row_number() OVER (PARTITION BY athlete_id, date, metric ORDER BY CASE source WHEN 'watch' THEN 1 WHEN 'ring' THEN 2 WHEN 'phone' THEN 3 ELSE 99 END, cached, seq) = 1""")
def health_priority_dedup(spark, sf_dir):
    x = t.health(spark, sf_dir)
    return h.priority_dedup(x.where("seq % 3 <> 0"), x.where("seq % 3 = 0"))


WIDE_SQL = "max(value) FILTER (metric = 'heart_rate_variability') AS heart_rate_variability, max(value) FILTER (metric = 'resting_heart_rate') AS resting_heart_rate, max(value) FILTER (metric = 'sleep_totalSleep') AS \"sleep_totalSleep\", max(value) FILTER (metric = 'sleep_deep') AS sleep_deep, max(value) FILTER (metric = 'sleep_rem') AS sleep_rem, max(value) FILTER (metric = 'apple_sleeping_wrist_temperature') AS apple_sleeping_wrist_temperature"
WIDE = f"{D}, wide AS (SELECT athlete_id, date, {WIDE_SQL} FROM d WHERE metric <> 'step_count' GROUP BY 1, 2)"
WIDE_OUT = r6("heart_rate_variability", "resting_heart_rate", '"sleep_totalSleep"', "sleep_deep", "sleep_rem", "apple_sleeping_wrist_temperature")


@query(f"WITH {WIDE} SELECT athlete_id, date, {WIDE_OUT} FROM wide")
def health_wide(spark, sf_dir):
    return h.wide(_daily(spark, sf_dir))


@query(f"WITH {WIDE} SELECT athlete_id, date, {WIDE_OUT}, {r6('CASE WHEN heart_rate_variability > 0 THEN ln(heart_rate_variability) END AS ln_rmssd')} FROM wide")
def readiness_inputs(spark, sf_dir):
    return h.readiness_inputs(_daily(spark, sf_dir))


@query(f"WITH {R} SELECT athlete_id, date, {r6('rhr')} FROM rhr")
def resting_hr_daily(spark, sf_dir):
    return h.resting_hr(t.health(spark, sf_dir))


@query(f"WITH {R} SELECT athlete_id, year(date)::INTEGER AS year, {r6('avg(rhr) AS rhr_mean')}, DATE '1970-01-01' + CAST(floor(avg(date - DATE '1970-01-01')) AS INTEGER) AS mid_date FROM rhr GROUP BY 1, 2")
def rhr_annual(spark, sf_dir):
    r = h.resting_hr(t.health(spark, sf_dir))
    return r.groupBy("athlete_id", F.year("date").alias("year")).agg(F.avg("rhr").alias("rhr_mean"), F.date_from_unix_date(F.floor(F.avg(F.unix_date("date"))).cast("int")).alias("mid_date"))


@query(f"""WITH {R}, e AS (SELECT athlete_id, count(*) AS n, min(date - DATE '1970-01-01') AS lo, max(date - DATE '1970-01-01') AS hi FROM rhr GROUP BY 1),
g AS (SELECT athlete_id, n, k, lo + (hi - lo) * k / 79.0::DOUBLE AS at_day FROM e, (SELECT unnest(range(80)) AS k) WHERE hi > lo OR k = 0),
d AS (SELECT athlete_id, k, at_day, rhr AS y, (date - DATE '1970-01-01') - at_day AS d, row_number() OVER (PARTITION BY athlete_id, k ORDER BY abs((date - DATE '1970-01-01') - at_day)) AS nth, greatest(1, floor(n * 0.75::DOUBLE + 0.00001)) AS take FROM g JOIN rhr USING (athlete_id)),
w AS (SELECT *, max(abs(d)) FILTER (nth = take) OVER (PARTITION BY athlete_id, k) AS reach FROM d),
v AS (SELECT *, CASE WHEN reach = 0 THEN (d = 0)::INT WHEN abs(d) < reach THEN (1 - (abs(d) / reach) ** 3) ** 3 ELSE 0 END AS w FROM w),
f AS (SELECT athlete_id, at_day, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1, count(DISTINCT d) FILTER (w > 0) AS many FROM v GROUP BY ALL)
SELECT athlete_id, {r6('at_day', 'CASE WHEN many > 1 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS fitted')} FROM f""")
def rhr_smooth(spark, sf_dir):
    """The curve through each athlete's resting heart rates: local lines over three quarters of the days."""
    return local_regression(h.resting_hr(t.health(spark, sf_dir)), "date", "rhr", span=0.75, degree=1).withColumnRenamed("date", "at_day")


@query(f"WITH {H} SELECT athlete_id, count(*) AS n_rows, count(DISTINCT metric) AS n_metrics, min(date) AS first_date, max(date) AS last_date FROM h GROUP BY 1")
def health_stats(spark, sf_dir):
    return h.stats(t.health(spark, sf_dir))


@query(f"WITH {D} SELECT athlete_id, date, metric, {r6('value')} FROM d WHERE metric = 'resting_heart_rate' {_last(30, 'date DESC')}")
def report_metric(spark, sf_dir):
    return reports.metric(_daily(spark, sf_dir), "resting_heart_rate", 30)


HB = f"{D}, q AS (SELECT athlete_id, date, value FROM d WHERE metric = 'heart_rate_variability'), b AS (SELECT *, {full('avg(value)', 7)} AS m, {full('stddev_samp(value)', 7)} AS s FROM q)"


@query(f"WITH {HB} SELECT athlete_id, date, {r6('value', 'm AS mean', 's AS sd', 'm - s AS low', 'm + s AS high')} FROM b")
def hrv_band(spark, sf_dir):
    return metrics.hrv_band(_daily(spark, sf_dir))


@query(f"""WITH {WIDE}, b AS (SELECT athlete_id, date, ln(heart_rate_variability) AS ln, {full('avg(ln(heart_rate_variability))', 7)} AS m, {full('stddev_samp(ln(heart_rate_variability))', 7)} AS s FROM wide)
SELECT athlete_id, date, {r6('CASE WHEN s > 0 THEN (ln - m) / s END AS hrv_z')} FROM b""")
def hrv_zscore(spark, sf_dir):
    ln = F.col("ln_rmssd")
    d = h.readiness_inputs(_daily(spark, sf_dir)).withColumn("m", ts.rolling_mean(ln, 7)).withColumn("s", ts.rolling_sd(ln, 7))
    return d.select("athlete_id", "date", F.when(F.col("s") > 0, (ln - F.col("m")) / F.col("s")).alias("hrv_z"))


MEDIAN14 = f"CASE WHEN count(apple_sleeping_wrist_temperature) OVER ({W_} ROWS 13 PRECEDING) >= 3 THEN median(apple_sleeping_wrist_temperature) OVER ({W_} ROWS 13 PRECEDING) END"


@query(f"WITH {WIDE} SELECT athlete_id, date, {r6(MEDIAN14 + ' AS baseline')} FROM wide")
def wrist_temp_baseline(spark, sf_dir):
    d = h.wide(_daily(spark, sf_dir))
    return d.select("athlete_id", "date", ts.rolling_median(F.col("apple_sleeping_wrist_temperature"), 14, 3).alias("baseline"))


READY = f"""{PMC}, {WIDE.replace(H + ',', '', 1)}, j AS (SELECT coalesce(w.athlete_id, p.athlete_id) AS athlete_id, coalesce(w.date, p.date) AS date, * EXCLUDE (athlete_id, date, k),
  CASE WHEN heart_rate_variability > 0 THEN ln(heart_rate_variability) END AS ln_rmssd FROM wide w FULL JOIN pmc p ON p.athlete_id = w.athlete_id AND p.date = w.date),
{_preceding_sql('j', 'rhr_30d_mean', 'NULL', 'base')},
j2 AS (SELECT *, {full('avg(ln_rmssd)', 7)} AS ln_rmssd_7d_mean, {full('stddev_samp(ln_rmssd)', 7)} AS ln_rmssd_7d_sd, resting_heart_rate - rhr_30d_mean AS rhr_deviation, ctl - atl AS tsb,
  {MEDIAN14} AS wrist_temp_14d, lag(daily_trimp, 1, 0) OVER ({W_}) AS ty FROM j JOIN base USING (athlete_id, date)),
j3 AS (SELECT *, CASE WHEN ln_rmssd_7d_sd > 0 THEN (ln_rmssd - ln_rmssd_7d_mean) / ln_rmssd_7d_sd END AS hrv_z, apple_sleeping_wrist_temperature - wrist_temp_14d AS wrist_temp_deviation, CASE WHEN atl > 0 THEN ty / atl END AS trimp_ratio FROM j2),
j4 AS (SELECT *, {sql_piecewise('hrv_z', expr.HRV_POINTS)} AS hrv_score, CASE WHEN "sleep_totalSleep" IS NOT NULL THEN {sql_sleep('"sleep_totalSleep"', 'sleep_deep', 'sleep_rem')} END AS sleep_score, {sql_piecewise('rhr_deviation', expr.RHR_POINTS)} AS rhr_score,
  {sql_piecewise('trimp_ratio', expr.LOAD_POINTS)} AS trimp_score, {sql_piecewise('wrist_temp_deviation', expr.WRIST_POINTS)} AS wrist_temp_score,
  coalesce(rhr_deviation > 5, false) AS ra, coalesce(wrist_temp_deviation > 0.5, false) AS wa FROM j3),
j5 AS (SELECT *, {sql_composite(expr.WEIGHTS_WRIST, '_score')} AS readiness_score, (hrv_score IS NOT NULL)::INT + (sleep_score IS NOT NULL)::INT + (rhr_score IS NOT NULL)::INT + (trimp_score IS NOT NULL)::INT + (wrist_temp_score IS NOT NULL)::INT AS nc,
  row_number() OVER ({W_}) - row_number() OVER (PARTITION BY athlete_id, ra ORDER BY date) AS rg, row_number() OVER ({W_}) - row_number() OVER (PARTITION BY athlete_id, wa ORDER BY date) AS wg FROM j4),
ready AS (SELECT athlete_id, date, {r6('readiness_score', 'ln_rmssd', 'ln_rmssd_7d_mean', 'ln_rmssd_7d_sd', 'hrv_z', 'hrv_score', 'resting_heart_rate AS resting_hr', 'rhr_30d_mean', 'rhr_deviation', 'rhr_score', '"sleep_totalSleep" AS sleep_total', 'sleep_deep', 'sleep_rem', 'sleep_score', 'daily_trimp', 'atl', 'ctl', 'tsb', 'trimp_score', 'apple_sleeping_wrist_temperature AS wrist_temp', 'wrist_temp_14d', 'wrist_temp_deviation', 'wrist_temp_score')},
  CASE WHEN readiness_score >= 70 THEN 'green' WHEN readiness_score >= 40 THEN 'yellow' WHEN readiness_score IS NOT NULL THEN 'red' END AS readiness_status,
  coalesce(hrv_z < -1, false) AS hrv_flag, ra AND count(*) OVER (PARTITION BY athlete_id, ra, rg) >= 3 AS rhr_flag, coalesce("sleep_totalSleep" < 7 AND hrv_z < 0, false) AS sleep_flag, coalesce(atl > 0 AND ty > 2 * atl, false) AS load_flag,
  wa AND count(*) OVER (PARTITION BY athlete_id, wa, wg) >= 2 AS wrist_temp_flag, CASE WHEN nc = 5 THEN 'full' WHEN nc >= 2 THEN 'partial' WHEN nc = 1 THEN 'minimal' END AS data_quality FROM j5)"""


def _readiness(spark, sf_dir):
    x = t.health(spark, sf_dir)
    return readiness_plan(h.aggregate_daily(x), _a(spark, sf_dir), h.resting_hr(x), AS_OF)


@query(f"WITH RECURSIVE {READY} SELECT * FROM ready")
def readiness(spark, sf_dir):
    return _readiness(spark, sf_dir)


@query(f"WITH RECURSIVE {READY} SELECT * FROM ready {_last(14, 'date DESC')}")
def report_readiness(spark, sf_dir):
    return reports.readiness(_readiness(spark, sf_dir), 14)


PUSHED = """p AS (SELECT event_id AS seq, user_id % 8 AS athlete_id, CAST(ts AS DATE) AS date, event_type, value FROM events),
x AS (SELECT seq, athlete_id, date, event_type AS metric, 'u' AS units, value, 'watch' AS source FROM p WHERE event_type <> 'click'
  UNION ALL SELECT seq, athlete_id, date, 'heart_rate_min', 'bpm', value, 'ring' FROM p WHERE event_type = 'click'
  UNION ALL SELECT seq, athlete_id, date, 'heart_rate_avg', 'bpm', value + 5, 'ring' FROM p WHERE event_type = 'click'
  UNION ALL SELECT seq, athlete_id, date, 'heart_rate_max', 'bpm', value + 9, 'ring' FROM p WHERE event_type = 'click')"""


@query(f"WITH {PUSHED} SELECT seq, athlete_id, metric, units, date, {r6('value')}, source FROM x")
def health_parse_qty(spark, sf_dir):
    return h.parse_push(t.pushes(spark, sf_dir))


@query(f"WITH {H}, q AS (SELECT athlete_id, date, source, min(value) AS a, avg(value) AS b, max(value) AS c FROM h WHERE metric = 'resting_heart_rate' GROUP BY ALL) " + " UNION ALL ".join(f"SELECT athlete_id, date, source, 'heart_rate_{n}' AS metric, {r6(f'{c} AS value')} FROM q" for n, c in (("min", "a"), ("avg", "b"), ("max", "c"))))
def heart_rate_unpivot(spark, sf_dir):
    x = t.health(spark, sf_dir).where("metric = 'resting_heart_rate'").groupBy("athlete_id", "date", "source")
    return h.heart_rate_rows(x.agg(F.min("value").alias("heart_rate_min"), F.avg("value").alias("heart_rate_avg"), F.max("value").alias("heart_rate_max")))


@query(f"""WITH {D}, b AS (SELECT athlete_id, date, metric, value FROM d WHERE NOT (date >= DATE '2001-07-30' AND metric IN ('resting_heart_rate', 'sleep_totalSleep')))
SELECT athlete_id, date, metric, {r6('value')} FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.athlete_id = d.athlete_id AND b.date = d.date AND b.metric = d.metric AND b.value IS NOT DISTINCT FROM d.value)""")
def health_changed_rows(spark, sf_dir):
    d = _daily(spark, sf_dir).drop("source")
    return joins.changed_rows(d, d.where("not (date >= date'2001-07-30' and metric in ('resting_heart_rate', 'sleep_totalSleep'))"))


@query(f"""WITH {D}, b AS (SELECT * FROM d WHERE date < DATE '2001-07-31'), f AS (SELECT athlete_id, max(date) AS fd FROM d WHERE date >= DATE '2001-07-31' GROUP BY 1),
n AS (SELECT d.athlete_id, date, metric, value, fd FROM d JOIN f USING (athlete_id) WHERE date = fd AND metric <> 'step_count'),
w AS (SELECT n.*, (SELECT CASE WHEN count(*) >= 2 THEN avg(b.value) END FROM b WHERE b.athlete_id = n.athlete_id AND b.metric = n.metric AND b.date >= fd - 7 AND b.date < fd) AS aw FROM n),
y AS (SELECT *, CASE metric WHEN 'heart_rate_variability' THEN 5 WHEN 'resting_heart_rate' THEN 4 WHEN 'sleep_totalSleep' THEN 0.5 END AS lim FROM w),
z AS (SELECT athlete_id, date, metric, value, value - aw AS dl, lim, CASE WHEN lim IS NULL THEN 'always' WHEN metric = 'sleep_totalSleep' AND value < 5.5 THEN 'short night' WHEN aw IS NULL THEN 'no week' ELSE 'differs' END AS why FROM y)
SELECT athlete_id, date, metric, {r6('value', "CASE WHEN why = 'differs' THEN dl END AS delta")}, why FROM z WHERE why <> 'differs' OR abs(dl) >= lim""")
def health_insight(spark, sf_dir):
    d = _daily(spark, sf_dir).drop("source")
    return insight.health_changes(d, d.where("date < date'2001-07-31'"))


@query("""WITH w AS (SELECT user_id % 8 AS athlete_id, to_timestamp(floor(epoch(ts) / 600) * 600) AS ts, value, event_id AS seq FROM events),
k AS (SELECT *, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS date FROM w QUALIFY row_number() OVER (PARTITION BY athlete_id, ts ORDER BY seq) = 1)
SELECT athlete_id, epoch(ts)::BIGINT AS at, date, round(60 + value % 30, 6) AS weight, round(100 * (10 + value % 7) / (60 + value % 30), 6) AS fat_pct, round(60 + value % 30 - (10 + value % 7), 6) AS lean_mass FROM k WHERE day(date) % 5 <> 0""")
def body_composition(spark, sf_dir):
    w = t.weights(spark, sf_dir)
    known = w.select("athlete_id", F.to_date("ts").alias("date")).where(F.dayofmonth("date") % 5 == 0).distinct()
    return h.body_composition(w, known).withColumn("at", F.unix_seconds("ts")).drop("ts")


# ---- sleep ------------------------------------------------------------------------------------------------------------


@query(f"WITH {SEG} SELECT athlete_id, start_ts, end_ts, suffix, source, hours, date FROM sd")
def sleep_night_date(spark, sf_dir):
    return sleep.segments(t.sleep_segments(spark, sf_dir)).drop("stage")


@query(f"WITH {SEG} SELECT athlete_id, date, source, has_staging FROM pick WHERE k = 1")
def sleep_best_source(spark, sf_dir):
    return sleep.best_source(sleep.segments(t.sleep_segments(spark, sf_dir)))


NUMBERS = ("totalSleep", *sleep.SUFFIXES)


@query(f"""WITH {SEG} SELECT athlete_id, date, source, {", ".join(f'round("{c}", 6) AS "{c}"' for c in NUMBERS)}, "sleepStart", "sleepEnd", "inBedStart", "inBedEnd" FROM nt""")
def sleep_nightly(spark, sf_dir):
    return sleep.nights(t.sleep_segments(spark, sf_dir))


def _hour(c: str) -> str:
    z = f"(CAST(\"{c}\"[1:19] AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Stockholm'"
    return f"hour({z}) + minute({z}) / 60.0::DOUBLE + second({z}) / 3600.0::DOUBLE"


LONG = " UNION ALL ".join([f"SELECT athlete_id, date, 'sleep_{c}' AS metric, round(\"{c}\", 6) AS value, source FROM nt" for c in NUMBERS] + [f"SELECT athlete_id, date, 'sleep_{c}', round({_hour(c)}, 6), source FROM nt WHERE \"{c}\" IS NOT NULL" for c in sleep.TIMES])


@query(f"WITH {SEG} {LONG}")
def sleep_long(spark, sf_dir):
    return sleep.long_rows(sleep.nights(t.sleep_segments(spark, sf_dir)))


@query(f"WITH {SEG} SELECT * FROM ({LONG}) WHERE value IS NOT NULL AND NOT (metric = 'sleep_asleep' AND value = 0)")
def sleep_aggregated(spark, sf_dir):
    n = sleep.nights(t.sleep_segments(spark, sf_dir))
    return sleep.aggregated_rows(n.withColumn("asleep", F.nullif("asleep", F.lit(0.0))))


NIGHTS = " UNION ALL ".join(
    [f"SELECT 100 + user_id % 8 AS athlete_id, CAST(ts AS DATE) AS date, 'sleep_{n}' AS metric, round({v}, 6) AS value, 'watch' AS source FROM events WHERE event_type = 'purchase'{w}" for n, v, w in (("totalSleep", "round(value % 8, 2)", ""), ("core", "round(value % 3, 2)", ""), ("deep", "round(value % 2, 2)", " AND event_id % 2 = 0"))]
    + [f"SELECT 100 + user_id % 8, CAST(ts AS DATE), 'sleep_sleepStart', round({_hour('start')}, 6), 'watch' FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +0000' AS start FROM events) WHERE event_type = 'purchase'"]
)


@query(f"WITH {SEG} {LONG} UNION ALL {NIGHTS}")
def sleep_from_push(spark, sf_dir):
    return sleep.from_samples(h.push_samples(t.sleep_pushes(spark, sf_dir)))


@query(f"""WITH {SEG} {LONG} UNION ALL {NIGHTS} UNION ALL SELECT user_id % 8, CAST(ts AS DATE), event_type, round(value, 6), 'watch' FROM events WHERE event_type <> 'click'
{" ".join(f"UNION ALL SELECT user_id % 8, CAST(ts AS DATE), 'heart_rate_{n}', round(value + {d}, 6), 'ring' FROM events WHERE event_type = 'click'" for n, d in (("min", 0), ("avg", 5), ("max", 9)))}""")
def sleep_from_canonical(spark, sf_dir):
    return canonical_measures(t.canonical_bodies(spark, sf_dir)).drop("seq")


@query(f"WITH {SEG} SELECT athlete_id, date_trunc('week', date)::DATE AS period, {r6('avg(core) AS core', 'avg(deep) AS deep', 'avg(rem) AS rem', 'avg(awake) AS awake')}, count(*) AS n_nights FROM nt GROUP BY 1, 2")
def sleep_stage_trend(spark, sf_dir):
    return sleep.stage_trend(sleep.nights(t.sleep_segments(spark, sf_dir)), "week")


# ---- joins and deduplication ------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT event_id AS activity_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS device_id, ts AS dts, value FROM events WHERE event_type = 'view'),
m AS (SELECT activity_id, device_id, value FROM l JOIN v ON dts >= ts - INTERVAL 120 SECOND AND dts <= ts + INTERVAL 120 SECOND
  QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY abs(epoch_us(ts) - epoch_us(dts)), device_id) = 1)
SELECT l.activity_id, m.device_id, round(m.value, 6) AS device_value FROM l LEFT JOIN m USING (activity_id)""")
def nearest_join_120s(spark, sf_dir):
    left, right = t.device_pair(spark, sf_dir)
    return joins.nearest_join(left, right, "session_start", "device_ts", "activity_id", "device_id").select("activity_id", "device_id", "device_value")


@query("SELECT event_id FROM events n WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events k WHERE k.event_type <> 'click' AND k.ts > n.ts - INTERVAL 2 SECOND AND k.ts < n.ts + INTERVAL 2 SECOND)")
def near_dup_2s(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return joins.near_duplicates(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "ts", "ts").select("event_id")


@query(f"WITH {H} SELECT athlete_id, date, metric, {r6('value')}, source, seq FROM h QUALIFY row_number() OVER (PARTITION BY athlete_id, date, metric ORDER BY seq DESC) = 1")
def dedup_last_wins(spark, sf_dir):
    return ts.keep_first(t.health(spark, sf_dir), ["athlete_id", "date", "metric"], [F.col("seq").desc()])


@query(f"WITH {A} SELECT athlete_id, date, activity_id, sport FROM a QUALIFY row_number() OVER (PARTITION BY athlete_id, date ORDER BY activity_id) = 1")
def dedup_keep_first(spark, sf_dir):
    a = _a(spark, sf_dir).withColumn("date", F.to_date("session_start"))
    return ts.keep_first(a, ["athlete_id", "date"], ["activity_id"]).select("athlete_id", "date", "activity_id", "sport")


@query(f"""WITH {PUSHED.replace('CAST(ts AS DATE) AS date', "CAST(ts AS DATE) AS date, strftime(ts, '%Y-%m-%d %H') AS hour").replace('seq, athlete_id, date,', 'seq, athlete_id, date, hour,')},
n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY athlete_id, metric, hour, source ORDER BY seq) = 1)
SELECT seq, athlete_id, metric, units, hour, date, {r6('value')}, source FROM n WHERE NOT EXISTS (SELECT 1 FROM x WHERE seq % 4 = 0 AND x.athlete_id = n.athlete_id AND x.metric = n.metric AND x.hour = n.hour AND x.source = n.source)""")
def dedup_existing_wins(spark, sf_dir):
    """Pushes of a device whose clock knows hours only, so that samples repeat; every fourth is stored already, with another value."""
    x = h.quantities(h.push_samples(t.pushes(spark, sf_dir)).drop("place")).withColumns({"at": F.substring("at", 1, 13), "stage": F.lit("")})
    stored = x.where("seq % 4 = 0").withColumn("value", F.col("value") + 1)
    return ingest.new_samples(x, stored, ["seq"]).drop("stage").withColumnRenamed("at", "hour")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def incremental_new_ids(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return joins.new_rows(e, e.where("event_type = 'view'"), ["event_id"]).select("event_id", "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value, 6) WHEN event_id % 3 = 1 THEN round(value, 6) END AS "maxHR", CASE WHEN event_id % 3 = 1 THEN round(value / 2, 6) END AS "vO2MaxValue" FROM events""")
def json_dual_format(spark, sf_dir):
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 3
    new = F.to_json(F.struct(F.col("value").alias("maxHR"), (F.col("value") / 2).alias("vO2MaxValue")))
    old = F.concat(F.lit('{"vO2MaxValue": 1.5, "summaryDTO": '), F.to_json(F.struct(F.col("value").alias("maxHR"))), F.lit("}"))
    body = F.when(k == 0, old).when(k == 1, new).otherwise(F.lit("{broken"))
    return dual_format(e.select("event_id", body.alias("body")), "body", "maxHR double, vO2MaxValue double").drop("body")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value, 6) END AS recoveryHeartRate, CASE WHEN event_id % 6 = 0 THEN round(value / 4, 6) END AS minHR FROM events")
def json_details_nested(spark, sf_dir):
    """Details count under summaryDTO only; fields of other bodies and missing ones are null."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 3
    nested = F.to_json(F.struct(F.struct(F.col("value").alias("recoveryHeartRate"), F.when(F.col("event_id") % 6 == 0, F.col("value") / 4).alias("minHR")).alias("summaryDTO"), F.lit(9.0).alias("minHR")))
    body = F.when(k == 0, nested).when(k == 1, F.lit('{"recoveryHeartRate": 50.0, "minHR": 40.0}')).otherwise(F.lit("[1"))
    return dual_format(e.select("event_id", body.alias("body")), "body", "recoveryHeartRate double, minHR double", nested_only=True).drop("body")


# ---- sessions ---------------------------------------------------------------------------------------------------------

SHARES = r6("100 * sum(z1) / sum(z1 + z2 + z3) AS z1_pct", "100 * sum(z2) / sum(z1 + z2 + z3) AS z2_pct", "100 * sum(z3) / sum(z1 + z2 + z3) AS z3_pct")
MINUTES = r6("sum(z1 + z2 + z3) / 60 AS total_min")
ZD = "zd AS (SELECT athlete_id, activity_id, date, z1_s + z2_s AS z1, z3_s AS z2, z4_s + z5_s AS z3 FROM r WHERE z1_s IS NOT NULL AND z2_s IS NOT NULL AND z3_s IS NOT NULL AND z4_s IS NOT NULL AND z5_s IS NOT NULL AND z1_s + z2_s + z3_s + z4_s + z5_s > 0)"
ZS = f"""{S}, zs AS (SELECT athlete_id, r.activity_id, r.date, count(*) FILTER (heart_rate < 190 * 0.8)::DOUBLE AS z1, count(*) FILTER (heart_rate >= 190 * 0.8 AND heart_rate < 190 * 0.9)::DOUBLE AS z2,
count(*) FILTER (heart_rate >= 190 * 0.9)::DOUBLE AS z3 FROM s JOIN r ON r.activity_id = s.activity_id WHERE heart_rate > 0 GROUP BY 1, 2, 3)"""
ZH = f"{A}, {ZD}, {ZS}, zh AS (SELECT *, 'samples' AS origin FROM zs UNION ALL SELECT *, 'device' FROM zd WHERE activity_id NOT IN (SELECT activity_id FROM zs))"
PCT = r6("100 * z1 / (z1 + z2 + z3) AS z1_pct", "100 * z2 / (z1 + z2 + z3) AS z2_pct", "100 * z3 / (z1 + z2 + z3) AS z3_pct")


@query(f"WITH {A}, {ZD} SELECT athlete_id, activity_id, date, {r6('z1', 'z2', 'z3')}, {PCT} FROM zd")
def zones_device(spark, sf_dir):
    return sessions.device_zones(_a(spark, sf_dir)).per_activity


@query(f"WITH {A}, {ZS} SELECT athlete_id, activity_id, date, {r6('z1', 'z2', 'z3')}, {PCT} FROM zs")
def zones_persample(spark, sf_dir):
    return sessions.sample_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).per_activity


@query(f"WITH {ZH} SELECT athlete_id, activity_id, date, {r6('z1', 'z2', 'z3')}, {PCT}, origin FROM zh")
def zones_hybrid(spark, sf_dir):
    return sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).per_activity


@query(f"WITH {ZH} SELECT athlete_id, strftime(date, '%Y-%m') AS year_month, {SHARES}, count(*) AS n_activities, {MINUTES} FROM zh GROUP BY 1, 2")
def zones_monthly(spark, sf_dir):
    return sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).monthly


SUNDAY = "(date_trunc('week', date + 1)::DATE - 1)"


@query(f"WITH {ZH} SELECT athlete_id, {SUNDAY} AS week, {SHARES}, count(*) AS n_activities, {MINUTES} FROM zh GROUP BY 1, 2")
def zones_weekly(spark, sf_dir):
    from stridewell.functions.dates import sunday_week

    return sessions.shares(sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).per_activity, ["athlete_id"], sunday_week(F.col("date")), "week")


@query(f"WITH {ZH}, m AS (SELECT athlete_id, {SUNDAY} AS week, {SHARES} FROM zh GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT athlete_id, week, 'z{i}' AS zone, z{i}_pct AS pct FROM m" for i in (1, 2, 3)))
def zones_long(spark, sf_dir):
    from stridewell.functions.dates import sunday_week

    w = sessions.shares(sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).per_activity, ["athlete_id"], sunday_week(F.col("date")), "week")
    return w.unpivot(["athlete_id", "week"], ["z1_pct", "z2_pct", "z3_pct"], "zone", "pct").withColumn("zone", F.substring("zone", 1, 2))


@query(f"""WITH {ZH}, m AS (SELECT athlete_id, strftime(date, '%Y-%m') AS year_month, sum(z1) / sum(z1 + z2 + z3) AS p1, sum(z2) / sum(z1 + z2 + z3) AS p2, sum(z3) / sum(z1 + z2 + z3) AS p3 FROM zh GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN p3 = 0 THEN 0 WHEN p2 = 0 AND p3 < 0.01 THEN 0 WHEN p2 = 0 THEN p1 / 0.01 * (p3 - 0.01) * 100 ELSE p1 / p2 * p3 * 100 END AS raw FROM m)
SELECT athlete_id, year_month, {r6('CASE WHEN raw > 0 THEN log10(raw) ELSE 0 END AS pi')}, p2 = 0 OR p3 = 0 AS has_zero_zone FROM q""")
def polarization_index(spark, sf_dir):
    return sessions.polarization_index(sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)).monthly).select("athlete_id", "year_month", "pi", "has_zero_zone")


@query(f"""WITH {A}, {ZS}, v AS (SELECT athlete_id, activity_id, date, z1_s + z2_s AS d1, z3_s AS d2, z4_s + z5_s AS d3 FROM r WHERE z1_s IS NOT NULL AND z5_s IS NOT NULL AND z1_s + z2_s + z3_s + z4_s + z5_s > 0),
c AS (SELECT v.athlete_id, v.activity_id, v.date, {", ".join(f"100 * d{i} / (d1 + d2 + d3) AS a{i}, 100 * z{i} / (z1 + z2 + z3) AS b{i}" for i in (1, 2, 3))} FROM v JOIN zs USING (activity_id))
SELECT athlete_id, activity_id, date, {r6(*[x for i in (1, 2, 3) for x in (f'a{i} AS z{i}_device', f'b{i} AS z{i}_samples', f'a{i} - b{i} AS z{i}_diff')])} FROM c""")
def zones_crossval(spark, sf_dir):
    return sessions.cross_validation(_a(spark, sf_dir), t.samples(spark, sf_dir))


def _decoupling_sql(source: str) -> str:
    """SQL: CTE dc of sessions in source (activity_id, ts, speed, heart_rate)."""
    return f"""v0 AS (SELECT activity_id, ts, speed, heart_rate, epoch_us(ts)::DOUBLE / 1000000 AS tm FROM {source} WHERE speed > 0 AND heart_rate > 0),
    v1 AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n, min(tm) OVER (PARTITION BY activity_id) AS f FROM v0),
    v2 AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n2 FROM v1 WHERE n >= 10 AND tm - f >= 600),
    v3 AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts) AS rn, sum(speed) OVER (PARTITION BY activity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum, tm - lag(tm) OVER (PARTITION BY activity_id ORDER BY ts) AS gap FROM v2 WHERE n2 >= 10),
    wd AS (SELECT activity_id, greatest(round_even({SMOOTH}::DOUBLE / greatest(quantile_cont(gap, 0.5), 1), 0), 3)::INTEGER AS width FROM v3 GROUP BY 1),
    v4 AS (SELECT a.*, width, (a.cum - coalesce(b.cum, 0)) / width AS sm FROM v3 a JOIN wd USING (activity_id) LEFT JOIN v3 b ON b.activity_id = a.activity_id AND b.rn = a.rn - width WHERE a.rn >= width),
    v5 AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n3, min(tm) OVER (PARTITION BY activity_id) AS lo, max(tm) OVER (PARTITION BY activity_id) AS hi FROM v4),
    v6 AS (SELECT *, tm - lo <= (hi - lo) / 2 AS early FROM v5 WHERE n3 >= 10),
    v7 AS (SELECT activity_id, any_value(width) AS width, count(*) AS n_points, avg(sm) FILTER (early) AS m1, avg(sm) FILTER (NOT early) AS m2, avg(sm / heart_rate) FILTER (early) AS ratio_first, avg(sm / heart_rate) FILTER (NOT early) AS ratio_second FROM v6 GROUP BY 1),
    dc AS (SELECT activity_id, width, n_points, ratio_first, ratio_second, 100 * (ratio_first - ratio_second) / ratio_first AS decoupling_pct FROM v7 WHERE abs(m1 - m2) / greatest(m1, m2) * 100 <= 10 AND ratio_first <> 0 AND ratio_second IS NOT NULL)"""


DC_OUT = r6("ratio_first", "ratio_second", "decoupling_pct")


@query(f"WITH {S}, {_decoupling_sql('s')} SELECT activity_id, width, n_points, {DC_OUT} FROM dc")
def decoupling(spark, sf_dir):
    return sessions.decoupling(t.samples(spark, sf_dir), smooth_s=SMOOTH)


def _series(spark, sf_dir):
    return sessions.decoupling_series(_a(spark, sf_dir), t.samples(spark, sf_dir), smooth_s=SMOOTH)


DC_SERIES = f"""{A}, {S}, {_decoupling_sql('s')}, pr AS (SELECT r.athlete_id, r.activity_id, r.date, distance_m / 1000 AS distance_km, avg_pace_min_km, avg_hr, width, n_points, ratio_first, ratio_second, decoupling_pct
  FROM r JOIN dc USING (activity_id) WHERE duration_min > 45 AND avg_pace_min_km > 5),
dd AS (SELECT athlete_id, date, avg(decoupling_pct) AS x FROM pr GROUP BY ALL), {spine("dd", "dsp")},
dro AS (SELECT athlete_id, date, {full("avg(x)", 28)} AS decoupling_rolling28 FROM dsp LEFT JOIN dd USING (athlete_id, date)),
dout AS (SELECT pr.*, decoupling_rolling28 FROM pr LEFT JOIN dro USING (athlete_id, date))"""


@query(f"WITH {DC_SERIES} SELECT athlete_id, activity_id, date, width, n_points, {r6('distance_km', 'avg_pace_min_km', 'avg_hr')}, {DC_OUT}, {r6('decoupling_rolling28')} FROM dout {_last(28)}")
def report_decoupling(spark, sf_dir):
    return reports.decoupling(_series(spark, sf_dir))


@query(f"WITH {DC_SERIES} SELECT DISTINCT athlete_id, date FROM r WHERE duration_min > 45 AND avg_pace_min_km > 5 EXCEPT SELECT athlete_id, date FROM pr")
def decoupling_skipped(spark, sf_dir):
    r = metrics.runs(_a(spark, sf_dir)).where("duration_min > 45 and avg_pace_min_km > 5").select("athlete_id", "date").distinct()
    return r.exceptAll(_series(spark, sf_dir).select("athlete_id", "date").distinct())


@query(f"WITH {S} SELECT activity_id, count(*) AS n_samples, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, {r6('avg(speed) AS avg_speed', 'avg(heart_rate) FILTER (heart_rate > 0) AS avg_hr', 'max(heart_rate) AS max_hr')} FROM s GROUP BY 1")
def activity_rollup(spark, sf_dir):
    return sessions.rollup(t.samples(spark, sf_dir)).select("activity_id", "n_samples", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "avg_speed", "avg_hr", "max_hr")


@query(f"WITH {S}, b AS (SELECT activity_id, floor((epoch_us(ts)::DOUBLE / 1000000 + 300) / 600) AS k, avg(heart_rate) AS m FROM s GROUP BY 1, 2) SELECT activity_id, {r6('avg(m) AS mean_of_means')}, count(*) AS n_slots FROM b GROUP BY 1")
def hr_tenmin_mean(spark, sf_dir):
    return sessions.ten_minute_means(t.samples(spark, sf_dir))


@query(f"WITH {A}, {S} SELECT activity_id, {r6('avg_hr')} FROM a WHERE avg_hr IS NOT NULL AND activity_id NOT IN (SELECT activity_id FROM s WHERE heart_rate > 0)")
def repair_candidates(spark, sf_dir):
    return sessions.repair_candidates(_a(spark, sf_dir), t.samples(spark, sf_dir)).select("activity_id", "avg_hr")


@query(f"""WITH {ZH}, m AS (SELECT athlete_id, strftime(date, '%Y-%m') AS year_month, {SHARES}, count(*) AS n_activities, {MINUTES},
sum(z1) / sum(z1 + z2 + z3) AS p1, sum(z2) / sum(z1 + z2 + z3) AS p2, sum(z3) / sum(z1 + z2 + z3) AS p3 FROM zh GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN p3 = 0 THEN 0 WHEN p2 = 0 AND p3 < 0.01 THEN 0 WHEN p2 = 0 THEN p1 / 0.01 * (p3 - 0.01) * 100 ELSE p1 / p2 * p3 * 100 END AS raw FROM m)
SELECT athlete_id, year_month, z1_pct, z2_pct, z3_pct, n_activities, total_min, {r6('CASE WHEN raw > 0 THEN log10(raw) ELSE 0 END AS pi')}, p2 = 0 OR p3 = 0 AS has_zero_zone, CAST(year_month || '-01' AS DATE) AS date FROM q {_last(12, 'year_month DESC')}""")
def report_hr_zones(spark, sf_dir):
    return reports.hr_zones(sessions.hybrid_zones(_a(spark, sf_dir), t.samples(spark, sf_dir)))


@query(f"""WITH {A}, l AS (SELECT athlete_id, session_start AS tm, strftime(session_start, '%Y-%m') AS ym, distance_m / 1000 AS km, avg_pace_min_km AS pace, avg_hr AS hr FROM r QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY session_start DESC, activity_id DESC) = 1),
m AS (SELECT l.athlete_id, count(*) FILTER (session_start < tm) AS n, avg(avg_pace_min_km) FILTER (session_start < tm) AS avg_pace, avg(distance_m / 1000) FILTER (session_start < tm) AS avg_km, sum(distance_m) / 1000 AS month_km FROM l JOIN r ON r.athlete_id = l.athlete_id AND strftime(session_start, '%Y-%m') = ym GROUP BY 1)
SELECT athlete_id, CASE WHEN n >= 2 AND (pace - avg_pace) * 60 < -5 THEN 'faster' WHEN n >= 2 AND km > avg_km * 1.1 THEN 'longer' ELSE 'total' END AS kind, n, {r6('km', 'pace', 'hr', 'avg_pace', 'avg_km', 'month_km')} FROM l JOIN m USING (athlete_id)""")
def report_insight(spark, sf_dir):
    return insight.run_insight(_a(spark, sf_dir)).drop("session_start", "text")


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n_events, round(sum(value), 6) AS load FROM events GROUP BY 1, 2")
def stream_daily_load(spark, sf_dir):
    return ingest.daily_load(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n_events, round(sum(value), 6) AS load FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    s = ingest.sessions(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events", "load")


@query(f"WITH {A} SELECT athlete_id, date_trunc('week', date)::DATE AS week, {r6('max(distance_m) / 1000 AS km_longest')} FROM r GROUP BY 1, 2")
def longest_by_week(spark, sf_dir):
    return metrics.runs(_a(spark, sf_dir)).groupBy("athlete_id", monday_week(F.col("date")).alias("week")).agg((F.max("distance_m") / 1000).alias("km_longest"))


@query(f"""WITH {EF}, e AS (SELECT athlete_id, min(date) AS lo, max(date) AS hi FROM o GROUP BY 1), w AS (SELECT athlete_id, date_trunc('week', date)::DATE AS week, sum(distance_m) / 1000 AS km FROM r GROUP BY 1, 2)
SELECT athlete_id, week, {r6('km')} FROM w JOIN e USING (athlete_id) WHERE week BETWEEN lo AND hi""")
def ef_panel(spark, sf_dir):
    return reports.series_panel(metrics.efficiency(_a(spark, sf_dir)), _a(spark, sf_dir))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'lopning_i_malmo_' WHEN 1 THEN 'cafe_run-' ELSE 'x_' END || event_type || '.json' AS file FROM events")
def workout_file_name(spark, sf_dir):
    k = F.col("event_id") % 3
    title = F.when(k == 0, "Löpning i Malmö / ").when(k == 1, "Café Run-").otherwise("X???")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", expr.ascii_name(F.concat(title, F.upper("event_type"), F.lit(".json"))).alias("file"))


def _panel_sql(ctes: str, series: str) -> str:
    return f"""WITH {ctes}, e AS (SELECT athlete_id, min(date) AS lo, max(date) AS hi FROM {series} GROUP BY 1), w AS (SELECT athlete_id, date_trunc('week', date)::DATE AS week, sum(distance_m) / 1000 AS km FROM r GROUP BY 1, 2)
    SELECT athlete_id, week, {r6('km')} FROM w JOIN e USING (athlete_id) WHERE week BETWEEN lo AND hi"""


@query(_panel_sql(HRE, "o"))
def hre_panel(spark, sf_dir):
    return reports.series_panel(metrics.heart_rate_efficiency(_a(spark, sf_dir)), _a(spark, sf_dir))


@query(_panel_sql(REC, "o"))
def recovery_panel(spark, sf_dir):
    return reports.series_panel(metrics.recovery(_a(spark, sf_dir)), _a(spark, sf_dir))


@query(_panel_sql(DC_SERIES, "pr"))
def decoupling_panel(spark, sf_dir):
    return reports.series_panel(sessions.decoupling_series(_a(spark, sf_dir), t.samples(spark, sf_dir), smooth_s=SMOOTH), _a(spark, sf_dir))


@query(f"WITH {MONO} SELECT * FROM o WHERE date >= DATE '2001-08-01' - 365")
def monotony_panel(spark, sf_dir):
    return reports.year_of(metrics.monotony(_a(spark, sf_dir), AS_OF), AS_OF)


@query(f"WITH RECURSIVE {PMC} SELECT athlete_id, date, {PMC_OUT} FROM pmc WHERE date >= DATE '2001-08-01' - 365")
def pmc_panel(spark, sf_dir):
    return reports.year_of(_pmc(spark, sf_dir), AS_OF)


@query(f"""WITH {H}, {A}, v AS (SELECT athlete_id, date, 20 + value / 4 AS value, 'health' AS origin FROM h WHERE metric = 'heart_rate_variability' QUALIFY row_number() OVER (PARTITION BY athlete_id, date ORDER BY seq) = 1
UNION ALL SELECT athlete_id, date, avg_hr / 3, 'device' FROM r WHERE avg_hr > 0)
SELECT athlete_id, date, {r6('value')}, origin FROM v QUALIFY row_number() OVER (PARTITION BY athlete_id, date ORDER BY origin DESC, value DESC) = 1""")
def vo2max_union(spark, sf_dir):
    daily = ts.keep_first(t.health(spark, sf_dir).where("metric = 'heart_rate_variability'"), ["athlete_id", "date"], ["seq"])
    daily = daily.select("athlete_id", "date", F.lit("vo2_max").alias("metric"), (20 + F.col("value") / 4).alias("value"))
    return metrics.vo2max(daily, _a(spark, sf_dir).withColumn("vo2_max", F.col("avg_hr") / 3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["readiness"](spark, sf_dir)
