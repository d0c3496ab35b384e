"""Fixed schemas of the engine's tables; optional measures are nullable columns, not missing ones."""

from __future__ import annotations

ACTIVITIES = """athlete_id long, activity_id long, session_start timestamp, sport string, distance_m double, duration_min double,
avg_pace_min_km double, avg_speed_m_s double, avg_hr double, z1_s double, z2_s double, z3_s double, z4_s double, z5_s double,
recovery_hr double, max_hr double"""
SAMPLES = "activity_id long, ts timestamp, speed double, heart_rate double"
HEALTH = "athlete_id long, date date, metric string, value double, source string, seq long"
RESTING_HR = "athlete_id long, date date, rhr double, source string"
DEVICE_SUMMARY = "maxHR double, vO2MaxValue double, hrTimeInZone_1 double, hrTimeInZone_2 double, hrTimeInZone_3 double, hrTimeInZone_4 double, hrTimeInZone_5 double"
DEVICE_DETAILS = "recoveryHeartRate double, directWorkoutRpe double, averageTemperature double, minHR double"
#: A sample of pushed or canonical files: a quantity, the three figures of a heart rate, a night that the device has summed up, or a segment of one.
SAMPLE = """struct<date: string, qty: double, source: string, Min: double, Avg: double, Max: double, totalSleep: double, core: double, deep: double,
rem: double, awake: double, inBed: double, asleep: double, sleepStart: string, sleepEnd: string, inBedStart: string, inBedEnd: string, value: string,
startDate: string, endDate: string, start: string, end: string>""".replace("\n", " ")
METRICS = f"array<struct<name: string, units: string, data: array<{SAMPLE}>>>"
PUSH = f"struct<data: struct<metrics: {METRICS}>, metrics: {METRICS}>"
CANONICAL = f"metric string, date string, units string, samples array<{SAMPLE}>"
SLEEP_SEGMENTS = "athlete_id long, start_ts string, end_ts string, stage string, hours double, source string"
