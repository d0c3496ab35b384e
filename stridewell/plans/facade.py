"""The tool surface: one method a question, by the names that tools are called by; answers are lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.functions.dates import build_date_range, parse_date_expr, within
from stridewell.operators import health as h
from stridewell.operators import metrics, sessions
from stridewell.operators import timeseries as ts
from stridewell.plans import reports
from stridewell.plans.readiness import readiness

#: Other names of health measures.
ALIASES = {
    "weight": "weight_body_mass", "body_weight": "weight_body_mass", "body_mass": "weight_body_mass", "mass": "weight_body_mass", "vikt": "weight_body_mass", "kroppsvikt": "weight_body_mass",
    "bmi": "body_mass_index",
    "body_fat": "body_fat_percentage", "fat": "body_fat_percentage", "fettprocent": "body_fat_percentage", "fett": "body_fat_percentage",
    "hr": "heart_rate", "heart": "heart_rate", "puls": "heart_rate", "hjärtfrekvens": "heart_rate",
    "hrv": "heart_rate_variability",
    "rhr": "resting_heart_rate", "resting_hr": "resting_heart_rate", "vilopuls": "resting_heart_rate",
    "vo2": "vo2_max", "vo2max": "vo2_max", "kondition": "vo2_max",
    "steps": "step_count", "steg": "step_count",
    "spo2": "blood_oxygen_saturation", "oxygen": "blood_oxygen_saturation", "syre": "blood_oxygen_saturation", "syremättnad": "blood_oxygen_saturation",
    "breathing": "respiratory_rate", "andning": "respiratory_rate", "andningsfrekvens": "respiratory_rate",
    "wrist_temp": "apple_sleeping_wrist_temperature", "wrist_temperature": "apple_sleeping_wrist_temperature", "sleep_temp": "apple_sleeping_wrist_temperature", "sleep_temperature": "apple_sleeping_wrist_temperature", "sovtemperatur": "apple_sleeping_wrist_temperature",
    "calories": "active_energy", "kalorier": "active_energy", "energy": "active_energy", "energi": "active_energy",
    "exercise": "apple_exercise_time", "exercise_time": "apple_exercise_time", "träning": "apple_exercise_time", "träningstid": "apple_exercise_time",
    "stand": "apple_stand_hour", "flights": "flights_climbed", "trappor": "flights_climbed",
    "distance": "walking_running_distance", "distans": "walking_running_distance", "cycling": "cycling_distance", "cykling": "cycling_distance", "swimming": "swimming_distance", "simning": "swimming_distance",
    "walking": "walking_speed", "gånghastighet": "walking_speed", "asymmetry": "walking_asymmetry_percentage",
    "ground_contact": "running_ground_contact_time", "gct": "running_ground_contact_time", "power": "running_power", "stride": "running_stride_length", "oscillation": "running_vertical_oscillation",
    "noise": "environmental_audio_exposure", "buller": "environmental_audio_exposure", "daylight": "time_in_daylight", "dagsljus": "time_in_daylight",
    "temp": "body_temperature", "temperatur": "body_temperature",
    "lean_mass": "lean_body_mass", "muskelmassa": "lean_body_mass",
    "recovery": "cardio_recovery", "recovery_hr": "cardio_recovery", "återhämtning": "cardio_recovery",
}

#: Groups of health measures.
GROUPS = {
    "Body": ("weight_body_mass", "body_mass_index", "body_fat_percentage", "lean_body_mass", "height", "body_temperature"),
    "Heart": ("heart_rate", "heart_rate_variability", "resting_heart_rate", "walking_heart_rate_average", "cardio_recovery"),
    "Respiratory": ("respiratory_rate", "blood_oxygen_saturation"),
    "Fitness": ("vo2_max", "six_minute_walking_test_distance"),
    "Activity": ("active_energy", "basal_energy_burned", "step_count", "walking_running_distance", "flights_climbed", "apple_exercise_time", "apple_stand_hour", "apple_stand_time", "cycling_distance", "swimming_distance", "swimming_stroke_count", "physical_effort", "mindful_minutes"),
    "Running": ("running_ground_contact_time", "running_power", "running_speed", "running_stride_length", "running_vertical_oscillation"),
    "Sleep": ("apple_sleeping_wrist_temperature",),
    "Walking": ("walking_speed", "walking_step_length", "walking_asymmetry_percentage", "walking_double_support_percentage", "stair_speed_up", "stair_speed_down"),
    "Environment": ("environmental_audio_exposure", "headphone_audio_exposure", "time_in_daylight"),
    "Other": ("handwashing", "number_of_times_fallen", "distance_downhill_snow_sports"),
}

#: What the training measures are and where their levels lie.
METRICS = {
    "readiness": ("Readiness", "Composite of the day's HRV, sleep, resting heart rate, load and wrist temperature scores, 0 to 100.", {"green": "70 or more", "yellow": "40 to 70", "red": "under 40"}),
    "pmc": ("Fitness, fatigue and form", "Weighted means of daily TRIMP over 42 (CTL) and 7 days (ATL); form (TSB) is CTL less ATL.", {"rested": "TSB over 15", "fresh": "5 to 15", "neutral": "-10 to 5", "tired": "-20 to -10", "overreached": "-20 or less"}),
    "acwr": ("Acute to chronic workload ratio", "Distance of 7 days against the weekly mean of 28.", {"under": "below 0.8", "optimal": "0.8 to 1.3", "caution": "1.3 to 1.5", "high": "over 1.5"}),
    "ef": ("Efficiency factor", "Metres a minute for each heart beat a minute; more is better.", {}),
    "hre": ("Heart rate efficiency", "Heart beats a kilometre; less is better.", {"fit": "under 700", "fair": "700 to 750", "unfit": "over 800"}),
    "decoupling": ("Aerobic decoupling", "Fall of the speed to heart rate ratio from the first to the second half of a run, in percent.", {"coupled": "under 3", "acceptable": "3 to 5", "drifting": "5 to 8", "uncoupled": "over 8"}),
    "monotony": ("Monotony and strain", "Mean daily distance of 7 days by its deviation; strain is that times the week's distance.", {"low": "under 1.5", "moderate": "1.5 to 2", "high": "over 2"}),
    "zones": ("Heart rate zones", "Time below 80 %, up to 90 % and above 90 % of the highest heart rate, and how polarized the split is.", {"polarized": "index over 2"}),
    "trimp": ("Training impulse", "Minutes weighted by an exponential of the heart rate reserve.", {}),
}


def resolve_metric(name: str, known: list[str]) -> str:
    """A known measure, by its name, another name, or a part that no other one has; else the name itself."""
    key = name.lower().strip()
    if key in known:
        return key
    if key in ALIASES:
        return ALIASES[key]
    parts = [m for m in known if key in m]
    return parts[0] if len(parts) == 1 else key


def explain_metric(name: str) -> dict:
    key = name.lower().strip()
    if key not in METRICS:
        return {"schema_version": 1, "summary": {"status": "error", "message": f"unknown metric {key!r}; known: {', '.join(sorted(METRICS))}"}, "details": [], "_meta": {}}
    title, text, levels = METRICS[key]
    return {"schema_version": 1, "summary": {"status": "ok", "metric": key}, "details": {"name": title, "description": text, "thresholds": levels}, "_meta": {}}


def resource_metrics(known: list[str] = ()) -> str:
    """Training measures, then the known health measures by group; those of no group come last."""
    own = [f"## {title} ({key})\n{text}" for key, (title, text, _) in METRICS.items()]
    grouped = {m for names in GROUPS.values() for m in names}
    parts = {group: [m for m in names if m in known] for group, names in GROUPS.items()} | {"Ungrouped": sorted(set(known) - grouped)}
    listed = [f"### {group}\n" + "\n".join(f"- {m}: {m.replace('apple_', '').replace('_', ' ')}" for m in names) for group, names in parts.items() if names]
    return "\n\n".join([*own, "## Health measures, by get_health_metric", *listed])


def prompt_daily_check() -> str:
    """Steps for a look at today."""
    return "Call get_readiness(n=7), get_sessions(n=5) and get_training_load('acwr', n=7). Say how ready the athlete is and where that is going, what the last session did, and whether today is for rest, an easy run or normal training. Point out a load ratio over 1.3; a readiness under 40 means rest."


def prompt_weekly_review(weeks: int = 1) -> str:
    """Steps for a look at the last weeks."""
    return f"Call get_sessions(after='-{weeks}w'), get_training_load('pmc', after='-{weeks}w'), get_training_load('monotony', after='-{weeks}w'), get_training_load('acwr', after='-{weeks}w') and get_zones(after='-{max(4, 4 * weeks)}w'). Compare distance with the weeks before, look at the split of intensities, at monotony and at how the load changes, and suggest the coming week."


def prompt_fitness_review(months: int = 3) -> str:
    """Steps for a look at fitness over months."""
    return f"Call get_efficiency('ef', after='-{months}m'), get_training_load('pmc', after='-{months}m'), get_zones(after='-{months}m') and get_decoupling(after='-{months}m'). Say whether efficiency and fitness (CTL) rise, hold or fall, whether training is polarized (an index over 2), whether decoupling stays under 5 percent, and what follows."


def resource_thresholds() -> str:
    return "\n\n".join("\n".join([f"## {title}", *[f"- {k}: {v}" for k, v in levels.items()]]) for title, _, levels in METRICS.values() if levels)


@dataclass
class Engine:
    """Answers over an athlete's or many athletes' tables: activities, samples, daily health values and resting heart rates.

    Every method takes after and before as date expressions, both inclusive, and gives the last n rows of each athlete without them.
    """

    activities: DataFrame
    daily: DataFrame
    samples: DataFrame
    resting: DataFrame
    as_of: date
    hr_max: float = 190.0

    def _span(self, after: str | None, before: str | None) -> reports.RANGE:
        start, end = build_date_range(after, before, today=self.as_of)
        return start, None if end is None else end + timedelta(days=1)

    def get_readiness(self, n: int = 14, after: str | None = None, before: str | None = None) -> DataFrame:
        return reports.readiness(readiness(self.daily, self.activities, self.resting, self.as_of, self.hr_max), n, self._span(after, before))

    def get_sleep(self, n: int = 30, after: str | None = None, before: str | None = None) -> DataFrame:
        wide = h.wide(self.daily, ["sleep_totalSleep", "sleep_core", "sleep_deep", "sleep_rem", "sleep_awake"])
        return reports.tail_or_range(wide, n, self._span(after, before))

    def get_hrv(self, n: int = 30, after: str | None = None, before: str | None = None) -> DataFrame:
        """The band is that of all observations; the range is taken last."""
        return reports.tail_or_range(metrics.hrv_band(self.daily), n, self._span(after, before))

    def get_training_load(self, metric: str = "pmc", n: int = 28, after: str | None = None, before: str | None = None) -> DataFrame:
        span = self._span(after, before)
        if metric == "pmc":
            return reports.pmc(self.activities, self.as_of, n, span, hr_max_bpm=self.hr_max, resting=self.resting)
        return {"acwr": reports.acwr, "monotony": reports.monotony}[metric](self.activities, self.as_of, n, span)

    def get_efficiency(self, metric: str = "ef", n: int = 28, after: str | None = None, before: str | None = None) -> DataFrame:
        return {"ef": reports.ef, "hre": reports.hre}[metric](self.activities, n, self._span(after, before))

    def get_zones(self, n: int = 12, after: str | None = None, before: str | None = None) -> DataFrame:
        return reports.hr_zones(sessions.hybrid_zones(self.activities, self.samples, self.hr_max), n, self._span(after, before))

    def get_sessions(self, n: int = 20, after: str | None = None, before: str | None = None) -> DataFrame:
        return reports.runs_month(self.activities, self.as_of, n, self._span(after, before))

    def get_monthly_summary(self, kind: str = "top", n: int = 10, after: str | None = None, before: str | None = None) -> DataFrame:
        span = self._span(after, before)
        if kind == "top":
            return reports.monthtop(self.activities, n, span)
        return {"status": reports.monthstatus, "last": reports.monthlast}[kind](self.activities, self.as_of, n, span)

    def get_yearly_summary(self, kind: str = "status", n: int | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
        return {"status": reports.yearstatus, "top": reports.yearstop}[kind](self.activities, self.as_of, n, self._span(after, before))

    def get_decoupling(self, n: int = 28, after: str | None = None, before: str | None = None, **settings) -> DataFrame:
        return reports.decoupling(sessions.decoupling_series(self.activities, self.samples, **settings), n, self._span(after, before))

    def get_recovery_hr(self, n: int = 28, after: str | None = None, before: str | None = None) -> DataFrame:
        return reports.recovery_hr(self.activities, n, self._span(after, before))

    def get_resting_hr(self, n: int = 30, after: str | None = None, before: str | None = None) -> DataFrame:
        return reports.tail_or_range(self.resting, n, self._span(after, before))

    def get_vo2max(self, n: int = 30, after: str | None = None, before: str | None = None) -> DataFrame:
        """From health values first, then what activities report, where they have it."""
        return reports.tail_or_range(metrics.vo2max(self.daily, self.activities), n, self._span(after, before))

    def get_health_metric(self, metric: str, n: int = 30, after: str | None = None, before: str | None = None, known: list[str] = ()) -> DataFrame:
        return reports.metric(self.daily, resolve_metric(metric, list(known)), n, self._span(after, before))

    def compare_periods(self, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        span = lambda p: (parse_date_expr(p[0], self.as_of), parse_date_expr(p[1], self.as_of) + timedelta(days=1))
        return reports.compare_periods(self.activities, span(first), span(second))

    def weeks(self, days: int = 84) -> DataFrame:
        return metrics.weekly_km(self.activities, self.as_of, days)

    def between(self, after: date | None, before: date | None) -> DataFrame:
        return self.activities.where(within(F.col("session_start"), after, before))
