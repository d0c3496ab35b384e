"""Column expressions for pace, scores, zones and labels; all stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (input, score) corners of the readiness scores.
HRV_POINTS = ((-2.0, 0.0), (-1.0, 50.0), (0.0, 75.0), (1.0, 100.0))
SLEEP_POINTS = ((4.0, 0.0), (6.0, 50.0), (7.0, 75.0), (8.0, 100.0))
RHR_POINTS = ((-3.0, 100.0), (0.0, 80.0), (3.0, 50.0), (5.0, 25.0), (8.0, 0.0))
LOAD_POINTS = ((0.0, 90.0), (1.0, 70.0), (2.0, 40.0), (3.0, 10.0))
WRIST_POINTS = ((-0.5, 100.0), (0.0, 90.0), (0.3, 70.0), (0.5, 40.0), (1.0, 0.0))
#: Weights of the readiness components, with and without wrist temperature.
WEIGHTS_WRIST = {"hrv": 0.30, "sleep": 0.25, "rhr": 0.20, "trimp": 0.15, "wrist_temp": 0.10}
WEIGHTS = {"hrv": 0.35, "sleep": 0.30, "rhr": 0.20, "trimp": 0.15}


def is_running(sport: str = "sport") -> Column:
    """Any sport with "running" in its name; a null sport isn't one."""
    return F.coalesce(F.col(sport).contains("running"), F.lit(False))


def pace_mmss(minutes: Column, compat: bool = False) -> Column:
    """Minutes as M:SS, cut to whole seconds; compat drops full hours."""
    seconds = F.floor(F.round(minutes * 60, 6)).cast("long")
    whole = F.floor(seconds / 60).cast("long")
    return F.concat((whole % 60 if compat else whole).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between the points and level beyond them; null stays null."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x < x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x >= points[-1][0], F.lit(points[-1][1]))


def score_hrv(z: Column) -> Column:
    return piecewise(z, HRV_POINTS)


def score_sleep(total: Column, deep: Column, rem: Column) -> Column:
    """Hours scored, and 10 more or less where at least 35 % or under 20 % of them are deep or REM sleep."""
    ratio = F.when(total > 0, (deep + rem) / total)
    bonus = F.when(ratio >= 0.35, 10.0).when(ratio < 0.20, -10.0).otherwise(0.0)
    score = piecewise(total, SLEEP_POINTS)
    return F.when(score.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), score + bonus)))


def score_rhr(deviation: Column) -> Column:
    return piecewise(deviation, RHR_POINTS)


def score_load(ratio: Column) -> Column:
    return piecewise(ratio, LOAD_POINTS)


def score_wrist(deviation: Column) -> Column:
    return piecewise(deviation, WRIST_POINTS)


def n_components(scores: Mapping[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores.values()])


def weighted_composite(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Mean of the scores that are there, by their weights; null if none is."""
    parts = [F.coalesce(scores[k] * w, F.lit(0.0)) for k, w in weights.items()]
    used = [F.when(scores[k].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    return F.try_divide(add(parts), F.nullif(add(used), F.lit(0.0)))


def acwr_zone(acwr: Column) -> Column:
    return F.when(acwr < 0.8, "under").when(acwr <= 1.3, "optimal").when(acwr <= 1.5, "caution").when(acwr.isNotNull(), "high")


def tsb_zone(tsb: Column) -> Column:
    return F.when(tsb > 15, "rested").when(tsb > 5, "fresh").when(tsb > -10, "neutral").when(tsb > -20, "tired").when(tsb.isNotNull(), "overreached")


def readiness_status(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "yellow").when(score.isNotNull(), "red")


def data_quality(n: Column, most: int) -> Column:
    return F.when(n == most, "full").when(n >= 2, "partial").when(n == 1, "minimal")


def trimp(minutes: Column, hr: Column, hr_rest: Column, hr_max: Column) -> Column:
    """Training impulse: minutes weighted by the exponential of the heart rate reserve, which is held to 0..1."""
    reserve = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(hr - hr_rest, hr_max - hr_rest)))
    return minutes * reserve * 0.64 * F.exp(reserve * 1.92)


def stride(speed: Column, cadence: Column) -> Column:
    return F.try_divide(speed * 60, cadence * 2)


def patched(moving: Column, overall: Column, zero: bool) -> Column:
    """The moving value, or the overall one where it is 0 (zero) or null (otherwise)."""
    return F.when(moving == 0, overall).otherwise(moving) if zero else F.coalesce(moving, overall)


def distance_band(km: Column) -> Column:
    """Bands up to 7, 12, 22, 32 and 43 km."""
    return F.when(km < 7, "<7").when(km < 12, "7-12").when(km < 22, "12-22").when(km < 32, "22-32").when(km < 43, "32-43").when(km.isNotNull(), ">43")


def hour_fraction(text: Column, zone: str = "Europe/Stockholm") -> Column:
    """Hours since midnight in a time zone of "yyyy-MM-dd HH:mm:ss Z"; null if it can't be read."""
    local = F.from_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")), zone)
    return F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600


def plain_spaces(text: Column) -> Column:
    """No-break spaces as spaces."""
    return F.translate(text, "\u00a0", " ")


def polarization(z1: Column, z2: Column, z3: Column) -> Column:
    """Index of a zone split in percent: 0 without high intensity; with next to no threshold work the zone shares alone decide."""
    p1, p2, p3 = z1 / 100, z2 / 100, z3 / 100
    without = F.log10(F.nullif(F.try_divide(p1, F.lit(0.01)) * (p3 - 0.01) * 100, F.lit(0.0)))
    ratio = F.try_divide(p1, p2) * p3 * 100
    out = F.when(p3 == 0, F.lit(0.0)).when((p2 == 0) & (p3 < 0.01), F.lit(0.0)).when(p2 == 0, without)
    return F.coalesce(out.when(ratio > 0, F.log10(F.when(ratio > 0, ratio))).otherwise(0.0), F.lit(0.0))


def ascii_name(text: Column) -> Column:
    """A file name of ASCII letters, digits, dots and hyphens: accents are dropped, other runs of characters become one underscore."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_replace(folded, "[^a-z0-9.-]+", "_")


def workout_file(name: Column, start: Column) -> Column:
    """The file of a workout: its name in ASCII, spaces and slashes as underscores, and the digits of its start (text).

    Accents are dropped as far as a letter decomposes into one ASCII letter and marks; other characters beyond ASCII are left out.
    """
    plain = {c: n[0] for c in map(chr, range(0xC0, 0x250)) if len(n := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
    folded = F.translate(name, "".join(plain) + "/ \u00a0", "".join(plain.values()) + "___")
    time = F.translate(F.substring(start, 1, 19), " -:", "_")
    return F.concat(F.regexp_replace(folded, r"[^\x00-\x7F]", ""), F.lit("-"), time, F.lit(".json"))
