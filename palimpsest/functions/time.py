"""Time functions; the clock is always a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def iso_time(text: Column) -> Column:
    """The stripped text where it looks like an ISO 8601 date or time, else null."""
    bare = F.trim(text)
    return F.when(bare.rlike(ISO_TIME), bare)


def event_time(text: Column) -> Column:
    """A timestamp from ISO text, in UTC where it names no zone; null if it is none."""
    return F.try_to_timestamp(iso_time(text))


def age_days(at: Column, now: str) -> Column:
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / 86_400_000_000)


def decay(at: Column, now: str, half_life_days: float = 30.0) -> Column:
    """What a score is multiplied by at its age; 1 without an age or with no usable half-life."""
    if not math.isfinite(half_life_days) or half_life_days <= 0:
        return F.lit(1.0)
    return F.when(at.isNull(), F.lit(1.0)).otherwise(F.exp(F.lit(-math.log(2) / half_life_days) * age_days(at, now)))


def before(at: Column, now: str, **age: float) -> Column:
    """Whether at is more than the age (days=, hours=, fractions too) before now."""
    seconds = age.get("days", 0) * 86400 + age.get("hours", 0) * 3600
    return F.unix_micros(at.cast("timestamp")) < F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(int(seconds * 1_000_000))


def iso_text(at: Column) -> Column:
    """A timestamp as ISO 8601 text in the session's zone, with microseconds where it has some."""
    at = at.cast("timestamp")
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.date_format(at, "xxx"))
