"""Send windows, activation dates and delays in a campaign's own time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
DAY_MICROS = 86_400_000_000


def local_time(now: Column, timezone: Column) -> Column:
    return F.from_utc_timestamp(now, timezone)


def iso_day(ts: Column) -> Column:
    return F.weekday(ts) + 1


def _minutes(hhmm: Column) -> Column:
    parts = F.split(hhmm, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def send_window(now: Column, timezone: Column, active_days: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(allowed, reason): the local day must be active and start <= local time < end."""
    local = local_time(now, timezone)
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    day_name = F.element_at(names, iso_day(local))
    active = F.array_contains(active_days, iso_day(local))
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= _minutes(start)) & (minute < _minutes(end))
    listed = F.array_join(F.transform(active_days, lambda d: F.element_at(names, d)), ",")
    wrong_day = F.concat(day_name, F.lit(" is not an active day (active: "), listed, F.lit(")"))
    wrong_time = F.concat(
        F.lit("current: "), day_name, F.lit(" "), F.date_format(local, "HH:mm"), F.lit(" "), timezone, F.lit(", window: "), start, F.lit("-"), end
    )
    return active & inside, F.when(~active, wrong_day).when(~inside, wrong_time).otherwise(F.lit(""))


def should_activate(now: Column, timezone: Column, start_at: Column) -> Column:
    today = F.date_format(local_time(now, timezone), "yyyy-MM-dd")
    return F.coalesce(today >= start_at, F.lit(False))


def days_elapsed(ts: Column, days: Column, now: Column) -> Column:
    """Calendar form: at least ``days`` times 24 hours have passed."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(ts) >= days * F.lit(DAY_MICROS), F.lit(False))


def delay_elapsed(ts: Column, days: int, mode: Column, active_days: Column, timezone: Column, now: Column) -> Column:
    """Business form: due at the ``days``-th following day whose local weekday is active; never without active days."""
    calendar = days_elapsed(ts, F.lit(days), now)
    if days == 0:
        due = ts
    else:
        step = lambda i: F.timestamp_add("DAY", i, ts)
        counted = F.filter(
            F.sequence(F.lit(1), F.lit(7 * days)), lambda i: F.array_contains(active_days, iso_day(local_time(step(i), timezone)))
        )
        due = step(F.get(counted, F.lit(days - 1)))
    business = F.coalesce((F.size(active_days) > 0) & (due <= now), F.lit(False))
    return F.when(ts.isNull(), F.lit(False)).when(mode == "business", business).otherwise(calendar)


def days_since(start: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(start)) / F.lit(float(DAY_MICROS)))
