"""Schedules and rings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cron_field(field: str, low: int, high: int) -> set[int] | None:
    """The values of one field: lists of numbers, ranges and steps; None for any. Raises ValueError for what doesn't fit."""
    if field == "*":
        return None
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, dash, last = (low, "-", high) if span == "*" else span.partition("-")
        begin, every = int(first), int(step or 1)
        end = int(last) if dash else (high if step else begin)
        if every < 1 or not low <= begin <= end <= high:
            raise ValueError(f"no such part of a schedule: {part}")
        out |= set(range(begin, end + 1, every))
    return out


def cron(expression: str, moment: Column) -> Column:
    """Whether ``minute hour day month weekday`` fits; 0 and 7 are Sunday. If both days are named, either is enough."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minute, hour, day, month, week = (cron_field(f, *b) for f, b in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    within = lambda c, values: F.lit(True) if values is None else c.isin(*sorted(values))
    by_day = within(F.dayofmonth(moment), day)
    by_week = within(F.dayofweek(moment) - 1, None if week is None else {x % 7 for x in week})
    days = by_day | by_week if day is not None and week is not None else by_day & by_week
    return within(F.minute(moment), minute) & within(F.hour(moment), hour) & within(F.month(moment), month) & days


def ring(a: Column, b: Column, size: int = 12) -> Column:
    """The shorter way between two places on a ring."""
    d = F.pmod(a - b, F.lit(size))
    return F.least(d, F.pmod(size - d, F.lit(size)))
