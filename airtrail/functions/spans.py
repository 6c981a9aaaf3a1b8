"""Request spans: ends, durations, overlap, and the class of a pair of requests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHORTEST = 0.1  # seconds a span lasts when its end is unknown

# Class numbers of a pair of requests.
CONJUNCT, PARALLEL, RELAYED, SERIAL, UNCLASSIFIED = 1, 2, 3, 4, 9


def request_end(start: Column, duration: Column) -> Column:
    """End of sending a request; null when a part is missing."""
    return start + duration


def response_end(start: Column, duration: Column) -> Column:
    """End of receiving a response; null when a part is missing."""
    return start + duration


def entry_duration(request_start: Column, request_stop: Column, response_stop: Column) -> Column:
    """Response end (request end when that is missing or zero) minus request start."""
    stop = F.when(response_stop.isNotNull() & (response_stop != 0), response_stop).otherwise(request_stop)
    return stop - request_start


def _end(start: Column, end: Column) -> Column:
    return F.coalesce(end, start + F.lit(SHORTEST))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds two spans share; zero or negative is the silence between them."""
    both = s1.isNotNull() & s2.isNotNull()
    return F.when(both, F.least(_end(s1, e1), _end(s2, e2)) - F.greatest(s1, s2))


def head_diff(s1: Column, s2: Column) -> Column:
    """Distance of two starts."""
    return F.abs(s1 - s2)


def tail_diff(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Distance of two ends."""
    both = s1.isNotNull() & s2.isNotNull()
    return F.when(both, F.abs(_end(s1, e1) - _end(s2, e2)))


def classify_pair(a: Column, b: Column) -> Column:
    """Class of request ``b`` against ``a``; both are structs (start, end, duration, domain).

    Conjunct: starts within 0.5 s, ends within a tenth of the shorter duration, same registered domain.
    Then parallel (they overlap), relayed (silence under 1 s), serial (silence under 10 s).
    """
    shared = overlap(a["start"], a["end"], b["start"], b["end"])
    lasts = [F.when(x["duration"].isNotNull() & (x["duration"] != 0), x["duration"]).otherwise(F.lit(SHORTEST)) for x in (a, b)]
    together = (
        (head_diff(a["start"], b["start"]) <= 0.5)
        & (F.try_divide(tail_diff(a["start"], a["end"], b["start"], b["end"]), F.least(*lasts)) < 0.1)
        & a["domain"].eqNullSafe(b["domain"])
    )
    quiet = F.abs(shared)
    return (
        F.when(together, F.lit(CONJUNCT))
        .when(shared > 0, F.lit(PARALLEL))
        .when((shared <= 0) & (quiet < 1), F.lit(RELAYED))
        .when((shared <= 0) & (quiet < 10), F.lit(SERIAL))
        .otherwise(F.lit(UNCLASSIFIED))
    )
