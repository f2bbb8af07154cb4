"""Cron expressions and minute buckets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and of days (1 is Sunday).
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (1, 7)]
NAMES = [[], [], [], MONTHS, DAYS]


def _number(text: str, at: int) -> int:
    value = NAMES[at].index(text.upper()) + 1 if text.upper() in NAMES[at] else int(text)
    low, high = BOUNDS[at]
    if not low <= value <= high:
        raise ValueError(f"{value} is out of {low}-{high}")
    return value


def _field(text: str, at: int) -> tuple[set[int], list[tuple[str, int, int]]]:
    """Plain values, and the specials: L (last), LW, nW (nearest weekday), nL (last such weekday), n#k (k-th)."""
    plain: set[int] = set()
    special: list[tuple[str, int, int]] = []
    low, high = BOUNDS[at]
    for part in text.split(","):
        upper = part.upper()
        if at == 2 and upper in ("L", "LW"):
            special.append((upper, 0, 0))
        elif at == 2 and upper.endswith("W"):
            special.append(("W", _number(upper[:-1], at), 0))
        elif at == 4 and "#" in upper:
            day, k = upper.split("#")
            if not 1 <= int(k) <= 5:
                raise ValueError(f"no week {k}")
            special.append(("#", _number(day, at), int(k)))
        elif at == 4 and upper.endswith("L") and upper != "L":
            special.append(("LAST", _number(upper[:-1], at), 0))
        elif at == 4 and upper == "L":
            plain.add(7)
        else:
            span, _, step = part.partition("/")
            if span == "*":
                first, last = low, high
            elif "-" in span:
                first, last = (_number(x, at) for x in span.split("-"))
            else:
                first = _number(span, at)
                last = high if step else first
            if first > last or (step and int(step) < 1):
                raise ValueError(f"not a range: {part}")
            plain |= set(range(first, last + 1, int(step or 1)))
    return plain, special


def parse_cron(expression: str) -> list[tuple[set[int], list[tuple[str, int, int]]]]:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    return [_field(text, at) for at, text in enumerate(fields)]


def _on_days(expression: str, month: int, first: int, last: int) -> int:
    """The days of a month on which an expression falls, as bits from the first day on; ``first``: the weekday of the first, 1 for Sunday.

    Day of month and day of week are alternatives where both are restricted;
    only a literal * is no restriction, so */2 is one.
    """
    _, _, dom, months, dow = parse_cron(expression)
    if month not in months[0]:
        return 0
    weekday = lambda d: (first + d - 2) % 7 + 1

    def nearest(d: int) -> int:
        if weekday(d) == 7:
            return d - 1 if d > 1 else d + 2
        if weekday(d) == 1:
            return d + 1 if d < last else d - 2
        return d

    def special(rule: tuple[str, int, int], d: int) -> bool:
        kind, n, k = rule
        if kind == "L":
            return d == last
        if kind == "LW":
            return d == nearest(last)
        if kind == "W":
            return n <= last and d == nearest(n)
        if kind == "LAST":
            return weekday(d) == n and d > last - 7
        return weekday(d) == n and (d + 6) // 7 == k

    by_dom = lambda d: d in dom[0] or any(special(r, d) for r in dom[1])
    by_dow = lambda d: weekday(d) in dow[0] or any(special(r, d) for r in dow[1])
    free = [text == "*" for text in expression.split()]
    either = (lambda d: by_dom(d) and by_dow(d)) if free[2] or free[4] else (lambda d: by_dom(d) or by_dow(d))
    return sum(1 << (d - 1) for d in range(1, last + 1) if either(d))


def _day_bits(expression: str, month_start: Column) -> Column:
    """The days of a month as bits: of months there are only so many shapes, by name, first weekday and leap year."""
    lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    shapes = [_on_days(expression, m, first, lengths[m - 1] + (leap and m == 2)) for m in range(1, 13) for first in range(1, 8) for leap in (False, True)]
    year = F.year(month_start)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    at = (F.month(month_start) - 1) * 14 + (F.dayofweek(month_start) - 1) * 2 + leap.cast("int")
    return F.get(F.lit(shapes), at)


def _minutes(expression: str) -> list[int]:
    minute, hour, *_ = parse_cron(expression)
    return sorted(60 * h + m for h in hour[0] for m in minute[0])


def cron_matches(expression: str, at: Column) -> Column:
    """Whether the minute that holds ``at`` matches."""
    minute, hour, *_ = parse_cron(expression)
    bits = _day_bits(expression, F.to_date(F.trunc(at, "MM")))
    today = F.call_function("shiftright", bits, F.dayofmonth(at) - 1).bitwiseAND(F.lit(1)) == 1
    return F.minute(at).isin(sorted(minute[0])) & F.hour(at).isin(sorted(hour[0])) & today


#: Months of the calendar's whole cycle: what doesn't match within it never does.
CYCLE_MONTHS = 4800


def cron_next(expression: str, at: Column) -> Column:
    """The first matching minute strictly after ``at``; null if none ever matches.

    The rest of the day, then the rest of the month, then month by month: few
    are looked at unless none of them has a matching day.
    """
    times = _minutes(expression)
    day, month = F.to_date(at), F.to_date(F.trunc(at, "MM"))
    now = F.hour(at) * 60 + F.minute(at)
    moment = lambda d, m: d.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), m)
    lowest = lambda bits: F.bit_count(bits.bitwiseAND(-bits) - 1).cast("int")
    here = _day_bits(expression, month)
    later = F.array_min(F.filter(F.lit(times), lambda m: m > now))
    today = F.when(F.call_function("shiftright", here, F.dayofmonth(at) - 1).bitwiseAND(F.lit(1)) == 1, moment(day, later))
    rest = here.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(2), F.dayofmonth(at) - 1) - 1))
    soon = F.when(rest != 0, F.date_add(month, lowest(rest)))

    def within(low: int, high: int) -> Column:
        first = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.add_months(month, k))
        fits = F.filter(F.transform(first, lambda d: F.struct(d.alias("d"), _day_bits(expression, d).alias("b"))), lambda x: x["b"] != 0)
        return F.get(F.transform(F.slice(fits, 1, 1), lambda x: F.date_add(x["d"], lowest(x["b"]))), F.lit(0))

    if not times:
        return F.lit(None).cast("timestamp")
    return F.coalesce(today, moment(F.coalesce(soon, within(1, 2), within(3, 60), within(61, CYCLE_MONTHS)), F.lit(times[0])))


def cron_next_across(expressions: list[str], at: Column) -> Column:
    """The earliest next minute of several expressions."""
    found = [cron_next(x, at) for x in expressions]
    return F.least(*found) if len(found) > 1 else found[0]


def cron_matching(expressions: list[str], at: Column) -> Column:
    """The places, from 0, of the expressions that the minute holding ``at`` matches."""
    return F.filter(F.array(*(F.when(cron_matches(x, at), F.lit(i)) for i, x in enumerate(expressions))), lambda i: i.isNotNull())


def cron_rearm(following: Column, retry: Column) -> Column:
    """When to run again after a failure: the sooner of the next occurrence and the retry, whichever there is."""
    return F.least(following, retry)


def minute_bucket(at: Column) -> Column:
    return F.date_format(F.date_trunc("minute", at), "yyyy-MM-dd'T'HH:mm")


def minute_start(text: Column) -> Column:
    """The start of a minute bucket's text; null where it isn't one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")))
