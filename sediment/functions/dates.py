"""Date and time functions on microseconds since 1970 UTC, with modifiers and strftime, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
_UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY}
#: Julian day of 1970-01-01 00:00 UTC (a fixed value).
EPOCH_JULIAN = 2440587.5


def micros_of(x: Column) -> Column:
    """Microseconds of a timestamp column's clock time, whatever the session's time zone."""
    span = x.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (span.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def micros_of_text(x: Column) -> Column:
    """Microseconds of YYYY-MM-DD[ T]HH:MM[:SS[.f]][Z|+-HH:MM], HH:MM[:SS] (on 2000-01-01) or a Julian number; NULL for other texts.
    A time without a zone is UTC."""
    t = F.regexp_replace(F.trim(x), r"^((?:\d{4}-\d{2}-\d{2}[ T])?\d{2}:\d{2})(?=\s*(?:Z|[+-]\d{2}:\d{2})?$)", "$1:00")
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:\d{2})?$")
    clock = t.rlike(r"^\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?$")
    julian = x.rlike(r"^\d+(?:\.\d+)?$")
    zoned = F.when(t.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), F.regexp_replace(t, r"\s+(?=Z|[+-]\d{2}:\d{2}$)", "")).otherwise(F.concat(t, F.lit("Z")))
    return (
        F.when(day, F.unix_micros(F.concat(t, F.lit(" 00:00:00Z")).try_cast("timestamp")))
        .when(iso, F.unix_micros(zoned.try_cast("timestamp")))
        .when(clock, F.unix_micros(F.concat(F.lit("2000-01-01 "), t, F.lit("Z")).try_cast("timestamp")))
        .when(julian, _julian_micros(x.try_cast("double")))
    )


def _julian_micros(x: Column) -> Column:
    return F.round((x - EPOCH_JULIAN) * 86_400_000).cast("bigint") * 1000


def time_value(x: Column, *modifiers: str) -> Column:
    """Microseconds of a time value, text or number, under modifiers. A first modifier unixepoch, julianday or auto says what a number
    is; without one it is a Julian day. auto: below 5373484.5 a Julian day, else seconds since 1970."""
    first = modifiers[0].strip().lower() if modifiers else ""
    if first in ("unixepoch", "julianday", "auto"):
        n = x.try_cast("double")
        seconds = F.round(n * 1_000_000).cast("bigint")
        us = {"unixepoch": seconds, "julianday": _julian_micros(n)}.get(first, F.when((n >= 0) & (n < 5373484.5), _julian_micros(n)).otherwise(F.coalesce(seconds, micros_of_text(x.cast("string")))))
        return modified(us, *modifiers[1:])
    return modified(micros_of_text(x.cast("string")), *modifiers)


def _days(us: Column) -> Column:
    return F.call_function("div", us - F.pmod(us, F.lit(DAY)), F.lit(DAY))


def _civil(us: Column) -> Column:
    return F.date_from_unix_date(_days(us).cast("int"))


def _from_civil(y: Column, m: Column, d: Column, rest: Column) -> Column:
    """Microseconds of a day number d of month m, which may lie outside the month: it rolls forward."""
    y2 = y + F.floor((m - 1) / 12).cast("int")
    m2 = F.pmod(m - 1, F.lit(12)) + 1
    return (F.unix_date(F.make_date(y2.cast("int"), m2.cast("int"), F.lit(1))).cast("bigint") + d - 1) * DAY + rest


def modified(us: Column, *modifiers: str) -> Column:
    """us under the modifiers, from left to right; an unknown one makes it NULL. Months and years roll over at their ends:
    one month after 31 January lies in March."""
    for text in modifiers:
        m = text.strip().lower()
        day, rest = _civil(us), F.pmod(us, F.lit(DAY))
        if m in ("subsec", "subsecond"):
            continue
        if m in ("localtime", "utc"):
            shift = F.from_utc_timestamp if m == "localtime" else F.to_utc_timestamp
            us = F.unix_micros(shift(F.timestamp_micros(us), F.current_timezone()))
            continue
        if m.startswith("start of "):
            what = m[9:]
            if what not in ("day", "month", "year"):
                return F.lit(None).cast("bigint")
            us = us - rest if what == "day" else F.unix_date(F.trunc(day, what)).cast("bigint") * DAY
        elif w := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(w[1])) - (F.dayofweek(day) - 1), F.lit(7))
            us = us + ahead.cast("bigint") * DAY
        elif s := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
            n, unit = float(s[1]), s[2]
            if unit in _UNITS:
                us = us + F.lit(round(n * _UNITS[unit]))
            else:
                whole, part = int(n), n - int(n)
                months = whole * (12 if unit == "year" else 1)
                us = _from_civil(F.year(day), F.month(day) + months, F.dayofmonth(day), rest) + F.lit(round(part * (365 if unit == "year" else 30) * DAY))
        elif s := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}))?)?", m):
            k = -1 if s[1] == "-" else 1
            us = _from_civil(F.year(day), F.month(day) + k * (int(s[2]) * 12 + int(s[3])), F.dayofmonth(day), rest)
            us = us + F.lit(k * (int(s[4]) * DAY + int(s[5] or 0) * _UNITS["hour"] + int(s[6] or 0) * _UNITS["minute"] + int(s[7] or 0) * _UNITS["second"]))
        elif s := re.fullmatch(r"([+-]?)(\d{2}):(\d{2})(?::(\d{2}))?", m):
            k = -1 if s[1] == "-" else 1
            us = us + F.lit(k * (int(s[2]) * _UNITS["hour"] + int(s[3]) * _UNITS["minute"] + int(s[4] or 0) * _UNITS["second"]))
        else:
            return F.lit(None).cast("bigint")
    return us


def date(us: Column, *modifiers: str) -> Column:
    return strftime("%F", us, *modifiers)


def time(us: Column, *modifiers: str) -> Column:
    return strftime("%H:%M:%f" if _fine(modifiers) else "%T", us, *modifiers)


def _fine(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def datetime(us: Column, *modifiers: str) -> Column:
    return strftime("%F %H:%M:%f" if _fine(modifiers) else "%F %T", us, *modifiers)


def julianday(us: Column, *modifiers: str) -> Column:
    return F.call_function("div", modified(us, *modifiers), F.lit(1000)).cast("double") / 86_400_000 + EPOCH_JULIAN


def unixepoch(us: Column, *modifiers: str) -> Column:
    x = modified(us, *modifiers)
    if _fine(modifiers):
        return F.call_function("div", x - F.pmod(x, F.lit(1000)), F.lit(1000)).cast("double") / 1000
    return F.call_function("div", x - F.pmod(x, F.lit(1_000_000)), F.lit(1_000_000))


def strftime(template: str, us: Column, *modifiers: str) -> Column:
    """The public strftime letters; an unknown one makes the result NULL."""
    us = modified(us, *modifiers)
    day, rest = _civil(us), F.pmod(us, F.lit(DAY))
    part = lambda n, of: F.call_function("div", F.pmod(rest, F.lit(of)), F.lit(n))
    pad = lambda x, n, c="0": F.lpad(x.cast("string"), n, c)
    hour, minute, second = part(3_600_000_000, DAY), part(60_000_000, 3_600_000_000), part(1_000_000, 60_000_000)
    hour12 = F.pmod(hour + 11, F.lit(12)) + 1
    year = pad(F.year(day), 4)
    sunday = F.dayofweek(day) - 1
    monday = F.pmod(sunday + 6, F.lit(7))
    doy = F.dayofyear(day)
    iso_year = F.year(F.date_add(day, (3 - monday).cast("int")))
    letters = {
        "d": pad(F.dayofmonth(day), 2), "e": pad(F.dayofmonth(day), 2, " "), "f": F.concat(pad(second, 2), F.lit("."), pad(F.call_function("div", F.pmod(rest, F.lit(1_000_000)), F.lit(1000)), 3)),
        "F": F.concat(year, F.lit("-"), pad(F.month(day), 2), F.lit("-"), pad(F.dayofmonth(day), 2)), "H": pad(hour, 2), "I": pad(hour12, 2), "j": pad(doy, 3), "J": julianday(us).cast("string"),
        "k": pad(hour, 2, " "), "l": pad(hour12, 2, " "), "m": pad(F.month(day), 2), "M": pad(minute, 2), "p": F.when(hour < 12, "AM").otherwise("PM"), "P": F.when(hour < 12, "am").otherwise("pm"),
        "R": F.concat(pad(hour, 2), F.lit(":"), pad(minute, 2)), "s": unixepoch(us).cast("string"), "S": pad(second, 2), "T": F.concat(pad(hour, 2), F.lit(":"), pad(minute, 2), F.lit(":"), pad(second, 2)),
        "u": (monday + 1).cast("string"), "w": sunday.cast("string"), "U": pad(F.call_function("div", doy + 6 - sunday, F.lit(7)), 2), "W": pad(F.call_function("div", doy + 6 - monday, F.lit(7)), 2),
        "V": pad(F.weekofyear(day), 2), "Y": year, "G": pad(iso_year, 4), "g": pad(F.pmod(iso_year, F.lit(100)), 2), "%": F.lit("%"),
    }
    out, at = [], 0
    for m in re.finditer("%(.?)", template):
        if m.start() > at:
            out.append(F.lit(template[at : m.start()]))
        if m[1] not in letters:
            return F.lit(None).cast("string")
        out.append(letters[m[1]])
        at = m.end()
    if at < len(template):
        out.append(F.lit(template[at:]))
    return F.when(us.isNotNull(), F.concat(*out) if out else F.lit(""))


def ns_text(ns: Column) -> Column:
    """Nanoseconds as a date and time with nine digits of the second."""
    us = F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))
    return F.concat(strftime("%F %T", us), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"))


def ns_of_text(x: Column) -> Column:
    """Nanoseconds of a time text with up to nine digits of the second."""
    digits = F.regexp_extract(x, r"\.(\d{1,9})", 1)
    whole = micros_of_text(F.regexp_replace(x, r"\.\d+", ""))
    return whole * 1000 + F.rpad(digits, 9, "0").cast("bigint")


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as 500ms, 30s, 5m, 12h, 7d, 2w, 1y."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w|y)\s*", text.lower())
    if not m:
        raise ValueError(f"not a duration: {text}")
    return round(float(m[1]) * {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9, "y": 365 * 86400 * 10**9}[m[2]])
