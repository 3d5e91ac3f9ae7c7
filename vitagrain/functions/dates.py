"""Employment periods, spans and calendar buckets (Spark SQL expression text).

Nothing here reads the clock: the month that "present" stands for is always a
parameter.
"""

from __future__ import annotations

from vitagrain.functions import sqltext as st

# Accepted date spellings.
RANGE_SPLIT = r"(?i)\s*(?:[-–—]|to)\s*"
PRESENT = r"(?i)^(present|current|now|ongoing)$"
NUMERIC_MONTH = r"^(0?[1-9]|1[0-2])/((?:19|20)\d{2})$"
YEAR_ONLY = r"^((?:19|20)\d{2})$"
NAMED_MONTH = (
    r"(?i)^(Jan(?:uary)?|Feb(?:ruary|urary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    r"Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|"
    r"Dec(?:ember)?)[a-z]*\.?\s+((?:19|20)\d{2})$"
)
MONTH_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_WORD = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-zA-Z]*\.?"
_YEAR_SIDE = rf"(?:{_MONTH_WORD}\s+|(?:0?[1-9]|1[0-2])/)?(?:19|20)\d{{2}}"
FULL_RANGE = rf"(?i){_YEAR_SIDE}\s*(?:[-–—]|to)\s*(?:{_YEAR_SIDE}|present|current|now)"
WHOLE_RANGE = rf"(?i)^(?:{FULL_RANGE[4:]})$"


def month(token: str, as_of: str, end: bool) -> str:
    """First day of the month a date token stands for, null when unreadable."""
    def part(pattern: str, group: int) -> str:
        return f"CAST(regexp_extract(d, {st.raw(pattern)}, {group}) AS INT)"

    named = (f"CAST((instr('{MONTH_NAMES}', lower(left(d, 3))) + 2) / 3 AS INT)")
    return st.let("d", st.strip(token, " ."), (
        f"CASE WHEN {st.matches('d', PRESENT)} THEN trunc({as_of}, 'MM') "
        f"WHEN {st.matches('d', NUMERIC_MONTH)} "
        f"THEN make_date({part(NUMERIC_MONTH, 2)}, {part(NUMERIC_MONTH, 1)}, 1) "
        f"WHEN {st.matches('d', NAMED_MONTH)} "
        f"THEN make_date({part(NAMED_MONTH, 2)}, {named}, 1) "
        f"WHEN {st.matches('d', YEAR_ONLY)} "
        f"THEN make_date(CAST(d AS INT), {12 if end else 1}, 1) END"
    ))


def period(dates: str, as_of: str) -> str:
    """struct(starts, ends) of a period text, null when either side fails."""
    sides = st.let(
        "parts", f"split({st.collapse(f'coalesce({dates}, {chr(39)*2})')}, {st.raw(RANGE_SPLIT)}, 2)",
        f"CASE WHEN size(parts) = 2 THEN array({month('parts[0]', as_of, False)}, "
        f"{month('parts[1]', as_of, True)}) END",
    )
    return st.let("m", sides, (
        "CASE WHEN m[0] IS NOT NULL AND m[1] IS NOT NULL THEN "
        "named_struct('starts', least(m[0], m[1]), 'ends', greatest(m[0], m[1])) END"
    ))


def allows(ends: str, introduced: str) -> str:
    """True when a job may mention a technology; unknown ends are allowed."""
    return f"coalesce(trunc({ends}, 'MM') >= trunc({introduced}, 'MM'), true)"


def months_inclusive(starts: str, ends: str) -> str:
    return (f"((year({ends}) - year({starts})) * 12 + month({ends}) - month({starts}) + 1)")


def tenure_phrase(months: str) -> str:
    """``under 1 year``, ``N years`` or ``N+ years``; null for no span."""
    years = f"CAST(floor({months} / 12) AS INT)"
    return (f"CASE WHEN {months} IS NULL THEN NULL WHEN {months} < 12 THEN 'under 1 year' "
            f"WHEN {months} % 12 > 0 THEN concat({years}, '+ years') "
            f"ELSE concat({years}, ' years') END")


def local_time(ts: str, zone: str) -> str:
    return f"from_utc_timestamp({ts}, '{zone}')"


def day_tier(local: str) -> str:
    """Weekday time-of-day target: 20, 50 or 80; null at weekends."""
    minutes = f"(hour({local}) * 60 + minute({local}))"
    return (f"CASE WHEN weekday({local}) >= 5 THEN NULL WHEN {minutes} < 780 THEN 20 "
            f"WHEN {minutes} < 1200 THEN 50 ELSE 80 END")


def day_stamp(ts: str) -> str:
    return f"coalesce(date_format({ts}, 'yyyy-MM-dd'), '')"


def minute_stamp(ts: str) -> str:
    return f"coalesce(date_format({ts}, 'yyyy-MM-dd HH:mm'), '—')"


def iso_z(ts: str) -> str:
    return f"coalesce(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '')"
