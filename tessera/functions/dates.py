"""Date functions: instants are milliseconds since 1970-01-01 as BIGINT."""

from __future__ import annotations

import re

from ..errors import Unsupported
from ..types import E
from . import core

DAY = 86400000
WHEN = r"^\s*(?:(\d{4})-(\d\d)-(\d\d)(?:[ T]+|$))?(?:(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?)?\s*(Z|z|[+-]\d\d:\d\d)?\s*$"
_g = lambda k: f"regexp_extract(s, {core.quoted(WHEN)}, {k})"
_n = lambda k: f"CAST(nullif({_g(k)}, '') AS INT)"

SQL_FUNCTIONS = [
    # days of a month that it lacks run on into the next one
    ("d_days(y INT, m INT, d INT)", "BIGINT", "CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN CAST(unix_date(make_date(y, m, 1)) AS BIGINT) + d - 1 END"),
    ("d_clock(h INT, m INT, s INT, f STRING)", "BIGINT", "CASE WHEN h IS NULL THEN 0L WHEN h <= 24 AND m <= 59 AND coalesce(s, 0) <= 59 THEN h * 3600000L + m * 60000L + coalesce(s, 0) * 1000L + coalesce(CAST(floor(try_cast(nullif(f, '') AS DOUBLE) * 1000D + 0.5D) AS BIGINT), 0L) END"),
    ("d_zone(z STRING)", "BIGINT", "CASE WHEN z IN ('', 'Z', 'z') THEN 0L WHEN CAST(substr(z, 2, 2) AS INT) <= 14 AND CAST(substr(z, 5, 2) AS INT) <= 59 THEN if(substr(z, 1, 1) = '-', -1L, 1L) * (CAST(substr(z, 2, 2) AS BIGINT) * 3600000L + CAST(substr(z, 5, 2) AS BIGINT) * 60000L) END"),
    ("d_jd(x DOUBLE)", "BIGINT", "CASE WHEN x >= 0D AND x < 5373484.5D THEN CAST(floor((x - 2440587.5D) * 86400000D + 0.5D) AS BIGINT) END"),
    ("d_epoch(x DOUBLE)", "BIGINT", "CASE WHEN x >= -210866760000D AND x <= 253402300799D THEN CAST(floor(x * 1000D + 0.5D) AS BIGINT) END"),
    ("d_when(s STRING)", "BIGINT",
     f"CASE WHEN s RLIKE {core.quoted(WHEN)} AND ({_g(1)} <> '' OR {_g(4)} <> '') THEN d_days(coalesce({_n(1)}, 2000), coalesce({_n(2)}, 1), coalesce({_n(3)}, 1)) * {DAY}L + d_clock({_n(4)}, {_n(5)}, {_n(6)}, {_g(7)}) - d_zone({_g(8)}) "
     f"WHEN s RLIKE {core.quoted(core.WHOLE)} THEN d_jd(d_strict(s)) END"),
    ("d_ts(t BIGINT)", "TIMESTAMP_NTZ", "CAST(timestamp_millis(t) AS TIMESTAMP_NTZ)"),
    ("d_day0(t BIGINT)", "BIGINT", f"t - pmod(t, {DAY}L)"),
    # months run on as well: day 31 of a month of 30 days is the next day 1
    ("d_addmonths(t BIGINT, n INT)", "BIGINT", f"CAST(unix_date(add_months(trunc(CAST(d_ts(t) AS DATE), 'MM'), n)) AS BIGINT) * {DAY}L + (dayofmonth(d_ts(t)) - 1L) * {DAY}L + pmod(t, {DAY}L)"),
    ("d_weekday(t BIGINT, n INT)", "BIGINT", f"t + pmod(n - (dayofweek(d_ts(t)) - 1), 7) * {DAY}L"),
    ("d_range(t BIGINT)", "BIGINT", "CASE WHEN t BETWEEN -62167219200000L AND 253402300799999L THEN t END"),
]


def instant(e: E, modifiers: list[E]) -> tuple[str, bool]:
    """The instant of a time value after its modifiers, and whether
    sub-seconds are to be shown."""
    mods = []
    for m in modifiers:
        if not (m.literal and isinstance(m.value, str)):
            if m.cls == "null":
                return "CAST(NULL AS BIGINT)", False
            raise Unsupported("a date modifier has to be a literal")
        mods.append(m.value.strip().lower())
    e = core.value(e)
    kind = mods.pop(0) if mods and mods[0] in ("unixepoch", "julianday", "auto") else None
    if e.cls == "ts":
        t = f"unix_millis(CAST({e.sql} AS TIMESTAMP))"
    elif e.cls == "null":
        return "CAST(NULL AS BIGINT)", False
    else:
        x = core.strict(e)
        if kind == "unixepoch":
            t = f"d_epoch({x})"
        elif kind == "auto":
            t = f"CASE WHEN {x} >= 0D AND {x} < 5373484.5D THEN d_jd({x}) ELSE d_epoch({x}) END"
            if e.cls == "text":
                t = f"coalesce(CASE WHEN {x} IS NOT NULL THEN {t} END, d_when({e.sql}))"
        elif e.cls in ("int", "real") or kind == "julianday":
            t = f"d_jd({x})"
        else:
            t = f"d_when({core.text(e)})"
    sub = False
    for m in mods:
        if m in ("subsec", "subsecond"):
            sub = True
        elif m in ("floor", "ceiling"):
            pass
        elif m == "start of day":
            t = f"d_day0({t})"
        elif m in ("start of month", "start of year"):
            t = f"CAST(unix_date(trunc(CAST(d_ts({t}) AS DATE), '{'MM' if m.endswith('month') else 'YYYY'}')) AS BIGINT) * {DAY}L"
        elif w := re.fullmatch(r"weekday\s+([0-6])(\.0*)?", m):
            t = f"d_weekday({t}, {w[1]})"
        elif d := re.fullmatch(r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s+(second|minute|hour|day|month|year)s?", m):
            t = shifted(t, float(d[1]), d[2])
        elif c := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?", m):
            ms = (int(c[2]) * 3600 + int(c[3]) * 60 + int(c[4] or 0)) * 1000 + round(float(c[5] or 0) * 1000)
            t = f"({t} {c[1]} {ms}L)"
        else:
            return "CAST(NULL AS BIGINT)", sub
    return f"d_range({t})", sub


def shifted(t: str, n: float, unit: str) -> str:
    size = {"second": 1000, "minute": 60000, "hour": 3600000, "day": DAY}.get(unit)
    if size:
        return f"({t} + {round(n * size)}L)"
    whole = int(n)
    rest = round((n - whole) * (30 if unit == "month" else 365) * DAY)
    t = f"d_addmonths({t}, {whole * (12 if unit == 'year' else 1)})"
    return f"({t} + {rest}L)" if rest else t


def formatted(t: str, fmt: str) -> str | None:
    """The text of an instant by a constant format; None for an unknown letter."""
    d = f"d_ts({t})"
    ms = f"pmod({t}, 1000L)"
    doy, dow = f"dayofyear({d})", f"(dayofweek({d}) - 1)"
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    hour12 = f"(pmod(hour({d}) + 11, 12) + 1)"
    p = lambda x: f"date_format({d}, '{x}')"
    table = {
        "Y": p("yyyy"), "m": p("MM"), "d": p("dd"), "H": p("HH"), "M": p("mm"), "S": p("ss"), "F": p("yyyy-MM-dd"), "T": p("HH:mm:ss"), "R": p("HH:mm"),
        "e": f"lpad(CAST(dayofmonth({d}) AS STRING), 2, ' ')", "k": f"lpad(CAST(hour({d}) AS STRING), 2, ' ')", "l": f"lpad(CAST({hour12} AS STRING), 2, ' ')",
        "I": two(hour12), "f": f"concat({p('ss')}, '.', lpad(CAST({ms} AS STRING), 3, '0'))", "j": f"lpad(CAST({doy} AS STRING), 3, '0')",
        "w": f"CAST({dow} AS STRING)", "u": f"CAST((pmod({dow} + 6, 7) + 1) AS STRING)",
        "W": two(f"CAST(floor(({doy} + 6 - pmod({dow} + 6, 7)) / 7) AS INT)"), "U": two(f"CAST(floor(({doy} + 6 - {dow}) / 7) AS INT)"),
        "V": two(f"weekofyear({d})"), "G": f"lpad(CAST(extract(YEAROFWEEK FROM {d}) AS STRING), 4, '0')", "g": two(f"pmod(extract(YEAROFWEEK FROM {d}), 100)"),
        "p": f"if(hour({d}) < 12, 'AM', 'PM')", "P": f"if(hour({d}) < 12, 'am', 'pm')", "s": f"CAST(({t} - {ms}) div 1000L AS STRING)",
        "J": f"d_realtext({t} / 86400000D + 2440587.5D)", "%": "'%'",
    }
    out, i, plain = [], 0, ""
    while i < len(fmt):
        if fmt[i] == "%":
            if i + 1 >= len(fmt) or fmt[i + 1] not in table:
                return None
            out += [core.quoted(plain)] * bool(plain) + [table[fmt[i + 1]]]
            plain, i = "", i + 2
        else:
            plain, i = plain + fmt[i], i + 1
    out += [core.quoted(plain)] * bool(plain)
    return f"if({t} IS NULL, NULL, concat({', '.join(out)}))" if out else f"if({t} IS NULL, NULL, '')"
