"""Written times: every reading that a text allows (an Arrow function), and the instant of a chosen one (Columns)."""

from __future__ import annotations

import calendar
import re
import zoneinfo
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480,
    "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations of several zones; they stand for the source's own local time.
LOCAL_NAMES = ("CST",)
# Words for the part of the day before an hour.
MORNING, LATE_MORNING, NOON, EVENING, NIGHT = ("凌晨", "清晨", "早上", "早晨"), ("上午",), ("中午", "正午"), ("下午", "傍晚"), ("晚上", "晚間", "深夜", "夜間")
# First year less one of the named eras.
ERAS = {"中華民國": 1911, "民國": 1911, "民国": 1911, "令和": 2018, "平成": 1988, "佛曆": -543, "西元": 0, "公元": 0}
# Digits of a number of seconds, milliseconds, microseconds or nanoseconds since 1970, by unit.
EPOCH_UNITS = {"epoch_s": 10**6, "epoch_ms": 10**3, "epoch_us": 1, "epoch_ns": 0}

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
_MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name} | {"sept": 9}
_KNOWN = zoneinfo.available_timezones()
_SPACE = re.compile(r"[\s﻿​]+")
_NUMERIC = re.compile(r"(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})(?:$|[T ] ?)")
_COMPACT = re.compile(r"(\d{2,4})(\d{2})(\d{2})(?:$|[T ] ?(?=\d))")
_WEEK = re.compile(r"(\d{4})-?W(\d{2})-?([1-7])(?:$|[T ] ?)")
_ORDINAL = re.compile(r"(\d{4})-(\d{3})(?:$|[T ] ?)")
_CJK = re.compile(rf"({'|'.join(ERAS)})? ?(\d{{1,4}}|元) ?年 ?(\d{{1,2}}) ?月 ?(\d{{1,2}}) ?[日號号] ?")
_DAY_FIRST = re.compile(r"(?:[A-Za-z]{3,9},? )?(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})(?:$|,? )")
_MONTH_FIRST = re.compile(r"(?:[A-Za-z]{3,9},? )?([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:$|,? )")
_EPOCH = re.compile(r"(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(\d+))?$")
_PARTS = "|".join((*MORNING, *LATE_MORNING, *NOON, *EVENING, *NIGHT))
_ZONE = r"(?P<off>(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d|[A-Za-z]{1,4})? ?(?:\[(?P<zone>[A-Za-z0-9_/+-]+)\])?$"
_CLOCK = re.compile(rf"(?P<part>{_PARTS})? ?(?P<h>\d{{1,2}})(?: ?[:時时點点] ?(?:(?P<m>\d{{1,2}})(?: ?[:分] ?(?P<s>\d{{1,2}})(?:[.,](?P<f>\d+))?)?)?) ?[分秒]? ?(?P<half>[AaPp]\.?[Mm]\.?)? ?" + _ZONE)
_CLOCK_COMPACT = re.compile(r"(?P<h>\d{2})(?P<m>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)? ?" + _ZONE)

#: Orders of all-number dates; formats of these begin with the order's name.
ORDERS = ("ymd", "mdy", "dmy")
READING = pa.struct([("fmt", pa.string()), ("day", pa.date32()), ("epoch", pa.int64())])
PARSED = pa.struct([("said", pa.bool_()), ("readings", pa.list_(READING)), ("micros", pa.int64()), ("shift", pa.int64()), ("zone", pa.string())])
PARSED_DDL = "struct<said:boolean,readings:array<struct<fmt:string,day:date,epoch:bigint>>,micros:bigint,shift:bigint,zone:string>"


def tidy(text: str | None) -> str:
    """Full-width signs to ASCII, white space to single spaces, trimmed; null becomes ''."""
    if text and text.isascii() and "  " not in text and text.isprintable():
        return text.strip()
    return _SPACE.sub(" ", text.translate(_WIDE)).strip() if text else ""


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _years(order: str, year: str, m: str, d: str) -> list[tuple[str, date | None]]:
    """Readings of a year without named era: as it stands or Buddhist, two-digit, Republic of China."""
    y, n = int(year), len(year)
    options = [(order, y), (f"{order}_be", y - 543)] if n == 4 else [(f"{order}_yy", y + 2000)] if n <= 2 else []
    return [(fmt, _day(v, int(m), int(d))) for fmt, v in [*options, (f"{order}_roc", y + 1911)] if v > 0]


def readings(text: str, first: date, last: date) -> tuple[list[tuple[str, date | None, int | None]], str]:
    """All readings ``(format, day, epoch in microseconds)`` of a tidy text within the dates, and what follows the date.

    All-number dates without a four-digit year at the start are read in every order that gives a day (ymd, mdy, dmy);
    joined by dots with the four-digit year last, they put the day first. Which reading holds is for the mixture to say.
    """
    out: list[tuple[str, date | None]] = []
    if m := _NUMERIC.match(text):
        a, sep, b, c = m.groups()
        if len(a) == 4:
            out = _years("iso", a, b, c) if len(c) <= 2 else []
        elif len(c) == 4:
            for o in ["dot"] if sep == "." else ["dmy", "mdy"]:
                out += _years(o, c, *((a, b) if o == "mdy" else (b, a)))
        else:
            for o in ORDERS:
                y, mo, d = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[o]
                out += _years(o, y, mo, d) if len(d) <= 2 and len(mo) <= 2 else []
    elif m := _EPOCH.match(text):
        whole, part = int(m[1]), (m[2] or "")[:6].ljust(6, "0")
        low, high = (calendar.timegm(x.timetuple()) for x in (first, last + timedelta(1)))
        micros = {k: whole * u + int(part) * u // 10**6 if u else whole // 1000 for k, u in EPOCH_UNITS.items()}
        return [(k, None, v) for k, v in micros.items() if low <= v / 10**6 < high], ""
    elif m := _COMPACT.match(text):
        a, b, c = m.groups()
        if len(a) > 2:
            out = _years("iso", a, b, c)
        else:
            for o in ORDERS:
                out += _years(o, *{"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[o])
    elif m := _WEEK.match(text):
        try:
            out = [("week", date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])))]
        except ValueError:
            out = []
    elif m := _ORDINAL.match(text):
        start, n = _day(int(m[1]), 1, 1), int(m[2])
        out = [("ordinal", start + timedelta(n - 1))] if start and 1 <= n <= 365 + calendar.isleap(int(m[1])) else []
    elif m := _CJK.match(text):
        era, y, mo, d = m.groups()
        out = [("era", _day(ERAS[era] + (1 if y == "元" else int(y)), int(mo), int(d)))] if era else _years("cjk", y, mo, d) if y != "元" else []
    elif m := _DAY_FIRST.match(text):
        out = [("english", _day(int(m[3]), _MONTHS.get(m[2].lower(), 0), int(m[1])))]
    elif m := _MONTH_FIRST.match(text):
        out = [("english", _day(int(m[3]), _MONTHS.get(m[1].lower(), 0), int(m[2])))]
    return [(f, d, None) for f, d in out if d and first <= d <= last], text[m.end() :].strip() if m else ""


def clock(text: str) -> tuple[int, int | None, str | None] | None:
    """Time of day as ``(microseconds, offset in minutes, zone)``, None if the text isn't one; '' is the day's first moment.

    24:00 is the day's end; digits below microseconds are cut.
    """
    if not text:
        return 0, None, None
    m = _CLOCK.match(text) or _CLOCK_COMPACT.match(text)
    if not m:
        return None
    g = m.groupdict()
    h, mi, s, f = int(g["h"]), int(g["m"] or 0), int(g["s"] or 0), int((g["f"] or "")[:6].ljust(6, "0"))
    half, part = (g.get("half") or "")[:1].lower(), g.get("part")
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half == "p" else 0)
    elif part in MORNING:
        h = 0 if h == 12 else h
    elif part in NOON:
        h += 12 if h <= 2 else 0
    elif part in EVENING:
        h += 12 if 1 <= h <= 11 else 0
    elif part in NIGHT:
        h = 24 if h == 12 else h + 12 if 4 <= h <= 11 else h
    if mi > 59 or s > 59 or h > 24 or (h == 24 and (mi or s or f)):
        return None
    off, zone = g["off"], g["zone"]
    shift = None
    if off:
        plain = re.sub(r"^(?:UTC|GMT)(?=[+-])", "", off.upper())
        if plain[0] in "+-":
            digits = plain[1:].replace(":", "")
            shift = (int(digits[:2]) * 60 + int(digits[2:] or 0)) * (-1 if plain[0] == "-" else 1)
        elif (shift := ZONE_MINUTES.get(plain)) is None and plain not in LOCAL_NAMES:
            return None
    if zone and zone not in _KNOWN and shift is None:
        return None
    return ((h * 60 + mi) * 60 + s) * 10**6 + f, shift, zone if zone in _KNOWN else None


def parser(first: str, last: str):
    """Arrow UDF ``(date, time) -> PARSED``; ``readings`` is empty where date or time of day can't be read.

    Equal texts of a batch are read once, whether they are dates, times of day or both in one.
    """
    low, high = date.fromisoformat(first), date.fromisoformat(last)

    @F.arrow_udf(PARSED_DDL)
    def parse(dates: pa.Array, times: pa.Array) -> pa.Array:
        d, t = (c.cast(pa.string()).dictionary_encode() for c in (dates, times))
        texts = [[tidy(x) for x in c.dictionary.to_pylist()] + [""] for c in (d, t)]
        at = [np.asarray(c.indices.fill_null(len(x) - 1)) for c, x in zip((d, t), texts)]
        pair, back = np.unique(np.stack(at, 1), axis=0, return_inverse=True)
        dated = [readings(x, low, high) if x else ([], "") for x in texts[0]]
        whole: dict[str, tuple] = {}
        said, found, when = [], [], []
        for i, j in pair.tolist():
            date_text, time_text = texts[0][i], texts[1][j]
            if date_text:
                got, rest = dated[i]
                rest = time_text or rest
            else:
                got, rest = readings(time_text, low, high) if time_text else ([], "")
            if got and rest not in whole:
                whole[rest] = clock(rest)
            clocked = whole[rest] if got else None
            said.append(bool(date_text or time_text))
            found.append(got if clocked else [])
            when.append(clocked or (None, None, None))
        size = np.array([len(x) for x in found], np.int32)
        flat = [r for x in found for r in x]
        each = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], f.type) for k, f in enumerate(READING)], fields=list(READING))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), each)
        columns = [pa.array(said, pa.bool_()), lists, *(pa.array([w[k] for w in when], PARSED[k + 2].type) for k in range(3))]
        return pa.StructArray.from_arrays(columns, fields=list(PARSED)).take(pa.array(back.ravel()))

    return parse


def instant(day: Column, epoch: Column, parsed: Column, zone: Column) -> Column:
    """UTC as TIMESTAMP_NTZ. A local time that occurs twice is the first one; one in a gap is later by the gap.

    Null for a local time without a known zone.
    """
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    nil = F.lit(0)
    micros = lambda x: (x.cast("decimal(20,0)") / F.lit(10**6).cast("decimal(7,0)")).cast("decimal(18,6)")
    local = day.cast("timestamp_ntz") + F.make_dt_interval(nil, nil, nil, micros(parsed["micros"]))
    where = F.coalesce(parsed["zone"], F.when(zone.isin(*sorted(_KNOWN)), zone))
    fixed = local - F.make_dt_interval(nil, nil, parsed["shift"].cast("int"), F.lit(0).cast("decimal(18,6)"))
    placed = F.when(parsed["shift"].isNotNull(), fixed).when(where.isNotNull(), F.convert_timezone(where, F.lit("UTC"), local))
    return F.when(epoch.isNotNull(), zero + F.make_dt_interval(nil, nil, nil, micros(epoch))).otherwise(placed)


def iso(ts: Column | str) -> Column:
    """A TIMESTAMP_NTZ as ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``, whatever the session's zone."""
    text = (F.col(ts) if isinstance(ts, str) else ts).cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"))
