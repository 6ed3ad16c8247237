"""Timestamps of many written forms and zones as UTC microseconds.

A value is turned into a shape mask (every digit ``0``, every letter ``a``, other characters as they are); that is one look-up over the
bytes of a batch. Each distinct mask is given a parser once per worker: the spans of the fields in all values of that mask. Values of
one mask are then read together, as a matrix of characters. Wall-clock times are converted through a transition table per zone,
built once per worker from the installed edition of the IANA tables (``zone_edition()``). The edition that the driver has is part of
the plan, and may be pinned; a worker that has another one raises, so that one result never mixes editions.

A value gives null if it doesn't denote exactly one instant: no known zone where one is needed, a wall-clock time that the
zone's clocks skip or show twice, no time of day, no valid date or time, or a form in which day and month can't be told
apart. That also holds for a zone named in brackets: at an hour shown twice it names two instants. Beyond the last transition of a
table the zone's closing rule goes on, for all years to 9999. Null and empty texts give null; repeated values give the same result each;
length doesn't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SECOND = 1_000_000
DAY = 86_400 * SECOND

# English names of months and weekdays, zone abbreviations that mean one offset (in minutes).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
#: Digits alone are read as whichever form falls into these years.
NUMBER_YEARS = (2022, 2025)

_MASK = np.array([48 if 48 <= b < 58 else 97 if chr(b).isalpha() and b < 128 else b if b < 128 else 1 for b in range(256)], dtype=np.uint8)
# Characters that stand for others in written times.
_SAME = {"\u2212": "-", "\u2013": "-", "\u00a0": " ", "\u202f": " "}

_YMD = r"(?P<Y>0000)(?P<s>[-/.])(?P<m>00?)(?P=s)(?P<d>00?)"
_DMY = r"(?P<d>00?)\.(?P<m>00?)\.(?P<Y>0000|00)"
_DMONY = r"(?:(?P<wd>a{3,9}),? )?(?P<d>00?)(?P<s>[-/ ])(?P<mon>a{3,9})\.?(?P=s)(?P<Y>0000|00)"
_MONDY = r"(?:(?P<wd>a{3,9}),? )?(?P<mon>a{3,9})\.? (?P<d>00?),? (?P<Y>0000)"
_TIME = r"(?P<H>00?):(?P<M>00)(?::(?P<S>00)(?:[.,](?P<f>0+))?)?"
_NOON = r" ?(?P<ap>aa)"
_ZONE = r"(?: ?(?<!a)(?P<z>a{1,5}))?(?: ?(?P<sign>[-+])(?P<oh>00?)(?::?(?P<om>00))?)?(?: ?\[(?P<id>[^\]\[]+)\])?"
_SHAPES = [
    re.compile(rf"(?:{date})(?:a| |, | a{{2}} ){_TIME}{noon}{_ZONE}")
    for noon in (_NOON, "")
    for date in (_YMD, _DMY, _DMONY, _MONDY)
] + [
    re.compile(rf"(?P<Y>0000)-?(?P<m>00)-?(?P<d>00)(?:a| )(?P<H>00)(?P<M>00)(?:(?P<S>00)(?:[.,](?P<f>0+))?)?{_ZONE}"),
    # As date(1) and ctime write it: Wed Jul 12 01:31:24 UTC 2023
    re.compile(rf"(?P<wd>a{{3,9}}) (?P<mon>a{{3,9}}) +(?P<d>00?) {_TIME}(?: (?P<z>a{{1,5}}))? (?P<Y>0000)"),
]
_DIGITS = re.compile(r"0+(?:\.0+)?")


def zone_edition() -> str:
    """The edition of the zone tables in use, as 2024a; "system" if the system's tables don't tell."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        import zoneinfo
        from pathlib import Path

        for folder in zoneinfo.TZPATH:
            if (about := Path(folder, "tzdata.zi")).is_file():
                with about.open(encoding="utf-8") as f:
                    return f.readline().split()[-1]
        return "system"


def _zone(name: str):
    import importlib.resources
    import zoneinfo

    try:
        try:
            import tzdata  # noqa: F401
        except ImportError:
            return zoneinfo.ZoneInfo(name)
        if not re.fullmatch(r"[A-Za-z0-9_+-]+(/[A-Za-z0-9_+-]+){0,3}", name):
            return None
        *folders, last = name.split("/")
        with importlib.resources.files(".".join(["tzdata", "zoneinfo", *folders])).joinpath(last).open("rb") as f:
            return zoneinfo.ZoneInfo.from_file(f, key=name)
    except (OSError, ValueError, ImportError, KeyError):
        return None


#: Tables have the transitions of these years, from 1 January; ``far`` ones more, the last 400 of which repeat for ever.
YEARS, FAR_YEARS = (1930, 2070), (1800, 2438)
_CYCLE = 146_097 * DAY  # 400 years


@functools.lru_cache(maxsize=2048)
def transitions(name: str, far: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Instants (UTC microseconds) at which the zone's offset changes in YEARS or FAR_YEARS, and the offsets before, between and
    after them; None if there is no such zone."""
    zone = _zone(name)
    if zone is None:
        return None
    start, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (FAR_YEARS if far else YEARS))
    step = 86_400 * 6

    def offset(t: int) -> int:
        at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=t)
        return round(zone.utcoffset(at.astimezone(zone)).total_seconds())

    when, offsets, t, now = [], [offset(start)], start, offset(start)
    while t < end:
        after = offset(t + step)
        if after != now:
            a, b = t, t + step
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == now else (a, mid)
            when.append(b * SECOND)
            now = offset(b)
            offsets.append(now)
            t = b
            continue
        t += step
    return np.array(when, dtype=np.int64), np.array(offsets, dtype=np.int64) * SECOND


def wall_to_utc(local: np.ndarray, name: str | None) -> tuple[np.ndarray, np.ndarray]:
    """UTC of wall-clock microseconds, and where it is exactly one instant."""
    low, high = (_start(y) for y in YEARS)
    far = (local < low + DAY) | (local > high - DAY)
    if not far.any():
        return _by_table(local, transitions(name.strip()) if name else None)
    # The calendar and the closing rules repeat after 400 years.
    shift = np.maximum(0, -((_start(FAR_YEARS[1] - 1) - local) // _CYCLE)) * _CYCLE
    out, good = _by_table(local - shift, transitions(name.strip(), True) if name else None)
    return out + shift, good


def _start(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=UTC).timestamp()) * SECOND


def _by_table(local: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    if table is None:
        return local, np.zeros(len(local), dtype=bool)
    when, offsets = table
    if not len(when):
        return local - offsets[0], np.ones(len(local), dtype=bool)
    low, high = np.minimum(offsets[:-1], offsets[1:]), np.maximum(offsets[:-1], offsets[1:])
    # Clocks between when+low and when+high are skipped or shown twice.
    i = np.searchsorted(when + low, local, side="right")
    before = np.maximum(i - 1, 0)
    odd = (i > 0) & (local < when[before] + high[before])
    return local - offsets[i], ~odd


#: Zones of some values: a number for each, and their names.
Zones = tuple[np.ndarray, list[str | None]]


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    n = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        n = n * 10 + (chars[:, k].astype(np.int64) - 48)
    return n


def _words(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.unique(part.view(f"<U{span[1] - span[0]}").ravel(), return_inverse=True)


def _look_up(chars: np.ndarray, span: tuple[int, int], meaning: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray]:
    words, at = _words(chars, span)
    found = [meaning(str(w)) for w in words]
    return np.array([0 if x is None else x for x in found], dtype=np.int64)[at], np.array([x is not None for x in found])[at]


def _name(names: tuple[str, ...], word: str) -> int | None:
    word = word.lower()
    hits = [k for k, full in enumerate(names, 1) if full == word or full[:3] == word or (len(word) == 4 and full[:4] == word)]
    return hits[0] if hits else None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and where the date exists."""
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    first = ((np.where(good, y, 1970) - 1970) * 12 + np.where(good, m, 1) - 1).astype("datetime64[M]")
    start = first.astype("datetime64[D]").astype(np.int64)
    length = (first + 1).astype("datetime64[D]").astype(np.int64) - start
    return start + d - 1, good & (d <= length)


def _micros(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """The first six digits after the point, as microseconds; finer parts are cut off."""
    a, b = span
    return _number(chars, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))


def _clock(h, m, s, f) -> tuple[np.ndarray, np.ndarray]:
    return (h * 3600 + m * 60 + s) * SECOND + f, (h <= 23) & (m <= 59) & (s <= 59)


def _at_zones(wall: np.ndarray, good: np.ndarray, zones: Zones) -> tuple[np.ndarray, np.ndarray]:
    out, fine = wall.copy(), np.zeros(len(wall), dtype=bool)
    numbers, names = zones
    for k in np.unique(numbers):
        if names[k]:
            at = np.flatnonzero(numbers == k)
            out[at], fine[at] = wall_to_utc(wall[at], names[k])
    return out, good & fine


def _written(shape: re.Match) -> Callable[[np.ndarray, Zones], tuple[np.ndarray, np.ndarray]]:
    """The parser of masks such as 0000-00-00a00:00:00.000+0000."""
    has = {k: shape.span(k) for k, v in shape.groupdict().items() if v is not None}

    def parse(chars: np.ndarray, zones: Zones) -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros(len(chars), dtype=np.int64)
        get = lambda k: _number(chars, has[k]) if k in has else zero
        year = get("Y") + (2000 if has["Y"][1] - has["Y"][0] == 2 else 0)
        good = np.ones(len(chars), dtype=bool)
        month = get("m")
        if "mon" in has:
            month, good = _look_up(chars, has["mon"], functools.partial(_name, MONTHS))
        days, real = _days(year, month, get("d"))
        good = good & real
        if "wd" in has:
            weekday, known = _look_up(chars, has["wd"], functools.partial(_name, WEEKDAYS))
            good &= known & ((days + 3) % 7 + 1 == weekday)
        hour = get("H")
        if "ap" in has:
            noon, known = _look_up(chars, has["ap"], lambda w: {"am": 0, "pm": 12}.get(w.lower()))
            good &= known & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + noon
        clock, real = _clock(hour, get("M"), get("S"), _micros(chars, has["f"]) if "f" in has else zero)
        wall, good = days * DAY + clock, good & real
        offset, fixed = zero, False
        if "z" in has:
            minutes, known = _look_up(chars, has["z"], lambda w: ABBREVIATIONS.get(w.upper()))
            good &= known & ((minutes == 0) if "sign" in has else True)
            offset, fixed = minutes * 60 * SECOND, True
        if "sign" in has:
            oh, om = get("oh"), get("om")
            good &= (om <= 59) & (oh * 60 + om <= 18 * 60)
            sign, _ = _look_up(chars, has["sign"], lambda w: 1 if w == "+" else -1)
            offset, fixed = offset + sign * (oh * 60 + om) * 60 * SECOND, True
        if fixed:
            return wall - offset, good
        if "id" in has:
            names, at = _words(chars, has["id"])
            zones = at, [str(x) for x in names]
        return _at_zones(wall, good, zones)

    return parse


def _plain_number(mask: str) -> Callable[[np.ndarray, Zones], tuple[np.ndarray, np.ndarray]]:
    """The parser of digits alone: Unix time in a unit, or date and time written out, whichever falls into NUMBER_YEARS."""
    whole, _, part = mask.partition(".")
    n, span = len(whole), (len(whole) + 1, len(mask))
    low, high = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) * SECOND for y in (NUMBER_YEARS[0], NUMBER_YEARS[1] + 1))

    def parse(chars: np.ndarray, zones: Zones) -> tuple[np.ndarray, np.ndarray]:
        out, good = np.zeros(len(chars), dtype=np.int64), np.zeros(len(chars), dtype=bool)
        zero = np.zeros(len(chars), dtype=np.int64)
        for digits, unit in ((10, 1), (13, 1_000), (16, 1_000_000), (19, 1_000_000_000)):
            if n == digits:
                v = _number(chars, (0, n))
                fraction = _micros(chars, span) if part else zero
                us = v * (SECOND // unit) + fraction // unit if unit <= SECOND else v // (unit // SECOND)
                fits = (us >= low) & (us < high)
                out, good = np.where(fits, us, out), good | fits
        spans = []
        if n == 12 or (n >= 14 and not part) or n == 14:
            spans.append(((0, 4), 4, n >= 14))
        if n in (10, 12):
            spans.append(((0, 2), 2, n == 12))
        for years, k, seconds in spans:
            year = _number(chars, years) + (2000 if k == 2 else 0)
            fits = (year >= NUMBER_YEARS[0]) & (year <= NUMBER_YEARS[1]) & ~good
            if not fits.any() or (part and not seconds):
                continue
            at = lambda i, k=k: _number(chars, (k + 2 * i, k + 2 * i + 2))
            days, real = _days(year, at(0), at(1))
            f = _micros(chars, span) if part else _micros(chars, (14, n)) if n > 14 else zero
            clock, fine = _clock(at(2), at(3), at(4) if seconds else zero, f)
            utc, fine = _at_zones(days * DAY + clock, fits & real & fine, zones)
            out, good = np.where(fine, utc, out), good | fine
        return out, good

    return parse


@functools.lru_cache(maxsize=65_536)
def parser_of(mask: str) -> Callable[[np.ndarray, Zones], tuple[np.ndarray, np.ndarray]] | None:
    """The parser of a mask; None if no value of that mask is a timestamp."""
    if len(mask) < 10:
        return None
    if _DIGITS.fullmatch(mask):
        return _plain_number(mask)
    shape = next((m for s in _SHAPES if (m := s.fullmatch(mask))), None)
    return _written(shape) if shape else None


def to_utc(values: pa.Array | list[str | None], zones: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of each value, and where there is one. zones: of the wall clock, used where a value names none."""
    values, zones = (pa.array(x, pa.string()) if isinstance(x, list) else x for x in (values, zones))
    values = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
    if not pc.all(pc.string_is_ascii(values)).as_py():
        for odd, plain in _SAME.items():
            values = pc.replace_substring(values, odd, plain)
    out, good = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", dtype=np.uint8)
    masks = pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_MASK[data])]).dictionary_encode()
    number = masks.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    named = pc.fill_null(zones, "").dictionary_encode()
    zone, names = named.indices.to_numpy(), named.dictionary.to_pylist()
    for mask, at in zip(masks.dictionary.to_pylist(), np.split(order, np.searchsorted(number[order], np.arange(1, len(masks.dictionary)))), strict=False):
        # Long masks aren't worth keeping.
        parse = parser_of(mask) if len(mask) <= 80 else parser_of.__wrapped__(mask)
        if parse is not None:
            chars = data[ends[at][:, None] + np.arange(len(mask))].astype(np.uint32)
            out[at], good[at] = parse(chars, (zone[at], names))
    return out, good


def _reader(edition: str) -> Callable[..., Column]:
    @F.arrow_udf(LongType())
    def read(values: pa.Array, zones: pa.Array) -> pa.Array:
        if zone_edition() != edition:
            raise RuntimeError(f"zone tables of edition {zone_edition()} on this worker, {edition} in the plan")
        out, good = to_utc(values, zones)
        return pa.array(out, mask=~good)

    # Spark may copy a deterministic function into every filter on its result, and so run it twice.
    return read.asNondeterministic()


#: Forms that most values have. They name their offset and are read on the JVM, without Python.
COMMON_FORMS = {
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\+0000\z": "yyyy-MM-dd'T'HH:mm:ss.SSSxx",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z": "yyyy-MM-dd'T'HH:mm:ssX",
}


def utc_micros(value: Column, zone: Column | None = None, common: dict[str, str] = COMMON_FORMS, edition: str | None = None) -> Column:
    """Microseconds since 1970-01-01 UTC of a written timestamp, or null if it doesn't denote exactly one instant.

    zone: name of the zone of wall-clock times (null: not known). Values in one of the ``common`` forms stay on the JVM.
    edition: of the zone tables, if it is to be a certain one; ValueError if another one is installed.
    """
    here = zone_edition()
    if edition not in (None, here):
        raise ValueError(f"zone tables of edition {edition} are asked for, {here} is installed")
    zone = F.lit(None).cast("string") if zone is None else zone.cast("string")
    is_common = functools.reduce(lambda a, b: a | b, [value.rlike(p) for p in common], F.lit(False))
    rest = _reader(here)(F.when(~is_common, value), zone)
    quick = F.coalesce(*[F.when(value.rlike(p), F.unix_micros(F.try_to_timestamp(value, F.lit(form)))) for p, form in common.items()], F.lit(None).cast("long"))
    return F.when(is_common, quick).otherwise(rest)
