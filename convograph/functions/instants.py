"""Timestamps of mixed format, precision and zone → one UTC instant in microseconds.

Method. Every value is reduced to a *shape mask* (digits → ``9``, letters → ``A``, all else kept). A mask
fixes the position of every field, so each distinct mask is compiled to a slot plan once per worker and all
values of that mask are then converted together: the strings become a code-point matrix and each field is a
weighted column sum. Wall times without a zone go through zone transition tables (built once per zone from
the installed time-zone database, whose release :func:`zone_data_version` reports).

Defined results
---------------
* NULL, empty, blank, unreadable, zero or impossible values (month 13, 25:61, 30 February) → NULL.
* A plain number is a Unix time in the unit (s, ms, µs, ns) that puts it into 2022 to 2026, else NULL.
* Doubles go to the nearest microsecond; finer digits of strings are dropped, absent ones are 0.
* An offset or zone in the value wins over the account's zone; a value without either is read in the
  account's zone, and is NULL where the account has none.
* A wall time that occurs twice or never in its zone → NULL.
* A date alone, without a time of day, is no instant → NULL. Years 1 to 9999 count.
* Abbreviations mean what ``ABBREVIATIONS`` says, also those used in several regions (``ist``, ``cst``, ``bst``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unix seconds that bound "2022 to 2026".
EPOCH_LO, EPOCH_HI = 1_640_995_200, 1_798_761_600
#: units per second of the Unix-time units
UNITS = (1, 1_000, 1_000_000, 1_000_000_000)

# Month names, and offsets (minutes) of zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "ist": 330, "npt": 345, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "est": -300,
    "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_BAD = np.iinfo(np.int64).min
_TO_MASK = {**{c: "9" for c in range(48, 58)}, **{c: "A" for c in (*range(65, 91), *range(97, 123))}}
_TO_MASK |= {0xA0: " ", 0x202F: " ", 0x2009: " ", 0x2212: "-"}

_CLOCK = r"(?P<h>99):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<abbr>A+)(?![A/]))?(?: ?(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)?(?:\[(?P<region>[A/_+9-]+)\])?"
#: shapes of whole values, matched against masks
SHAPES = tuple(
    re.compile(p + r"\Z")
    for p in (
        r"(?P<num>9{9,19})(?:\.(?P<numf>9+))?",
        rf"(?P<y>9999)-(?P<mo>99)-(?P<d>99)(?P<t>[A ]){_CLOCK}{_ZONE}",
        rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<t>A)(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9+))?{_ZONE}",
        rf"(?P<d>9{{1,2}})\.(?P<mo>9{{1,2}})\.(?P<y>9999),? {_CLOCK}{_ZONE}",
        rf"(?P<x1>9{{1,2}})/(?P<x2>9{{1,2}})/(?P<y>9999),? (?P<h>9{{1,2}}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: (?P<ap>AA)(?!A))?{_ZONE}",
        rf"(?:AAA, )?(?P<d>9{{1,2}}) (?P<mon>AAA) (?P<y>9999) {_CLOCK}{_ZONE}",
        rf"(?P<mon>AAA)A* (?P<d>9{{1,2}}),? (?P<y>9999),? (?P<h>9{{1,2}}):(?P<mi>99)(?::(?P<s>99))?(?: (?P<ap>AA)(?!A))?{_ZONE}",
    )
)


def shape_mask(value: str) -> str:
    """Digits → ``9``, ASCII letters → ``A``, no-break and narrow spaces → a space; the length stays."""
    return value.translate(_TO_MASK)


@lru_cache(maxsize=4096)
def slot_plan(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field → (start, end) for one mask, None where no shape fits."""
    for shape in SHAPES:
        if m := shape.match(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


@lru_cache(maxsize=1)
def zone_data_version() -> str:
    """Release of the time-zone database the transition tables are built from (its digest where it names none)."""
    import hashlib
    import zoneinfo
    from pathlib import Path

    for folder in map(Path, zoneinfo.TZPATH):
        for name in ("+VERSION", "tzdata.zi"):
            if (at := folder / name).exists():
                return at.open().readline().split()[-1]
        if (folder / "UTC").exists():
            every = hashlib.sha256()
            for at in sorted(p for p in folder.rglob("*") if p.is_file() and p.parts[len(folder.parts)] not in ("posix", "right")):
                every.update(at.name.encode() + at.read_bytes())
            return every.hexdigest()[:16]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "none"


#: wall seconds for which transition tables serve (1971 to 2099); other years are looked up one by one
_TABLE_FROM, _TABLE_TO = 31_536_000, 4_102_444_800 - 31_536_000


class ZoneTable:
    """UTC instants (seconds) at which a zone's offset changes, and the offsets before and after them."""

    def __init__(self, name: str) -> None:
        import zoneinfo

        zone, step = zoneinfo.ZoneInfo(name), timedelta(days=4)
        at = lambda t: int(t.astimezone(zone).utcoffset().total_seconds())
        t, end = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
        self.zone, times, offsets = zone, [], [at(t)]
        while t < end:
            nxt = t + step
            if (o := at(nxt)) != offsets[-1]:
                lo, hi = int(t.timestamp()), int(nxt.timestamp())
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if at(datetime.fromtimestamp(mid, timezone.utc)) == offsets[-1] else (lo, mid)
                times.append(hi)
                offsets.append(o)
            t = nxt
        self.times, self.offsets = np.array(times, np.int64), np.array(offsets, np.int64)

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.times, utc, side="right")]

    def _rare(self, wall: int) -> tuple[int, bool]:
        """The same for one wall time before or after the table's years."""
        try:
            local = datetime(1970, 1, 1) + timedelta(seconds=wall)
            found = set()
            for fold in (0, 1):
                utc = local.replace(tzinfo=self.zone, fold=fold).astimezone(timezone.utc)
                if utc.astimezone(self.zone).replace(tzinfo=None) == local:
                    found.add(int((utc.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()))
            return (found.pop(), True) if len(found) == 1 else (wall, False)
        except OverflowError:
            return wall, False

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall-clock seconds, and whether exactly one instant has that wall time."""
        outside = (wall < _TABLE_FROM) | (wall >= _TABLE_TO)
        if outside.any():
            utc, sure = wall.copy(), np.zeros(len(wall), bool)
            utc[~outside], sure[~outside] = self.to_utc(wall[~outside])
            utc[outside], sure[outside] = map(np.array, zip(*map(self._rare, wall[outside].tolist())))
            return utc, sure
        early, late = self.offset_at(wall - 86_400), self.offset_at(wall + 86_400)
        a, b = wall - early, wall - late
        fits_a, fits_b = self.offset_at(a) == early, self.offset_at(b) == late
        return np.where(fits_a, a, b), np.where(early == late, fits_a, fits_a ^ fits_b)


@lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    try:
        return ZoneTable(name)
    except Exception:  # an unknown or malformed zone name
        return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of valid civil dates."""
    return ((y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1)).astype("datetime64[D]").astype(np.int64) + d - 1


def _each(words: np.ndarray, f) -> np.ndarray:
    """f of each distinct word, as int64."""
    distinct, inverse = np.unique(words, return_inverse=True)
    return np.array([f(str(w)) for w in distinct], np.int64)[inverse]


def _unix_text(num: str, frac: str) -> int:
    """Microseconds of a decimal Unix time; finer digits dropped."""
    n = int(num)
    for unit in UNITS:
        if EPOCH_LO * unit <= n < EPOCH_HI * unit:
            finer = int((frac + "0" * 9)[:9])
            return (n * 10**9 + finer) * 10**6 // unit // 10**9
    return _BAD


def _convert(values: list[str], plan: dict[str, tuple[int, int]], zones: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Microseconds of values of one mask; ``_BAD`` where there is no instant."""
    n, width = len(values), len(values[0])
    text = np.array(values, f"U{width}")
    codes = text.view(np.uint32).reshape(n, width)
    word = lambda k: np.ascontiguousarray(codes[:, slice(*plan[k])]).view(f"U{plan[k][1] - plan[k][0]}").ravel()

    def number(k: str, default: int = 0) -> np.ndarray:
        if k not in plan:
            return np.full(n, default, np.int64)
        a, b = plan[k]
        return (codes[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    if "num" in plan:
        frac = word("numf") if "numf" in plan else [""] * n
        return np.array([_unix_text(str(a), str(b)) for a, b in zip(word("num"), frac)], np.int64)

    ok = np.ones(n, bool)
    if "t" in plan:
        ok &= np.isin(word("t"), ["T", "t", " "])
    year = number("y")
    if "mon" in plan:
        month = _each(word("mon"), lambda w: MONTHS.index(w.lower()) + 1 if w.lower() in MONTHS else 0)
        day = number("d")
    elif "x1" in plan:
        first, second, mdy = number("x1"), number("x2"), orders == "mdy"
        month, day = np.where(mdy, first, second), np.where(mdy, second, first)
        ok &= mdy | (orders == "dmy")
    else:
        month, day = number("mo"), number("d")
    hour, minute, second = number("h"), number("mi"), number("s")
    if "ap" in plan:
        half = _each(word("ap"), lambda w: {"am": 0, "pm": 12}.get(w.lower(), -1))
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    y, m = np.where(ok, year, 2000), np.where(ok, month, 1)
    nxt = _days(y + (m == 12), m % 12 + 1, np.ones(n, np.int64))
    first_day = _days(y, m, np.ones(n, np.int64))
    ok &= day <= nxt - first_day
    wall = (first_day + day - 1) * 86_400 + hour * 3_600 + minute * 60 + second

    micro = np.zeros(n, np.int64)
    if "f" in plan:
        a, b = plan["f"]
        plan = plan | {"f": (a, min(b, a + 6))}
        micro = number("f") * 10 ** max(0, 6 - (b - a))

    if "sign" in plan:
        hours, minutes = number("oh"), number("om")
        ok &= (hours <= 15) & (minutes <= 59)
        if "abbr" in plan:
            ok &= _each(word("abbr"), lambda w: w.lower() in ("utc", "gmt", "ut")).astype(bool)
        utc = wall - np.where(word("sign") == "+", 1, -1) * (hours * 3_600 + minutes * 60)
    elif "abbr" in plan:
        minutes = _each(word("abbr"), lambda w: ABBREVIATIONS.get(w.lower(), _BAD))
        ok &= minutes != _BAD
        utc = wall - np.where(minutes == _BAD, 0, minutes) * 60
    else:
        utc, names = wall.copy(), word("region") if "region" in plan else zones
        for name in set(names.tolist()):
            at = names == name
            if name and (table := zone_table(str(name))):
                utc[at], sure = table.to_utc(wall[at])
                ok[at] &= sure
            else:
                ok[at] = False
    return np.where(ok, utc * 1_000_000 + micro, _BAD)


def parse_instants(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """UTC microseconds (nullable Int64) of textual timestamps; see the module docstring."""
    text = values.fillna("").astype(str).str.strip()
    zone, order = zones.fillna("").astype(str).to_numpy(), orders.fillna("").astype(str).to_numpy()
    out = np.full(len(text), _BAD, np.int64)
    codes, masks = pd.factorize(text.map(shape_mask))
    for k, mask in enumerate(masks):
        if plan := slot_plan(mask):
            at = np.flatnonzero(codes == k)
            out[at] = _convert(text.iloc[at].tolist(), plan, zone[at], order[at])
    return pd.Series(pd.array(np.where(out == _BAD, 0, out), "Int64")).mask(out == _BAD)


def text_instant(value: Column, zone: Column, date_order: Column) -> Column:
    """UTC microseconds of a textual timestamp, NULL where it has none.

    All executors must have the driver's release of the time-zone database, else the query fails.
    """
    release = zone_data_version()

    @F.pandas_udf(T.LongType())
    def instants(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zone_data_version() != release:
            raise RuntimeError(f"time-zone database {zone_data_version()} on this executor, {release} on the driver")
        for values, zones, orders in batches:
            yield parse_instants(values, zones, orders)

    return instants(value, zone, date_order)


def unix_instant(value: Column) -> Column:
    """UTC microseconds of a Unix time held as a double, in the unit that puts it into 2022 to 2026.

    NULL, NaN, zero and numbers outside every unit's range → NULL. Stays in the JVM.
    """
    x = value.cast("double")
    whole, out = F.floor(x), None
    for unit in UNITS:
        scale = 1_000_000 / unit
        if scale >= 1:
            micros = whole * F.lit(int(scale)) + F.rint((x - whole) * F.lit(float(scale))).cast("long")
        else:
            micros = F.rint(x * F.lit(scale)).cast("long")
        inside = (x >= F.lit(float(EPOCH_LO * unit))) & (x < F.lit(float(EPOCH_HI * unit)))
        out = F.when(inside, micros) if out is None else out.when(inside, micros)
    return out
