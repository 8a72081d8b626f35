"""Height fields from netCDF classic files (CDF-1, CDF-2, CDF-5), parsed in executors from Spark's binary source.

A file is read whole by one task, as yearly files are; its rows come out in Arrow batches of one time step each.
"""

from __future__ import annotations

import datetime as dt
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import HEIGHT_ROWS

# Tags and types of the classic format.
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Days per month of calendars that differ from the usual one.
_CALENDARS = {"noleap": False, "365_day": False, "all_leap": True, "366_day": True}


@dataclass(frozen=True)
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    dtype: np.dtype
    size: int
    begin: int


class ClassicFile:
    """The header of a classic file, and its variables as arrays."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a netCDF classic file")
        self.data, self.at, self.version = data, 4, data[3]
        n = self._count()
        self.dims = [(self._name(), self._count()) for _ in self._list(_DIMENSION)]
        self.attributes = self._attributes()
        self.variables = {v.name: v for v in [self._variable() for _ in self._list(_VARIABLE)]}
        recorded = [v for v in self.variables.values() if self._is_record(v)]
        step = sum(v.size + (-v.size % 4 if len(recorded) > 1 else 0) for v in recorded)
        unset = (1 << (64 if self.version == 5 else 32)) - 1
        self.records = n if n != unset else (len(data) - min(v.begin for v in recorded)) // step if recorded else 0
        self.step = step

    def _unpack(self, kind: str):
        (value,) = struct.unpack_from(">" + kind, self.data, self.at)
        self.at += struct.calcsize(">" + kind)
        return value

    def _count(self) -> int:
        return self._unpack("Q" if self.version == 5 else "I")

    def _list(self, tag: int) -> range:
        found, n = self._unpack("I"), self._count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"unexpected tag {found} at {self.at}")
        return range(n)

    def _name(self) -> str:
        n = self._count()
        text = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return text

    def _attributes(self) -> dict:
        out = {}
        for _ in self._list(_ATTRIBUTE):
            name, kind, n = self._name(), self._unpack("I"), self._count()
            dtype = np.dtype(_TYPES[kind])
            raw = self.data[self.at : self.at + n * dtype.itemsize]
            self.at += len(raw) + -len(raw) % 4
            out[name] = raw.rstrip(b"\0").decode() if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    def _variable(self) -> Variable:
        name = self._name()
        dims = [self._count() for _ in range(self._count())]
        attributes, kind = self._attributes(), self._unpack("I")
        self._count()  # the stored size; it can overflow, so it is computed
        begin = self._unpack("I" if self.version == 1 else "Q")
        dtype = np.dtype(_TYPES[kind])
        inner = [self.dims[d][1] for d in dims if self.dims[d][1]]
        return Variable(name, dims, attributes, dtype, int(np.prod(inner, dtype=np.int64)) * dtype.itemsize, begin)

    def _is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d][1] or self.records for d in v.dims]

    def slab(self, name: str, record: int | None = None) -> np.ndarray:
        """A variable, or one step of its first dimension, as floats with scale, offset and missing values applied."""
        v = self.variables[name]
        shape = self.shape(v)
        if self._is_record(v):
            steps = range(self.records) if record is None else [record]
            raw = np.concatenate([np.frombuffer(self.data, v.dtype, v.size // v.dtype.itemsize, v.begin + r * self.step) for r in steps] or [np.zeros(0, v.dtype)])
        else:
            inner = int(np.prod(shape[1:], dtype=np.int64))
            start, count = (0, inner * (shape[0] if shape else 1)) if record is None else (record * inner, inner)
            raw = np.frombuffer(self.data, v.dtype, count, v.begin + start * v.dtype.itemsize)
        x = raw.astype(np.float64).reshape(shape if record is None else shape[1:])
        for missing in ("missing_value", "_FillValue"):
            for value in v.attributes.get(missing, []):
                x[raw.reshape(x.shape) == np.array(value, v.dtype)] = np.nan
        return x * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]


def decode_times(values: np.ndarray, units: str, calendar: str = "standard") -> list[dt.date | None]:
    """Dates of "<unit>s since <date>" values; days that the usual calendar lacks are None."""
    unit, _, since = units.partition(" since ")
    seconds = _SECONDS[unit.strip().lower().rstrip("s")]
    day, _, clock = since.strip().replace("T", " ").partition(" ")
    year, month, dom = (int(p) for p in day.split("-"))
    hours = [float(p) for p in clock.split()[0].rstrip("Z").split(":")] if clock.strip() else [0.0]
    start = sum(h * s for h, s in zip(hours, (3600, 60, 1)))
    days = np.floor((values * seconds + start) / 86400).astype(int)
    calendar = calendar.lower()
    if calendar == "360_day":
        first = (year * 12 + month - 1) * 30 + dom - 1
        parts = [((first + d) // 360, (first + d) // 30 % 12 + 1, (first + d) % 30 + 1) for d in days.tolist()]
    elif calendar in _CALENDARS:
        lengths = [31, 29 if _CALENDARS[calendar] else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        before, whole = np.cumsum([0, *lengths]), sum(lengths)
        first = year * whole + int(before[month - 1]) + dom - 1
        parts = []
        for d in days.tolist():
            y, rest = divmod(first + d, whole)
            m = int(np.searchsorted(before, rest, "right"))
            parts.append((y, m, rest - int(before[m - 1]) + 1))
    else:
        base = dt.date(max(year, 1), month, dom)
        return [base + dt.timedelta(days=d) for d in days.tolist()]
    out: list[dt.date | None] = []
    for p in parts:
        try:
            out.append(dt.date(*p))
        except ValueError:
            out.append(None)
    return out


def _rows(variable: str):
    def parse(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                f = ClassicFile(content)
                time = f.variables["time"]
                dates = decode_times(f.slab("time"), time.attributes["units"], time.attributes.get("calendar", "standard"))
                names = [f.dims[d][0] for d in f.variables[variable].dims]
                levels = f.slab("level") if "level" in names else np.zeros(1)
                lats = f.slab("lat")
                for i, date in enumerate(dates):
                    if date is None:
                        continue
                    z = f.slab(variable, i).reshape(len(levels), len(lats), -1).astype(np.float32)
                    n = len(levels) * len(lats)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([date] * n, pa.date32()), pa.array(np.repeat(levels, len(lats)).astype(np.int32)), pa.array(np.tile(lats, len(levels))), pa.array(list(z.reshape(n, -1)), pa.list_(pa.float32()))],
                        names=["date", "level", "lat", "z"],
                    )

    return parse


def read_netcdf(spark: SparkSession, path: str, variable: str = "hgt") -> DataFrame:
    """(date, level, lat, z) of variable(time, [level,] lat, lon) in classic files at path, from any store Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(variable), HEIGHT_ROWS)
