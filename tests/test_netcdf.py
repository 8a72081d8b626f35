import datetime as dt
import struct

import numpy as np
import pytest

from tandem.sources.netcdf import ClassicFile, decode_times, read_netcdf


def name(text):
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attributes(items):
    out = b""
    for key, value in items.items():
        if isinstance(value, str):
            raw, head = value.encode(), struct.pack(">II", 2, len(value))
        else:
            raw, head = struct.pack(">d", value), struct.pack(">II", 6, 1)
        out += name(key) + head + raw + b"\0" * (-len(raw) % 4)
    return struct.pack(">II", 12 if items else 0, len(items)) + out


def classic(z, times, levels, lats, record=True):
    """A CDF-1 file of packed shorts: hgt(time, level, lat, lon), scale 0.5, offset 100, missing -32768."""
    dims = [("time", 0 if record else len(times)), ("level", len(levels)), ("lat", len(lats)), ("lon", z.shape[3])]
    packed = np.where(np.isnan(z), -32768, np.round((z - 100) / 0.5)).astype(">i2")
    fixed = [("level", [1], {}, 5, np.array(levels, ">f4").tobytes()), ("lat", [2], {}, 5, np.array(lats, ">f4").tobytes())]
    timed = [
        ("time", [0], {"units": "hours since 1800-01-01 00:00:0.0"}, 6, [np.array([t], ">f8").tobytes() for t in times]),
        ("hgt", [0, 1, 2, 3], {"scale_factor": 0.5, "add_offset": 100.0, "missing_value": -32768.0}, 3, [p.tobytes() + b"\0" * (-p.nbytes % 4) for p in packed]),
    ]

    def build(begins):
        head = b"CDF\x01" + struct.pack(">I", len(times) if record else 0) + struct.pack(">II", 10, len(dims))
        head += b"".join(name(n) + struct.pack(">I", size) for n, size in dims) + attributes({}) + struct.pack(">II", 11, 4)
        for (n, ids, attrs, kind, _), begin in zip([*fixed, *timed], begins):
            head += name(n) + struct.pack(">I", len(ids)) + struct.pack(f">{len(ids)}I", *ids) + attributes(attrs) + struct.pack(">III", kind, 0, begin)
        return head

    at, begins, body = len(build([0] * 4)), [], b""
    for *_, raw in fixed:
        begins.append(at + len(body))
        body += raw
    if record:
        begins += [at + len(body), at + len(body) + 8]
        body += b"".join(a + b for a, b in zip(timed[0][4], timed[1][4]))
    else:
        for *_, steps in timed:
            begins.append(at + len(body))
            body += b"".join(steps)
    return build(begins) + body


@pytest.fixture
def field():
    z = np.round(np.random.default_rng(1).uniform(0, 6000, (3, 2, 2, 8)) * 2) / 2
    z[1, 0, 1, 3] = np.nan
    first = (dt.date(2000, 12, 31) - dt.date(1800, 1, 1)).days * 24
    return z, [first, first + 24, first + 48], [850.0, 500.0], [40.0, 50.0]


@pytest.mark.parametrize("record", [True, False])
def test_variables_come_back(field, record):
    z, times, levels, lats = field
    f = ClassicFile(classic(*field, record=record))
    assert np.array_equal(f.slab("hgt"), z, equal_nan=True) and np.array_equal(f.slab("hgt", 1), z[1], equal_nan=True)
    assert f.slab("time").tolist() == times and f.slab("lat").tolist() == lats


def test_rows_through_spark(spark, tmp_path, field):
    z, _, levels, lats = field
    (tmp_path / "hgt.2000.nc").write_bytes(classic(*field))
    rows = read_netcdf(spark, str(tmp_path)).collect()
    assert len(rows) == 12
    by = {(r["date"], r["level"], r["lat"]): r["z"] for r in rows}
    assert by[dt.date(2001, 1, 1), 500, 50.0] == z[1, 1, 1].tolist()
    assert np.isnan(by[dt.date(2001, 1, 1), 850, 50.0][3])


def test_calendars():
    assert decode_times(np.array([0, 36.0]), "hours since 2000-02-28 12:00:00") == [dt.date(2000, 2, 28), dt.date(2000, 3, 1)]
    assert decode_times(np.array([1]), "days since 2000-02-28", "noleap") == [dt.date(2000, 3, 1)]
    assert decode_times(np.array([0, 1, 2]), "days since 2001-02-28", "360_day") == [dt.date(2001, 2, 28), None, None]
    assert decode_times(np.array([1, 2]), "days since 2001-02-28", "all_leap") == [None, dt.date(2001, 3, 1)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        ClassicFile(b"\x89HDF\r\n")
