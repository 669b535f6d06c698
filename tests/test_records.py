import json
import struct
import zlib

import numpy as np
import pytest

from tabulon.sources import formats, records

D = {"i": np.arange(11, dtype="<i8"), "u": np.arange(11, dtype="<u2") + 60_000, "f": np.linspace(-1, 1, 11).astype("<f4"), "ok": np.arange(11) % 3 == 0, "s": np.array([f"v{i}" for i in range(11)]), "b": np.array([b"x", b"yz"] * 5 + [b""]), "d": np.arange(11).astype("<M8[D]")}


def write(path, columns, parts):
    listed = [{"name": n, "dtype": v.dtype.str, "encoding": "raw", "nullable": False} for n, v in columns.items()]
    manifest = json.dumps({"format_version": 1, "columns": listed, "manifest_crc32": zlib.crc32(json.dumps({"columns": listed}, sort_keys=True).encode())}).encode()
    rows = sum(b - a for a, b in parts)
    counters = struct.pack("<qqq", len(parts), rows, 0)
    out = b"CSTORE\0\1" + counters + struct.pack("<I36x", zlib.crc32(counters)) + struct.pack("<Q", len(manifest)) + manifest
    out += bytes(-len(out) % 64)
    for i, (a, b) in enumerate(parts):
        head = struct.pack("<4sqqq", b"REC\1", i, b - a, 0)
        body = b"".join(v[a:b].tobytes() for v in columns.values())
        out += head + struct.pack("<I", zlib.crc32(head)) + body + bytes(-len(body) % 8)
    path.write_bytes(out)
    return path


def test_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records.slices, "__defaults__", (3,))  # records in several pieces
    p = write(tmp_path / "x.bin", D, [(0, 4), (4, 4), (4, 11)])
    t = formats.read(p, format="records")
    got = t.dict()
    assert list(got) == list(D) and t.dtypes["u"] == np.dtype("u2")
    for n, v in D.items():
        assert np.array_equal(got[n], v), n
    assert np.array_equal(t[9:1:-2, "i"].array(), D["i"][9:1:-2])
    some = formats.read(p, format="records", columns=["f", "i"]).dict()
    assert list(some) == ["f", "i"] and np.array_equal(some["f"], D["f"])
    with pytest.raises(KeyError):
        formats.read(p, format="records", columns=["none"])


def test_no_rows(spark, tmp_path):
    p = write(tmp_path / "x.bin", D, [])
    assert len(formats.read(p, format="records")["i"].array()) == 0


@pytest.mark.parametrize("at", [0, 9, 90, "record", "cut"])
def test_damage(spark, tmp_path, at):
    p = write(tmp_path / "x.bin", D, [(0, 11)])
    raw = bytearray(p.read_bytes())
    if at == "cut":
        raw = raw[:-9]
    else:
        at = raw.index(b"REC\1") + 12 if at == "record" else at
        raw[at] ^= 1
    p.write_bytes(bytes(raw))
    with pytest.raises(records.DamagedFile):
        records.layout(str(p))
