"""Package headers and databases, built here byte by byte."""

from __future__ import annotations

import sqlite3
import struct

import pytest

from lodestone.sources import rpm

TEXT, ARRAY, I18N, INT, INT16, BIN = 6, 8, 9, 4, 3, 7


def store(values):
    """Index entries and data of (tag, type, value) in order, aligned."""
    data, entries = b"", []
    for tag, kind, value in values:
        width = {3: 2, 4: 4, 5: 8}.get(kind, 1)
        data += b"\0" * (-len(data) % width)
        raw, count = {TEXT: lambda v: (v.encode() + b"\0", 1), ARRAY: lambda v: (b"".join(x.encode() + b"\0" for x in v), len(v)), I18N: lambda v: (b"".join(x.encode() + b"\0" for x in v), len(v)), INT: lambda v: (struct.pack(f">{len(v)}i", *v), len(v)), INT16: lambda v: (struct.pack(f">{len(v)}h", *v), len(v)), BIN: lambda v: (v, len(v))}[kind](value)
        entries.append((tag, kind, len(data), count))
        data += raw
    return entries, data


def header(values, region=True, behind=(), entries=None, change=lambda b: b):
    """A header blob; the region's entry comes first, its trailer last in the region's data."""
    own, data = store(values)
    if region:
        n = len(own) + 1
        trailer = struct.pack(">iiiI", 62, BIN, -n * 16, 16)
        at = len(data)
        more, rest = store([(0, BIN, data + trailer), *behind]) if behind else ([], data + trailer)
        own = [(62, BIN, at, 16), *own, *more[1:]]
        data = rest
    index = b"".join(struct.pack(">iIiI", *e) for e in (entries or own))
    return change(struct.pack(">ii", len(entries or own), len(data)) + index + data)


BASH = [(1000, TEXT, "bash"), (1001, TEXT, "4.4"), (1002, TEXT, "19.6.1"), (1004, I18N, ["sum", "zwei"]), (1028, INT16, [1, 2, 3]), (1003, INT, [2]), (1022, TEXT, "x86_64"), (1047, ARRAY, ["a", "b", "c"])]
KEY = [(1000, TEXT, "gpg-pubkey"), (1001, TEXT, "307e"), (1002, TEXT, "5b6")]


@pytest.fixture
def read(spark):
    def run(**blobs):
        good, bad = rpm.headers(spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "k string, blob binary"))
        return {r.k: tuple(r)[1:] for r in good.collect()}, {r.k: r.problem for r in bad.collect()}

    return run


def test_headers(read):
    want = ("bash", "4.4", "19.6.1", 2, "x86_64")
    late = [(1003, INT, [7]), (5000, TEXT, "late"), (1000, TEXT, "not this")]
    good, bad = read(v4=header(BASH), v3=header(BASH, region=False), behind=header(BASH[:5] + BASH[6:], behind=late), key=header(KEY), text=header([*KEY, (1022, TEXT, "ä")]))
    assert not bad
    assert good == {"v4": want, "v3": want, "behind": ("bash", "4.4", "19.6.1", 7, "x86_64"), "key": ("gpg-pubkey", "307e", "5b6", None, None), "text": ("gpg-pubkey", "307e", "5b6", None, "ä")}


def test_broken_headers(read):
    whole = header(BASH)
    put = lambda at, raw: lambda b: b[:at] + raw + b[at + len(raw) :]
    good, bad = read(
        fine=whole, empty=b"", short=whole[:7], none=header(BASH, change=put(0, struct.pack(">i", 0))), negative=header(BASH, change=put(0, struct.pack(">i", -3))), large=header(BASH, change=put(4, struct.pack(">i", 1 << 28))), minus=header(BASH, change=put(4, struct.pack(">i", -5))),
        cut=whole[:60], kind=header(BASH, change=put(8 + 16 + 4, struct.pack(">I", 10))), region=header(BASH, change=put(12, struct.pack(">I", 6))), far=header(BASH, change=put(16, struct.pack(">i", 1 << 20))), length=header(BASH, change=put(4, struct.pack(">i", len(whole) - 8 - 16 * 9 - 1))),
        offset=header(BASH, change=put(8 + 16 * 2 + 8, struct.pack(">i", 1 << 20))), count=header(BASH, change=put(8 + 16 * 5 + 12, struct.pack(">I", 1 << 30))), type=header([(1000, ARRAY, ["a"]), *BASH[1:]]), epoch=header([*KEY, (1003, TEXT, "1")]), open=header([(1000, TEXT, "x")], region=False, change=lambda b: b[:-1] + b"y"),
    )
    assert set(good) == {"fine"}
    assert set(bad) == {"empty", "short", "none", "negative", "large", "minus", "cut", "kind", "region", "far", "length", "offset", "count", "type", "epoch", "open"}
    assert bad["kind"] == "unknown type" and bad["region"] == "invalid region tag" and bad["far"] == "invalid region offset" and bad["none"] == "no entries" and bad["type"] == "a field of another type"


def ndb(blobs, gap=3, spoil=lambda b: b):
    """A database of one slot page; blocks lie in turn after it, the last slot first."""
    slots, body, row = [], b"\0" * gap * 16, 256 + gap
    for i, blob in enumerate(blobs, 1):
        length = 16 + len(blob)
        rows = -(-(length + 12) // 16)
        block = b"BlbS" + struct.pack("<III", i, 9, length) + blob
        block += b"\0" * (rows * 16 - len(block) - 12) + struct.pack("<II", 0, len(blob)) + b"BlbE"
        slots.insert(0, b"Slot" + struct.pack("<III", i, row, rows))
        body, row = body + block, row + rows
    slots += [b"Slot" + b"\0" * 12] * (254 - len(slots))
    return spoil(b"RpmP" + b"\0" * 4 + struct.pack("<II", 5, 1) + b"\0" * 16 + b"".join(slots) + body)


def sqlite(blobs):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE Packages (hnum INTEGER PRIMARY KEY, blob BLOB NOT NULL)")
    db.executemany("INSERT INTO Packages VALUES (?, ?)", enumerate(blobs, 1))
    db.commit()
    return db.serialize()


@pytest.mark.parametrize(("made", "read"), [(ndb, rpm.ndb_blobs), (sqlite, rpm.sqlite_blobs)])
def test_databases(spark, made, read):
    plain = header(BASH[:5] + BASH[6:])
    files = {"a": made([header(BASH), header(KEY), plain]), "b": made([plain, b"broken", header(BASH)]), "empty": made([]), "other": b"x" * 5000, "none": b""}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file string, content binary")
    blobs, broken = read(table)
    systems = spark.createDataFrame([(k, "sles", "15.3") for k in files], "file string, id string, release string")
    rows, problems = rpm.packages(blobs, systems)
    assert sorted(tuple(r) for r in rows.collect()) == sorted([(f, "bash#sles#15.3", v, "production", True) for f in "ab" for v in ("x86_64#2:4.4-19.6.1", "x86_64#4.4-19.6.1")])
    assert {(r.file, r.package) for r in problems.collect()} == {("b", 2)}
    assert {r.file for r in broken.collect()} >= {"other"}


def test_broken_ndb(spark):
    whole = ndb([header(BASH), header(KEY)])
    at = whole.index(b"BlbS")
    files = {"slots": whole[:1000], "magic": whole.replace(b"Slot", b"Slut", 1), "block": whole.replace(b"BlbS", b"BlbX", 1), "end": whole[:-1], "index": whole[: at + 4] + b"\x09" + whole[at + 5 :], "short": b"RpmP"}
    blobs, broken = rpm.ndb_blobs(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file string, content binary"))
    assert {r.file for r in broken.collect()} == set(files)
    assert {r.file for r in blobs.collect()} == {"block", "end", "index"}  # the other package of each
