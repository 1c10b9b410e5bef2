"""GeoPackages and Shapefiles that the tests write, read back."""

import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridway.sources import geofiles

LINE = [(500000.0, 5538630.70), (510000.0, 5538630.70), (520000.0, 5548630.0)]


def wkb(kind, coordinates, order="<", dims=0):
    """Well-known binary; dims is 0, 1000 (heights), 2000 (measures) or 3000 (both)."""
    extra = {0: 0, 1000: 1, 2000: 1, 3000: 2}[dims]
    mark = b"\1" if order == "<" else b"\0"
    point = lambda p: struct.pack(f"{order}{2 + extra}d", *p, *([7.5] * extra))
    run = lambda ps: struct.pack(order + "I", len(ps)) + b"".join(map(point, ps))
    body = {1: lambda c: point(c), 2: run, 3: lambda c: struct.pack(order + "I", len(c)) + b"".join(map(run, c))}
    if kind in body:
        return mark + struct.pack(order + "I", kind + dims) + body[kind](coordinates)
    return mark + struct.pack(order + "I", kind + dims) + struct.pack(order + "I", len(coordinates)) + b"".join(wkb(k, c, order, dims) for k, c in coordinates)


def head(envelope=0):
    return b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", 25832) + b"\0" * (0, 32, 48, 48, 64)[envelope]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dims", [0, 1000, 2000, 3000])
def test_well_known_binary_of_all_kinds(order, dims):
    a, b, c = (1.0, 2.0), (3.0, 4.0), (5.0, 6.0)
    xy = lambda *ps: [{"x": x, "y": y} for x, y in ps]
    cases = [
        ((1, a), "point", [xy(a)]), ((2, [a, b]), "line", [xy(a, b)]), ((3, [[a, b, c, a], [b, c, b]]), "polygon", [xy(a, b, c, a), xy(b, c, b)]), ((2, []), "line", []), ((1, (float("nan"),) * 2), "point", []),
        ((4, [(1, a), (1, b)]), "point", [xy(a), xy(b)]), ((5, [(2, [a, b]), (2, [b, c])]), "line", [xy(a, b), xy(b, c)]), ((6, [(3, [[a, b, c, a]])]), "polygon", [xy(a, b, c, a)]), ((7, [(1, a), (2, [b, c])]), "collection", [xy(a), xy(b, c)]),
    ]
    for (kind, coordinates), name, parts in cases:
        data = wkb(kind, coordinates, order, dims)
        assert geofiles.well_known(data) == (name, parts, len(data))


def write_package(path):
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization_coordsys_id INTEGER, definition TEXT); INSERT INTO gpkg_spatial_ref_sys VALUES (25832, 25832, 'x'), (4326, 4326, 'x'), (7, 4647, 'x'), (9, 31467, 'x');
        CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER);""")
    for name, srs in (("north", 25832), ("plain", 4326), ('odd "name"', 7), ("old", 9)):
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (name,))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (name, srs))
        con.execute(f"CREATE TABLE {geofiles.quoted(name)} (fid INTEGER PRIMARY KEY, geom BLOB, title TEXT, n INTEGER)")
    con.execute("INSERT INTO gpkg_contents VALUES ('tiles', 'tiles')")
    con.execute("INSERT INTO north VALUES (1, ?, 'A', 5), (2, ?, NULL, NULL), (3, NULL, 'none', 1)", (head(1) + wkb(2, LINE), head(4) + wkb(5, [(2, LINE[1:]), (2, LINE[:2])], ">", 1000)))
    con.execute("INSERT INTO plain VALUES (4, ?, 'B', 1)", (head() + wkb(2, [(8.0, 50.0), (8.5, 50.5)]),))
    con.execute(f"INSERT INTO {geofiles.quoted('odd \"name\"')} VALUES (1, ?, 'C', 1)", (head(2) + wkb(2, [(x + 32_000_000, y) for x, y in LINE]),))
    con.execute("INSERT INTO old VALUES (1, ?, 'D', 1)", (head() + wkb(2, LINE),))
    con.commit()
    con.close()


def test_geopackage_layers_and_systems(spark, tmp_path):
    write_package(tmp_path / "a.gpkg")
    df = geofiles.geopackage(spark, str(tmp_path / "*.gpkg"))
    rows = {(r.layer, r.fid): r for r in df.collect()}
    assert set(rows) == {("north", 1), ("north", 2), ("north", 3), ("plain", 4), ('odd "name"', 1), ("old", 1)}
    assert rows["north", 1].properties == {"fid": "1", "title": "A", "n": "5"} and rows["north", 3].kind is None and rows["north", 3].parts == []
    assert [len(p) for p in rows["north", 2].parts] == [2, 2] and rows['odd "name"', 1].system == 4647
    placed = {(r.layer, r.fid): r.p for r in df.select("layer", "fid", geofiles.on_wgs84(F.col("parts"), F.col("system")).alias("p")).collect()}
    first = placed["north", 1][0][0]
    assert first.lng == pytest.approx(9.0, abs=1e-9) and first.lat == pytest.approx(50.0, abs=1e-6)
    assert placed["plain", 4][0][1].lat == 50.5 and placed["old", 1] is None
    for a, b in zip(placed["north", 1][0], placed['odd "name"', 1][0], strict=True):
        assert (a.lng, a.lat) == pytest.approx((b.lng, b.lat), abs=1e-9)
    found = {r.layer: r.points for r in geofiles.routes(df, most=4).collect()}
    assert set(found) == {"north", "plain", 'odd "name"'} and len(found["north"]) == 4 and len(found["plain"]) == 2
    assert found["north"][0] == first and found["north"][-1] == placed["north", 2][1][-1]


def shapes(records, kind):
    body = b""
    for n, r in enumerate(records, 1):
        body += struct.pack(">2i", n, len(r) // 2) + r
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i", 1000, kind) + b"\0" * 64 + body


def poly(code, parts):
    starts, points, at = [], [], 0
    for p in parts:
        starts.append(at)
        points += p
        at += len(p)
    tail = b"\0" * 8 * (2 + at) if code > 10 else b""
    return struct.pack("<i4d2i", code, 0, 0, 1, 1, len(parts), at) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) + tail


def table(rows, encoding="cp1252"):
    head = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 32 + 64 + 1, 1 + 12 + 5)
    field = lambda name, kind, size: name.encode().ljust(11, b"\0") + kind + b"\0" * 4 + bytes([size]) + b"\0" * 15
    return head + field("NAME", b"C", 12) + field("T", b"N", 5) + b"\x0d" + b"".join(b" " + n.encode(encoding).ljust(12) + t.encode().rjust(5) for n, t in rows)


def test_zipped_shapefiles(spark, tmp_path):
    utm = 'PROJCS["ETRS_1989_UTM_Zone_32N",GEOGCS["x"]]'
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("d/Wege.SHP", shapes([poly(3, [LINE]), struct.pack("<i", 0), poly(13, [LINE[:2], LINE[1:]])], 3))
        z.writestr("d/Wege.dbf", table([("Brücke", "12.5"), ("leer", ""), ("", "7")]))
        z.writestr("d/Wege.prj", utm)
        z.writestr("d/orte.shp", shapes([struct.pack("<i2d", 1, 8.0, 50.0), struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + struct.pack("<4d", 1, 2, 3, 4), poly(5, [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]])], 1))
        z.writestr("d/readme.txt", "x")
    df = geofiles.shapefile(spark, str(tmp_path / "*.zip"))
    rows = {(r.layer, r.fid): r for r in df.collect()}
    assert [rows["Wege", n].kind for n in (1, 2, 3)] == ["line", None, "line"] and [len(p) for p in rows["Wege", 3].parts] == [2, 2]
    assert rows["Wege", 1].properties == {"NAME": "Brücke", "T": "12.5"} and rows["Wege", 3].properties == {"T": "7"} and rows["Wege", 1].system == 32632
    assert [rows["orte", n].kind for n in (1, 2, 3)] == ["point", "point", "polygon"] and len(rows["orte", 2].parts) == 2 and rows["orte", 1].properties == {}
    [found] = geofiles.routes(df).collect()
    assert found.layer == "Wege" and len(found.points) == 7 and found.points[0].lng == pytest.approx(9.0)


def test_what_is_no_such_file_fails(spark, tmp_path):
    (tmp_path / "x.gpkg").write_bytes(b"no database")
    with pytest.raises(Exception, match="not a database"):
        geofiles.geopackage(spark, str(tmp_path / "x.gpkg")).collect()
