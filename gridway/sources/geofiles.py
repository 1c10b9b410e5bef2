"""GeoPackages and zipped Shapefiles as rows, and their geometry on WGS84.

Files are read by Spark, decoded where they are read and kept in memory only: no local copies. A file is one task; what passes the
2 GB of a binary column is an error of the read. Both readers give (file, layer, fid, kind, parts, properties, system): parts are
lists of points (x, y) in the file's own coordinates, kind one of point, line, polygon and collection, null where there is no geometry,
and system the number of the reference system, 4326 where none is stated. Heights and measures are dropped.
"""

from __future__ import annotations

import io
import os
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import geo

POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
FEATURE = pa.schema([("file", pa.string()), ("layer", pa.string()), ("fid", pa.int64()), ("kind", pa.string()), ("parts", POINTS), ("properties", pa.map_(pa.string(), pa.string())), ("system", pa.int32())])
SCHEMA = "file string, layer string, fid bigint, kind string, parts array<array<struct<x:double,y:double>>>, properties map<string,string>, system int"
#: Rows that leave a task at a time.
ROWS = 1024
Parts = list[list[dict[str, float]]]
KINDS = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon", 7: "collection"}


def well_known(data: bytes, at: int = 0) -> tuple[str, Parts, int]:
    """(kind, parts, end) of well-known binary geometry of any kind, with or without heights and measures, ISO or extended."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    extended, base = code >> 29, (code & 0x1FFFFFFF) % 1000
    width = 2 + {0: 0, 1: 1, 2: 1, 3: 2}[(code & 0x1FFFFFFF) // 1000] + bool(extended & 4) + bool(extended & 2)
    at += 4 * bool(extended & 1)  # a reference system of its own

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def points(n: int) -> list[dict[str, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * width}d", data, at)
        at += 8 * n * width
        return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, n * width, width)]

    if base == 1:
        own = points(1)
        parts = [own] if own[0]["x"] == own[0]["x"] else []  # an empty point is not a number
    elif base == 2:
        parts = [points(count())]
    elif base == 3:
        parts = [points(count()) for _ in range(count())]
    elif base in (4, 5, 6, 7):
        parts = []
        for _ in range(count()):
            _, more, at = well_known(data, at)
            parts += more
    else:
        raise ValueError(f"geometry of kind {code}")
    return KINDS[base], [p for p in parts if p], at


def packaged(blob: bytes | None) -> tuple[str | None, Parts]:
    """A GeoPackage's geometry: a head with an envelope of one of five sizes before well-known binary."""
    if blob is None:
        return None, []
    if blob[:2] != b"GP":
        raise ValueError("geometry without the head of a GeoPackage")
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    kind, parts, _ = well_known(blob, 8 + envelope)
    return kind, parts


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), FEATURE, strict=True)], schema=FEATURE)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), FEATURE, strict=True)], schema=FEATURE)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def package_rows(file: str, content: bytes) -> Iterator[tuple]:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    systems = {i: n for i, n in con.execute("SELECT srs_id, organization_coordsys_id FROM gpkg_spatial_ref_sys")}
    layers = con.execute("SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) WHERE c.data_type = 'features' ORDER BY 1").fetchall()
    for layer, column, srs in layers:
        names = [r[1] for r in con.execute(f"PRAGMA table_info({quoted(layer)})")]
        system = systems.get(srs, srs)
        for fid, *values in con.execute(f"SELECT rowid, {', '.join(map(quoted, names))} FROM {quoted(layer)} ORDER BY rowid"):
            row = dict(zip(names, values, strict=True))
            kind, parts = packaged(row.pop(column))
            yield file, layer, fid, kind, parts, [(k, str(v)) for k, v in row.items() if v is not None and not isinstance(v, bytes)], 4326 if system in (0, -1) else system
    con.close()


def geopackage(spark: SparkSession, path: str) -> DataFrame:
    """Every feature of every layer."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from batches_of(package_rows(file, content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(features, SCHEMA)


def shape(data: bytes) -> tuple[str | None, Parts]:
    """One record of a Shapefile; kinds with heights and measures begin like the plain ones."""
    (code,) = struct.unpack_from("<i", data)
    if code == 0:
        return None, []
    base = code % 10
    if base == 1:
        x, y = struct.unpack_from("<2d", data, 4)
        return "point", [[{"x": x, "y": y}]]
    if base == 8:
        (n,) = struct.unpack_from("<i", data, 36)
        flat = struct.unpack_from(f"<{2 * n}d", data, 40)
        return "point", [[{"x": flat[k], "y": flat[k + 1]}] for k in range(0, 2 * n, 2)]
    if base not in (3, 5):
        raise ValueError(f"shape of kind {code}")
    parts, n = struct.unpack_from("<2i", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", data, 44 + 4 * parts)
    points = [{"x": flat[k], "y": flat[k + 1]} for k in range(0, 2 * n, 2)]
    return ("line" if base == 3 else "polygon"), [points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]


def attributes(data: bytes, encoding: str) -> Iterator[list[tuple[str, str]]]:
    """The rows of a dBASE table, deleted ones too, as they stand beside shapes."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    for k in range(n):
        row, at, own = data[head + k * width : head + (k + 1) * width], 1, []
        for name, size in fields:
            value = row[at : at + size].decode(encoding, "replace").strip(" \0")
            at += size
            if value:
                own.append((name, value))
        yield own


def system_of(text: str | None) -> int:
    """The number of the reference system that a projection file describes; 0 for one that is not known."""
    if not text:
        return 4326
    found = re.findall(r'AUTHORITY\["EPSG","?([0-9]+)"?\]\]\s*$', text)
    zone = re.search(r"UTM[_ ]zone[_ ]([0-9]+)N", text, re.I)
    if found:
        return int(found[-1])
    if zone:
        return 32600 + int(zone[1])
    return 4326 if text.lstrip().startswith("GEOGCS") else 0


def shapefile_rows(file: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {n.lower(): n for n in z.namelist()}
        for low in sorted(n for n in names if n.endswith(".shp")):
            stem = low[:-4]
            beside = lambda suffix, stem=stem: z.read(names[stem + suffix]) if stem + suffix in names else None
            data, table, projection, page = z.read(names[low]), beside(".dbf"), beside(".prj"), beside(".cpg")
            system = system_of(projection.decode("latin-1") if projection else None)
            encoding = page.decode("ascii").strip() if page else "cp1252"
            rows = attributes(table, encoding) if table else iter(())
            at = 100
            while at < len(data):
                number, words = struct.unpack_from(">2i", data, at)
                kind, parts = shape(data[at + 8 : at + 8 + 2 * words])
                yield file, os.path.basename(names[low])[:-4], number, kind, parts, next(rows, []), system
                at += 8 + 2 * words


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Every shape of every .shp in zip archives, with its row of the .dbf beside it."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from batches_of(shapefile_rows(file, content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(features, SCHEMA)


def utm_zone(system: Column) -> Column:
    """The zone of a reference system on UTM: WGS84's, ETRS89's, and those of the latter whose eastings start with their zone."""
    return F.when(system.between(32601, 32660), system - 32600).when(system.between(25828, 25838), system - 25800).when(system == 4647, 32).when(system == 5650, 33)


def on_wgs84(parts: Column, system: Column) -> Column:
    """parts as points (lng, lat), whatever their depth in lists of two; null where the system is neither geographic nor UTM, rather
    than points somewhere else."""
    zone = utm_zone(system)
    prefixed = F.when(system.isin(4647, 5650), zone * 1_000_000).otherwise(0)
    plain = lambda p: F.struct(p["x"].alias("lng"), p["y"].alias("lat"))

    def turned(p: Column) -> Column:
        lat, lng = geo.utm_to_wgs84(p["x"] - prefixed, p["y"], zone)
        return F.struct(lng.alias("lng"), lat.alias("lat"))

    each = lambda f: F.transform(parts, lambda line: F.transform(line, f))
    return F.when(system.isin(4326, 4258, 4979), each(plain)).when(zone.isNotNull(), each(turned))


def routes(features: DataFrame, most: int = 2000) -> DataFrame:
    """(file, layer, points) of the layers' lines, in order of fid, on WGS84 and at most so many points, evenly chosen; both ends stay.
    Layers with fewer than two usable points are no routes."""
    lines = features.filter("kind = 'line'").select("file", "layer", "fid", F.flatten(on_wgs84(F.col("parts"), F.col("system"))).alias("points")).filter("points IS NOT NULL")
    usable = F.filter("points", lambda p: p["lat"].between(-90, 90) & p["lng"].between(-180, 180))
    whole = lines.groupBy("file", "layer").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fid", usable.alias("points")))), lambda x: x["points"])).alias("points"))
    n = F.size("points")
    step = (n - 1) / F.lit(most - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("points", F.floor(i * step + 0.5).cast("int")))
    return whole.filter(n >= 2).select("file", "layer", F.when(n <= most, F.col("points")).otherwise(chosen).alias("points"))
