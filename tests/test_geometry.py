"""Polygons with holes and parts: reading, covering and the spatial join against a plain polygon test."""

import json
import os
import tempfile

import numpy as np

from medlake.operators import joins
from medlake.sources import files

RINGS = "zone string, rings array<array<struct<x:double,y:double>>>"


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


ZONES = [
    ("holed", [square(0.0, 0.0, 10.0, 10.0), square(2.0, 2.0, 5.0, 5.0)]),
    ("parts", [square(20.0, 0.0, 24.0, 4.0), square(26.0, 6.0, 29.0, 9.0)]),
    ("star", [[(12.0, 0.3), (13.1, 4.0), (17.0, 4.2), (13.9, 6.1), (15.0, 9.7), (12.0, 7.5), (9.1, 9.9), (10.3, 6.0),
               (7.2, 4.1), (10.9, 4.0)]]),  # not closed
    ("huge", [square(-9000.0, -9000.0, 9000.0, 9000.0), square(1.0, 1.0, 28.0, 8.0)]),
    ("tiny", [square(3.0, 3.0, 3.001, 3.001)]),
    ("none", None),
]


def within(px, py, rings):
    inside = False
    for ring in rings or []:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if abs(cross) <= 1e-12 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return False
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def points():
    rng = np.random.default_rng(3)
    rnd = [(float(a), float(b)) for a, b in zip(rng.uniform(-2, 31, 500), rng.uniform(-2, 12, 500), strict=True)]
    grid = [(float(a), float(b)) for a in range(-1, 31) for b in range(-1, 11)]  # many on edges and corners
    odd = [(3.0005, 3.0005), (-8999.5, 0.0), (9000.0, 1.0), (12345.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0),
           (None, 1.0), (4.0, None), (3.0, 3.0), (3.0, 3.0)]
    return [(i, a, b) for i, (a, b) in enumerate(rnd + grid + odd)]


def expected(pts):
    out = []
    for i, a, b in pts:
        hit = [z for z, r in ZONES if a is not None and b is not None and np.isfinite([a, b]).all() and within(a, b, r)]
        out += [(i, z) for z in hit] or [(i, None)]
    return sorted(out, key=str)


def frames(spark):
    return (spark.createDataFrame(points(), "id int, longitude double, latitude double"),
            spark.createDataFrame(ZONES, RINGS))


def test_join_equals_the_plain_test(spark):
    pts, zones = frames(spark)
    want = expected(points())
    for kw in ({}, {"cell": 1.0}, {"cells_per_axis": 3}, {"broadcast_max_bytes": 0}):
        got = joins.spatial_within_join(pts, zones, ring="rings", **kw)
        assert got.columns == ["id", "longitude", "latitude", "zone"]
        assert sorted(((r["id"], r["zone"]) for r in got.collect()), key=str) == want, kw
    inner = joins.spatial_within_join(pts, zones, ring="rings", how="inner")
    assert sorted((r["id"], r["zone"]) for r in inner.collect()) == sorted(w for w in want if w[1])


def test_repeated_points_stay(spark):
    """The last two points are equal and each keeps its rows, matched or not."""
    pts, zones = frames(spark)
    got = joins.spatial_within_join(pts.drop("id"), zones, ring="rings")
    assert got.count() == len(expected(points()))


def test_a_huge_zone_leaves_other_cells_alone(spark):
    _, zones = frames(spark)
    alone = joins.zone_covering(zones.where("zone <> 'huge'"), "rings")
    both = joins.zone_covering(zones, "rings")
    rows = lambda df: sorted((r["__z_zone"], r["__k"], r["__cx"], r["__cy"], r["__all"]) for r in df.collect())
    assert [r for r in rows(both) if r[0] != "huge"] == rows(alone)
    n = both.groupBy("__z_zone").count().collect()
    assert max(r["count"] for r in n) <= 81 and {r["__z_zone"] for r in n} == {z for z, r in ZONES if r}


def test_cells_carry_their_own_edges(spark):
    """A zone of 4,000 edges: cells inside it carry none, the others a part."""
    t = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = [(float(a), float(b)) for a, b in zip(50 * np.cos(t), 50 * np.sin(t), strict=True)]
    zone = spark.createDataFrame([("disc", [ring])], RINGS)
    rows = joins.zone_covering(zone, "rings").selectExpr("__all", "size(__edges) AS n").collect()
    assert any(r["__all"] for r in rows) and all(r["n"] == 0 for r in rows if r["__all"])
    assert max(r["n"] for r in rows) < 2000


def test_no_zones_and_no_points(spark):
    pts, zones = frames(spark)
    assert joins.spatial_within_join(pts, zones.where("false"), ring="rings").where("zone IS NULL").count() == len(points())
    assert joins.spatial_within_join(pts.where("false"), zones, ring="rings").count() == 0


def test_feature_collection_geometries(spark):
    shapes = [("Polygon", [square(0, 0, 10, 10), square(2, 2, 5, 5)]),
              ("MultiPolygon", [[square(20, 0, 24, 4)], [square(26, 6, 29, 9), square(27, 7, 28, 8)]]),
              ("Point", [1, 2]), (None, None)]
    feats = [{"type": "Feature", "properties": {"n": i}, "geometry": k and {"type": k, "coordinates": c}}
             for i, (k, c) in enumerate(shapes)]
    path = os.path.join(tempfile.mkdtemp(), "z.geojson")
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": feats}, f, indent=1)
    got = {r["properties"]["n"]: r for r in files.read_geojson(spark, path).collect()}
    assert [len(got[str(i)]["rings"] or []) for i in range(4)] == [2, 3, 0, 0]
    assert got["0"]["rings"][1][2]["x"] == 5.0 and got["0"]["ring"] == got["0"]["rings"][0] and got["2"]["ring"] is None


def test_written_collections_read_back(spark):
    src = spark.createDataFrame(
        [("a", "Polygon", [[square(0.0, 0.0, 9.0, 9.0), square(2.0, 2.0, 5.0, 5.0)]], 1),
         ("b", "MultiPolygon", [[square(1.0, 1.0, 2.0, 2.0)], [square(4.0, 4.0, 5.0, 5.0)]], 1),
         ("c", "Polygon", [[square(7.0, 7.0, 8.0, 8.0)]], 2)],
        "zone string, kind string, polygons array<array<array<struct<x:double,y:double>>>>, part int")
    path = os.path.join(tempfile.mkdtemp(), "collections")
    files.feature_collections(src, "kind", "polygons", ["part"]).write.partitionBy("part").text(path)
    got = {r["properties"]["zone"]: [[tuple(p) for p in ring] for ring in r["rings"]]
           for r in files.read_geojson(spark, path).collect()}
    assert got == {"a": [square(0.0, 0.0, 9.0, 9.0), square(2.0, 2.0, 5.0, 5.0)],
                   "b": [square(1.0, 1.0, 2.0, 2.0), square(4.0, 4.0, 5.0, 5.0)], "c": [square(7.0, 7.0, 8.0, 8.0)]}
