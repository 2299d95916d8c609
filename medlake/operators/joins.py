"""Joins: key joins with uniqueness guards, zip/zone lookups, the spatial
point-in-polygon join, SNP lookups and multi-modality fusion (J1-J8).

Broadcast policy: a side is broadcast only after ``bounded_broadcast``
has *proved* it small by counting at most ``max_rows + 1`` of its rows
(the ``limit`` stops the scan early).  Otherwise the join is left to
Catalyst/AQE (sort-merge, skew-split by AQE at runtime).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


class DuplicateKeyError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str] | str, side: str = "input") -> None:
    """V4: fail when a key value repeats.  One aggregation job (partial
    counts map-side); only one offending key is brought back (``limit(1)``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{side}: key {dup[0].asDict()} repeats")


def assert_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """V4 for both sides of a join in ONE job: keys tagged by side, counted
    per (side, key), first repeat returned."""
    tag = (left.select(*keys, F.lit("left").alias("__side"))
           .unionByName(right.select(*keys, F.lit("right").alias("__side"))))
    dup = tag.groupBy("__side", *keys).count().where("count > 1").limit(1).collect()
    if dup:
        d = dup[0].asDict()
        raise DuplicateKeyError(f"{d.pop('__side')}: key {d} repeats")


def key_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner",
             null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y"),
             validate: str | None = None, broadcast_right_rows: int | None = None) -> DataFrame:
    """Equi-join on ``on``.

    * ``null_safe``: NULL keys match NULL keys (the pandas merge behaviour),
      via ``<=>``; default drops NULL keys like SQL.
    * clashing non-key columns are renamed with ``suffixes``.
    * ``validate='one_to_one'`` runs the uniqueness guard on both sides first.
    * ``broadcast_right_rows``: broadcast the right side if proved that small.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if validate == "one_to_one":
        assert_one_to_one(left, right, keys)
    elif validate == "many_to_one":
        assert_unique(right, keys, "right")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    lsel = [F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns]
    left, right = left.select(*lsel), right.select(*rsel)
    if broadcast_right_rows:
        right = bounded_broadcast(right, broadcast_right_rows)
    if not null_safe:
        return left.join(right, keys, how)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how in ("inner", "left", "left_outer"):
        return out.drop(*[f"__r_{k}" for k in keys])
    return out


# ---------------------------------------------------------------------------
# J5 spatial join


#: Bytes of an edge and of the rest of a covering row, for the broadcast bound.
EDGE_BYTES, CELL_ROW_BYTES = 64, 512
DEFAULT_BROADCAST_BYTES = 64 << 20


def _edges(zones: DataFrame, geometry: str) -> Column:
    """All edges of all rings, ``ARRAY<STRUCT<ax,ay,bx,by>>``.  ``geometry`` is
    one ring (array of points) or an array of rings; open rings are closed."""
    one_ring = not isinstance(zones.schema[geometry].dataType.elementType, ArrayType)
    rings = F.array(F.col(geometry)) if one_ring else F.col(geometry)

    def of_ring(r: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            q = F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))
            return F.struct(p["x"].cast("double").alias("ax"), p["y"].cast("double").alias("ay"),
                            q["x"].cast("double").alias("bx"), q["y"].cast("double").alias("by"))
        return F.transform(r, edge)

    whole = F.filter(F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), of_ring)), lambda e: (
        e["ax"].isNotNull() & e["ay"].isNotNull() & e["bx"].isNotNull() & e["by"].isNotNull()))
    return F.coalesce(whole, F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))


def _inside(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd ray casting over ``edges``: holes and separate parts need no
    treatment of their own.  JVM expression, no Python."""
    def crosses(e: Column) -> Column:
        at = F.try_divide((e["bx"] - e["ax"]) * (py - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return ((e["ay"] > py) != (e["by"] > py)) & F.coalesce(px < at, F.lit(False))
    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))


def _on_edge(px: Column, py: Column, edges: Column) -> Column:
    """Collinear with an edge and inside its box."""
    return F.exists(edges, lambda e: (
        (F.abs((e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])) <= 1e-12)
        & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))))


def zone_covering(zones: DataFrame, geometry: str = "ring", cell: float | None = None, cells_per_axis: int = 8
                  ) -> DataFrame:
    """Grid cells that cover each zone, at a level of the zone's own.

    Level ``k`` has cells of side ``unit * 2**k`` (``unit`` is ``cell`` or 1); a
    zone takes the smallest level at which its longer side spans at most
    ``cells_per_axis - 1`` cells, not below 0 if ``cell`` is given.  So a huge zone
    leaves the cells of the others alone, and no zone has more than
    ``(cells_per_axis + 1) ** 2`` rows.  Cells outside the zone are left out; a cell
    that no edge comes near has ``__all`` true and no edges; any other carries just
    the edges that can decide a point of it (those to its right or through it).
    Columns: the zone's but the geometry, as ``__z_<name>``, and ``__k``, ``__cx``,
    ``__cy``, ``__all``, ``__edges``.  A zone without edges (null geometry) has no row.
    """
    unit = float(cell or 1.0)
    z = zones.select(*[F.col(f"`{c}`").alias(f"__z_{c}") for c in zones.columns if c != geometry],
                     _edges(zones, geometry).alias("__e")).where(F.size("__e") > 0)

    def side(a: str, b: str) -> tuple[Column, Column]:
        v = F.concat(F.transform("__e", lambda e: e[a]), F.transform("__e", lambda e: e[b]))
        return F.array_min(v), F.array_max(v)

    (x0, x1), (y0, y1) = side("ax", "bx"), side("ay", "by")
    z = z.select("*", x0.alias("__x0"), x1.alias("__x1"), y0.alias("__y0"), y1.alias("__y1"))
    longer = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    level = F.ceil(F.log2(longer / F.lit(unit * (cells_per_axis - 1))))
    # a point-like zone takes level -40 or the finest allowed
    least = F.lit(0 if cell else -40)
    z = z.withColumn("__k", F.greatest(F.coalesce(F.when(longer > 0, level), least), least).cast("int"))
    s = F.lit(unit) * F.pow(F.lit(2.0), F.col("__k"))
    z = z.withColumn("__s", s)
    for c, lo, hi in (("__cx", "__x0", "__x1"), ("__cy", "__y0", "__y1")):
        z = z.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / F.col("__s")).cast("long"),
                                                 F.floor(F.col(hi) / F.col("__s")).cast("long"))))
    # a margin for the rounding of a point's cell
    m = F.col("__s") * 1e-9
    left, right = F.col("__cx") * F.col("__s") - m, (F.col("__cx") + 1) * F.col("__s") + m
    low, high = F.col("__cy") * F.col("__s") - m, (F.col("__cy") + 1) * F.col("__s") + m
    near = F.filter("__e", lambda e: (F.greatest(e["ay"], e["by"]) >= low) & (F.least(e["ay"], e["by"]) <= high)
                    & (F.greatest(e["ax"], e["bx"]) >= left))
    touched = F.exists("__near", lambda e: F.least(e["ax"], e["bx"]) <= right)
    z = z.withColumn("__near", near).withColumn("__touched", touched)
    centre = _inside((F.col("__cx") + 0.5) * F.col("__s"), (F.col("__cy") + 0.5) * F.col("__s"), F.col("__near"))
    z = z.where(F.col("__touched") | centre)
    return z.select(*[f"__z_{c}" for c in zones.columns if c != geometry], "__k", "__cx", "__cy",
                    (~F.col("__touched")).alias("__all"),
                    F.when(F.col("__touched"), F.col("__near")).otherwise(F.slice("__near", 1, 0)).alias("__edges"))


def spatial_within_join(points: DataFrame, zones: DataFrame, x: str = "longitude", y: str = "latitude",
                        ring: str = "ring", cell: float | None = None, how: str = "left",
                        broadcast_max_bytes: int = DEFAULT_BROADCAST_BYTES,
                        cells_per_axis: int = 8, one_zone_by: tuple[str, str] | None = None) -> DataFrame:
    """``sjoin(points, zones, how, predicate='within')``.

    ``ring`` is a column with one ring (array of points) or an array of rings,
    as ``read_geojson`` gives in ``ring`` and ``rings``: holes and the parts of a
    MultiPolygon count by even-odd over all rings.  Points strictly inside a
    zone match (points on any edge, that of a hole too, do not); overlapping
    zones give one row per zone (or the first zone by ``one_zone_by=(point key,
    zone column)``); with ``how='left'`` unmatched points are kept with NULL
    zone columns.  Null or non-finite coordinates and zones without geometry
    match nothing.  The geometry is not in the result.

    Plan: ``zone_covering`` turns zones into grid cells at levels of their own,
    points take their cell at each level in use, and the two meet on an
    equi-join of (level, cell) -- no cartesian product.  Cells wholly inside a
    zone need no test; the others test only their own edges, as JVM
    expressions.  The covering is broadcast only if its counted rows and edges
    stay under ``broadcast_max_bytes``, else both sides shuffle on the cell (AQE
    splits dense cells).  With one level in use a left join is one outer join;
    with more, points whose coordinates matched nowhere are added by an anti
    join on the coordinates, so ``points`` is read twice and must be
    deterministic.
    """
    zcols = [c for c in zones.columns if c != ring]
    cover = zone_covering(zones, ring, cell, cells_per_axis)
    stat = cover.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__edges")).alias("e"),
                     F.collect_set("__k").alias("ks")).first()
    levels = sorted(stat["ks"]) or [0]  # at most some dozens: powers of two between the zones' sizes
    if stat["n"] * CELL_ROW_BYTES + (stat["e"] or 0) * EDGE_BYTES <= broadcast_max_bytes:
        cover = F.broadcast(cover)
    cover = cover.select(*[f"__z_{c}" for c in zcols], F.col("__k").alias("__zk"), F.col("__cx").alias("__zcx"),
                         F.col("__cy").alias("__zcy"), "__all", "__edges")
    px, py = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    unit = float(cell or 1.0)

    def placed(k: Column) -> list[Column]:
        s = F.lit(unit) * F.pow(F.lit(2.0), k)
        return [F.floor(px / s).cast("long").alias("__cx"), F.floor(py / s).cast("long").alias("__cy")]

    if len(levels) == 1:
        p = points.withColumn("__k", F.lit(levels[0]))
    else:
        p = points.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in levels])))
    p = p.select("*", *placed(F.col("__k")))
    # inside a cell every matching zone gives one row; an outer join whose
    # condition carries the exact test gives one NULL row for no match at all
    cond = ((p["__k"] == cover["__zk"]) & (p["__cx"] == cover["__zcx"]) & (p["__cy"] == cover["__zcy"])
            & (cover["__all"] | (_inside(px, py, cover["__edges"]) & ~_on_edge(px, py, cover["__edges"]))))
    outer = how != "inner"
    joined = p.join(cover, cond, "left" if outer and len(levels) == 1 else "inner")
    out = joined.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"`__z_{c}`").alias(c) for c in zcols])
    if outer and len(levels) > 1:
        met = joined.select(px.alias("__mx"), py.alias("__my")).distinct()
        rest = points.join(met, (px == F.col("__mx")) & (py == F.col("__my")), "left_anti")
        types = {f.name: f.dataType for f in zones.schema.fields}
        out = out.union(rest.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in zcols]))
    if one_zone_by:
        # keep one zone per point where zones overlap: (point key, zone column
        # ordering them) -- a top-1 per point, limited before the shuffle
        pk, zc = one_zone_by
        from pyspark.sql import Window
        w = Window.partitionBy(pk).orderBy(F.col(zc).asc_nulls_last())
        out = out.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")
    return out


# ---------------------------------------------------------------------------
# J7/J8 fusion


def fuse_modalities(frames: dict[str, DataFrame], key: str = "patient_id") -> DataFrame:
    """Full outer join of per-modality feature frames on ``key`` plus a
    ``has_<modality>`` presence flag per frame.  Each join shuffles on the
    key once; AQE coalesces the partitions."""
    out = None
    for name, df in frames.items():
        f = df.withColumn(f"has_{name}", F.lit(True))
        out = f if out is None else out.join(f, key, "full_outer")
    return out.fillna(False, subset=[f"has_{n}" for n in frames])


def build_profile(base: DataFrame, parts: dict[str, DataFrame], key: str = "patient_id") -> DataFrame:
    """Left joins of part frames onto ``base``, each folded into one
    struct column named after the part."""
    out = base
    for name, df in parts.items():
        cols = [c for c in df.columns if c != key]
        out = out.join(df.select(key, F.struct(*cols).alias(name)), key, "left")
    return out
