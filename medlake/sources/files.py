"""File sources and sinks.

Readers take an explicit schema (no inference pass over the data) and
keep malformed rows visible; writers use Spark's partitioned writers so
no file is funnelled through one task unless the format demands it
(a single GeoJSON document, a tiny report).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


# ---------------------------------------------------------------- S1 / S2 / S3 readers

def read_csv(spark: SparkSession, path: str, schema: StructType | str, date_cols: Sequence[str] = (),
             date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Header CSV with an explicit schema; malformed rows are kept with
    NULL fields and the raw line in ``_corrupt_record`` (PERMISSIVE)."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if CORRUPT not in st.fieldNames():
        st = st.add(CORRUPT, "string")
    df = (spark.read.schema(st).option("header", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    for c in date_cols:
        df = df.withColumn(c, F.to_date(F.col(c).cast("string"), date_format))
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = True
              ) -> DataFrame:
    """JSON lines (one object per line, splittable) or one JSON array
    document (``lines=False``: multiLine, one task per file)."""
    r = spark.read.option("multiLine", not lines)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# coordinates stay text until the geometry's type is known: their depth depends on it
_FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
_GEOJSON_SCHEMA = f"type string, features array<struct<{_FEATURE}>>"


def _rings(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon, ARRAY<ARRAY<STRUCT<x,y>>>; NULL
    for any other type."""
    text, kind = geometry["coordinates"], geometry["type"]
    polygon = F.from_json(text, "array<array<array<double>>>")
    parts = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    coords = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", parts)
    return F.transform(coords, lambda r: F.transform(r, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def read_geojson(spark: SparkSession, path: str, seq: bool = False) -> DataFrame:
    """S3: GeoJSON polygons -> one row per feature with its properties
    (strings), ``ring ARRAY<STRUCT<x,y>>`` (the first ring) and ``rings``, all
    rings of the Polygon or MultiPolygon: outer ones and holes alike, told
    apart by even-odd (``joins.spatial_within_join``).  Coordinates are read as
    double even when written as integers; heights are ignored; other
    geometries and null ones have NULL rings.  ``seq=True`` reads GeoJSONSeq /
    one feature per line (splittable -- the scalable layout); a
    FeatureCollection document is one JSON value and parses in one task."""
    if seq:
        f = spark.read.schema(_FEATURE).json(path).select(F.struct("*").alias("f"))
    else:
        doc = spark.read.schema(_GEOJSON_SCHEMA).option("multiLine", True).json(path)
        f = doc.select(F.explode("features").alias("f"))
    rings = f.select(F.col("f.properties").alias("properties"), _rings(F.col("f.geometry")).alias("rings"))
    return rings.select("properties", F.get("rings", F.lit(0)).alias("ring"), "rings")


def feature_collections(zones: DataFrame, geometry: str, rings: str, parts: Sequence[str]) -> DataFrame:
    """One FeatureCollection document (column ``value``) for each value of
    ``parts``: ``geometry`` names the column with the type, ``rings`` the one with
    ``ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>`` (polygons of rings); the others become
    properties.  A document is one value, so ``parts`` must keep it small."""
    props = [c for c in zones.columns if c not in (geometry, rings, *parts)]
    xy = F.transform(rings, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    # a Polygon has one level less than a MultiPolygon
    coords = F.when(F.col(geometry) == "Polygon", F.to_json(F.get(xy, F.lit(0)))).otherwise(F.to_json(xy))
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in props]))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'),
                       F.col(geometry), F.lit('","coordinates":'), coords, F.lit("}}"))
    return zones.groupBy(*parts).agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list(feature)), F.lit("]}")).alias("value"))


# ---------------------------------------------------------------- writers

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write with Spark's parallel writer (one file per task)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """sha256 over the row's values in sorted column order ('\\N' for
    NULL, '\\u0001' between fields)."""
    cols = sorted(cols or df.columns)
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def snapshot_digest(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """An order-independent snapshot fingerprint: row count and the xor
    of 60-bit prefixes of the row hashes (a partial aggregate: no row list
    is ever gathered)."""
    h = F.conv(F.substring(row_hash(df, cols), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("digest"))


def land_snapshot(df: DataFrame, root: str, snapshot_date: str) -> str:
    """Land one snapshot as parquet under ``snapshot_date=...``
    (re-landing the same date replaces that partition only)."""
    path = os.path.join(root, f"snapshot_date={snapshot_date}")
    df.withColumn("_row_hash", row_hash(df)).write.mode("overwrite").parquet(path)
    return path


def snapshot_delta(old: DataFrame, new: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None
                   ) -> DataFrame:
    """S5 incremental load: (key, change) with change in inserted /
    deleted / updated, by a full outer join on the key comparing row hashes."""
    keys = [key] if isinstance(key, str) else list(key)
    o = old.select(*keys, row_hash(old, cols).alias("h_old"))
    n = new.select(*keys, row_hash(new, cols).alias("h_new"))
    j = o.join(n, keys, "full_outer")
    ch = (F.when(F.col("h_old").isNull(), "inserted").when(F.col("h_new").isNull(), "deleted")
          .when(F.col("h_old") != F.col("h_new"), "updated"))
    return j.select(*keys, ch.alias("change")).where(F.col("change").isNotNull())


def append_prediction_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to the prediction log, partitioned by day."""
    df.withColumn("day", F.to_date(F.col(ts))).write.mode("append").partitionBy("day").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report frame (a handful of rows) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def export_tables(spark: SparkSession, tables: dict[str, DataFrame], selected: Sequence[str], fmt: str, root: str
                  ) -> list[str]:
    """Write each selected (and known) table in the chosen format."""
    allowed = {"parquet", "csv", "json", "orc"}
    if fmt not in allowed:
        raise ValueError(f"format must be one of {sorted(allowed)}")
    out = []
    for name in selected:
        if name not in tables:
            raise KeyError(name)
        p = os.path.join(root, name)
        write_table(tables[name], p, fmt)
        out.append(p)
    return out


def standardize(raw: DataFrame, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Map external records to the house schema with a mapping table of
    (target name, source expression, target type); a value that does not
    convert becomes NULL (``try_cast``)."""
    return raw.select(*[F.expr(src).try_cast(typ).alias(tgt) for tgt, src, typ in mapping])


def risk_resources(df: DataFrame, key: str, fields: Sequence[str], resource_type: str = "RiskAssessment"
                   ) -> DataFrame:
    """One JSON document per patient (NDJSON when written as text)."""
    return df.select(key, F.to_json(F.struct(F.lit(resource_type).alias("resourceType"),
                                             F.col(key).alias("subject"), *[F.col(f) for f in fields])).alias("json"))
