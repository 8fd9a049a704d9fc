"""Scans: tables, grids, vectors, rasters, payloads, and the bundle of a data set."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import convert
from ..operators.geo import EDGES, check_crs, edges_of
from .hashing import file_hashes

#: Canonical variables and their units.
VARIABLES = {"precip": "mm/day", "tmax": "degC", "tmin": "degC", "rh": "%", "wind": "m/s", "srad": "MJ/m2/day", "pressure": "hPa"}
PRIMARY = ("precip", "tmax", "tmin")
KEY = ("station_id", "date")


def standardised(df: DataFrame, rename: Mapping[str, str] | None = None, units: Mapping[str, str] | None = None) -> DataFrame:
    """Canonical names and types: text station_id, date, double variables without NaN in canonical units."""
    df = df.withColumnsRenamed(dict(rename or {}))
    if "station_id" in df.columns:
        df = df.withColumn("station_id", F.col("station_id").cast("string"))
    if "date" in df.columns:
        df = df.withColumn("date", F.to_date("date"))
    out = {}
    for v in df.columns:
        if v in VARIABLES:
            x: Column = F.expr(f"try_cast(`{v}` AS DOUBLE)")
            x = F.when(~F.isnan(x), x)
            out[v] = convert(v, units[v], x) if units and v in units and units[v] != VARIABLES[v] else x
    return df.withColumns(out) if out else df


def problems(df: DataFrame) -> list[str]:
    """What keeps a table from being observations; empty if nothing does."""
    found = [f"missing column {c}" for c in KEY if c not in df.columns]
    kinds = dict(df.dtypes)
    if "date" in kinds and kinds["date"] not in ("date", "timestamp", "timestamp_ntz"):
        found.append("date is not a date")
    if not any(v in df.columns for v in PRIMARY):
        found.append(f"none of {', '.join(PRIMARY)}")
    return found


def read_tabular(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None, units: Mapping[str, str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV or Parquet table, standardised. CSV columns are text unless a schema is given."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        df = reader.option("header", True).csv(path)
    elif path.rstrip("/").endswith((".parquet", ".pq")):
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported table {path}")
    return standardised(df, rename, units)


def read_gridded(spark: SparkSession, path: str, stations: DataFrame, rename: Mapping[str, str] | None = None, units: Mapping[str, str] | None = None, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """Station series out of a grid stored as Parquet rows (lat, lon, time, variables): nearest latitude and longitude, each by
    itself. A grid's axes are short."""
    grid = spark.read.parquet(path).withColumnsRenamed({lat: "grid_lat", lon: "grid_lon", time: "date"})
    at = stations.select("station_id", "lat", "lon")
    for axis, own in (("grid_lat", "lat"), ("grid_lon", "lon")):
        near = at.select("station_id", own).join(F.broadcast(grid.select(axis).distinct()))
        near = near.groupBy("station_id").agg(F.min_by(axis, F.abs(F.col(own) - F.col(axis))).alias(axis))
        at = at.join(near, "station_id")
    found = grid.join(F.broadcast(at.select("station_id", "grid_lat", "grid_lon")), ["grid_lat", "grid_lon"]).drop("grid_lat", "grid_lon")
    return standardised(found, rename, units)


def read_payload(spark: SparkSession, payload: str, records_key: str | None = None, rename: Mapping[str, str] | None = None, units: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a JSON payload; nested fields become columns with dotted names."""
    data = json.loads(payload)
    for part in (records_key or "").split("."):
        data = data[part] if part else data
    rows = data if isinstance(data, list) else [data]

    def flat(value: Mapping, prefix: str = "") -> dict:
        out = {}
        for k, v in value.items():
            out |= flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": None if v is None else str(v)}
        return out

    flats = [flat(r) for r in rows]
    names = list(dict.fromkeys(k for r in flats for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return standardised(spark.createDataFrame([tuple(r.get(n) for n in names) for r in flats], schema), rename, units)


def read_vector(spark: SparkSession, path: str, attr: str) -> DataFrame:
    """Edges (attr, ord, ring, x1, y1, x2, y2) of a GeoJSON file's polygons (exterior rings) and lines."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return vector_edges(spark, text, attr)


def vector_edges(spark: SparkSession, text: str, attr: str) -> DataFrame:
    data = json.loads(text)
    check_crs(((data.get("crs") or {}).get("properties") or {}).get("name", "EPSG:4326"))
    shapes, lines = [], []
    for ord_, feature in enumerate(data["features"]):
        kind, places = feature["geometry"]["type"], feature["geometry"]["coordinates"]
        name = str(feature["properties"].get(attr))
        if kind == "LineString":
            lines += [(name, ord_, 0, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(places, places[1:], strict=False)]
        else:
            rings = [places[0]] if kind == "Polygon" else [p[0] for p in places]
            shapes.append((name, [[(float(x[0]), float(x[1])) for x in ring] for ring in rings]))
    return spark.createDataFrame(edges_of(shapes) + lines, EDGES)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """(cells, grid) of a raster stored as a folder of Parquet cells and a JSON file of its grid."""
    meta = json.loads(spark.read.text(f"{path}/grid.json", wholetext=True).first()[0])
    check_crs(meta["crs"])
    return spark.read.parquet(f"{path}/cells.parquet"), tuple(meta["grid"])


def raster_from_array(spark: SparkSession, values) -> DataFrame:
    """Cells of a two-dimensional array, row 0 in the north."""
    rows, cols = values.shape
    return spark.createDataFrame([(r, c, float(values[r, c])) for r in range(rows) for c in range(cols)], "row int, col int, value double")


def load_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a data set's folder, Parquet where there is one, else CSV; the optional ones only if they exist."""
    out = {}
    for name, needed in (("observations", True), ("stations", True), ("remote_sensing", False)):
        for suffix in ("parquet", "csv"):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.{suffix}")
            if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                out[name] = read_tabular(spark, f"{root}/{name}.{suffix}")
                break
        else:
            if needed:
                raise FileNotFoundError(f"{root}/{name}")
    return out


__all__ = ["VARIABLES", "file_hashes", "load_bundle", "problems", "raster_from_array", "read_gridded", "read_payload", "read_raster", "read_tabular", "read_vector", "standardised", "vector_edges"]
