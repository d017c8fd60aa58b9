"""Scenario bands, geometry rows, provenance and manifests as files."""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark import fixed, grid

MANIFEST = "manifest.json"

# band, column, nodata, masked over water that was there before
BANDS = (
    ("arrival_time_min", "arrival_min", fixed.FLOAT_NODATA, True),
    ("arrival_band", "band", fixed.INT_NODATA, False),
    ("max_depth_m", "max_depth", fixed.FLOAT_NODATA, False),
    ("max_speed_ms", "max_speed", fixed.FLOAT_NODATA, False),
    ("max_depth_velocity", "max_dv", fixed.FLOAT_NODATA, False),
    ("hazard_rating", "rating", fixed.FLOAT_NODATA, True),
    ("hazard_class_defra", "defra_class", fixed.INT_NODATA, True),
    ("hazard_class_aidr", "aidr_class", fixed.INT_NODATA, True),
    ("dem_valid", "valid", fixed.INT_NODATA, False),
)


def _wide_bands(cells: DataFrame) -> DataFrame:
    was_wet, inside = F.coalesce("initially_wet", F.lit(False)), F.coalesce("domain", F.lit(True))
    cols = []
    for band, column, nodata, masked in BANDS:
        v = F.coalesce(F.col(column).cast("double"), F.lit(float(nodata)))
        if masked:
            v = F.when(was_wet, float(nodata)).otherwise(v)
        cols.append(F.when(inside, v).otherwise(float(nodata)).alias(band))
    return cells.select(*grid.CELL, *cols)


def _long_bands(wide: DataFrame) -> DataFrame:
    return wide.unpivot(list(grid.CELL), [b[0] for b in BANDS], "band", "value")


def scenario_bands(cells: DataFrame) -> DataFrame:
    """Long ``band, value`` rows with each band's nodata rule; ``domain`` false is nodata."""
    return _long_bands(_wide_bands(cells))


def write_bands(cells: DataFrame, path: str) -> None:
    """A folder per band.  Files hold many runs, in order, so their number follows the tasks and not the runs.

    The cells of a block of rows of a run are in one task and move once, before they become a row per band.
    """
    placed = _wide_bands(cells).repartition("run_id", F.floor(F.col("r") / grid.DEFAULT_TILE))
    _long_bands(placed).sortWithinPartitions("band", *grid.CELL).write.mode("overwrite").partitionBy("band").parquet(path)


def feature_rows(df: DataFrame, geometry, *properties: str) -> DataFrame:
    """One GeoJSON feature per row; files of them are newline-delimited."""
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def isochrone_features(features: DataFrame, label) -> DataFrame:
    """One line per ring or part of a ring, with its band, label, area and place in the ring."""
    inner = F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates"))
    outer = F.struct(F.lit("Polygon").alias("type"), F.array("points").alias("coordinates"))
    rows = features.withColumn("band", F.col("cls")).withColumn("label", label)
    names = ("band", "label", "km2", "hole", "ring", "part")
    whole, cut_up = (feature_rows(rows.where(F.col("kind") == k), g, *names) for k, g in (("Polygon", outer), ("LineString", inner)))
    return whole.unionByName(cut_up)


def point_geometry(x, y):
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def attribute_rows(df: DataFrame, names: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows for the one file format with limits: field names up to 10 characters, texts up to 254, names up to 60.

    A longer field name is refused; texts are cut here and nowhere else.
    """
    if long := [c for c in df.columns if len(c) > fixed.FIELD_NAME_LIMIT]:
        raise ValueError(f"field names over {fixed.FIELD_NAME_LIMIT} characters: {', '.join(long)}")
    limit = {c: fixed.NAME_LIMIT if c in names else fixed.TEXT_LIMIT for c in df.columns}
    return df.select(*[F.left(c, F.lit(limit[c])).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def metadata_document(summary: DataFrame, schema_version: int = 1) -> DataFrame:
    """Strict JSON per run with the honesty block at the top level."""
    return summary.select("run_id", F.to_json(F.struct(
        F.lit(schema_version).alias("schema_version"), F.struct(*summary.columns).alias("scenario"),
        F.col("honesty")), {"ignoreNullFields": "false"}).alias("value"))


#: Bytes of a file that a task holds at a time.
BLOCK = 8 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The storage that holds a path or URI, and its name there."""
    if "://" in path and not path.startswith("file:"):
        scheme, rest = path.split("://", 1)
        host, _, tail = rest.partition("/")
        store, top = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        return store, f"{top.rstrip('/')}/{tail}"
    return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)


def file_digest(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file read in blocks, from any storage that Arrow reaches."""
    store, name = _located(path)
    digest = hashlib.sha256()
    with store.open_input_stream(name, buffer_size=0) as stream:
        while part := stream.read(block):
            digest.update(part)
    return digest.hexdigest()


def manifest(spark, root: str) -> DataFrame:
    """Path, bytes and sha256 of every file below ``root``, empty ones too, but the manifest at its top.

    The driver lists names and sizes; tasks hash whole files, a block at a time, whatever their size.
    """
    root = root.rstrip("/")
    store, top = _located(root)
    found = [(f.path.removeprefix(f"{top}/"), f.size) for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file]
    digest = F.pandas_udf(lambda paths: paths.map(lambda p: file_digest(f"{root}/{p}")), "string")
    listed = spark.createDataFrame([f for f in found if f[0] != MANIFEST], "path string, bytes long")
    return listed.repartition("path").select("path", "bytes", digest("path").alias("sha256"))


def hashed(files: DataFrame) -> DataFrame:
    """The same for files that are rows: ``path, length, content``."""
    return files.where(F.col("path") != MANIFEST).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_all(sinks: dict, spark, log_path: str) -> DataFrame:
    """Run independent sinks, which return the rows they wrote; one that fails is recorded and the others still run."""
    rows = []
    for name, write in sinks.items():
        try:
            rows.append((name, True, write(), None))
        except Exception as err:  # noqa: BLE001 - the record of the failure is the result
            rows.append((name, False, None, f"{type(err).__name__}: {err}"))
    log = spark.createDataFrame(rows, "stage string, ok boolean, rows long, error string")
    log.coalesce(1).write.mode("append").parquet(f"{log_path}/{uuid.uuid4().hex}")
    return log
