"""The star-schema and event tables read as flood-domain tables.

Each view is one projection or grouping in SQL that any engine reads the same way;
``{name}`` stands for a table.  Elevations are binary fractions, so they are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DX = 90.0
NY = NX = 64
TRANSFORM = [DX, 0.0, 0.0, 0.0, -DX, NY * DX]
INITIAL_ROWS = 4
DEM_ROWS, DEM_COLS = 300, 50

VIEWS = {
    # simulator output: one row per run, cell and frame; ten suppliers make a run
    "frames": """
        SELECT CAST(floor(l_suppkey / 10.0) AS INT) AS run_id, CAST(l_orderkey % 64 AS INT) AS r,
               CAST(l_partkey % 64 AS INT) AS c,
               CAST(l_linenumber * 1100 - 800 AS DOUBLE) + l_quantity * CAST(10 AS DOUBLE) AS t_s,
               greatest(CAST(0 AS DOUBLE), (l_quantity - CAST(10 AS DOUBLE)) / CAST(8 AS DOUBLE)) AS h,
               greatest(CAST(0 AS DOUBLE), (l_quantity - CAST(10 AS DOUBLE)) / CAST(8 AS DOUBLE))
                 * l_discount * CAST(40 AS DOUBLE) AS hu,
               greatest(CAST(0 AS DOUBLE), (l_quantity - CAST(10 AS DOUBLE)) / CAST(8 AS DOUBLE))
                 * l_tax * CAST(25 AS DOUBLE) AS hv
        FROM {lineitem}""",
    # terrain: 300 x 50 cells per grid, a valley with bumps and voids
    "dem": """
        SELECT CAST(floor(o_orderkey / 15000.0) AS INT) AS run_id,
               CAST(floor((o_orderkey % 15000) / 50.0) AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c,
               CAST(1000 AS DOUBLE) - CAST(0.0625 AS DOUBLE) * CAST(floor((o_orderkey % 15000) / 50.0) AS DOUBLE)
                 + CAST(5 * abs(o_orderkey % 50 - 25) AS DOUBLE)
                 + CAST(CAST(floor(o_totalprice) AS BIGINT) % 7 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS z,
               CAST(floor(o_totalprice) AS BIGINT) % 211 <> 0 AS valid
        FROM {orders}""",
    # people on the 64 x 64 grid shared by the runs
    "pop": """
        SELECT CAST(c_custkey % 64 AS INT) AS r, CAST(floor(c_custkey / 64.0) AS BIGINT) % 64 AS c_,
               CAST(sum(10 + c_nationkey) AS DOUBLE) AS pop
        FROM {customer} GROUP BY 1, 2""",
    "poi": """
        SELECT CAST(floor(s_suppkey / 10.0) AS INT) AS run_id, CAST(s_suppkey AS INT) AS poi_id,
               CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE s_name END AS name,
               CAST(s_suppkey * 37 % 70 AS DOUBLE) * CAST(90 AS DOUBLE) + CAST(45 AS DOUBLE) AS x,
               CAST(5760 AS DOUBLE) - CAST(s_suppkey * 53 % 70 AS DOUBLE) * CAST(90 AS DOUBLE) - CAST(45 AS DOUBLE) AS y,
               CAST(floor(abs(s_acctbal)) AS BIGINT) AS population
        FROM {supplier}""",
    "buildings": """
        SELECT CAST(floor(p_partkey / 200.0) AS INT) AS run_id, CAST(p_partkey AS BIGINT) AS building_id,
               CAST(p_partkey % 64 AS INT) AS r, CAST(p_partkey * 7 % 61 AS INT) AS c,
               CASE p_size % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'industrial' END AS curve
        FROM {part}""",
    # land-cover pixels, 150 across, three to a terrain cell
    "landcover": """
        SELECT CAST(floor(o_orderkey / 15000.0) AS INT) AS run_id,
               CAST(floor((o_orderkey % 15000) / 150.0) AS INT) AS fr, CAST(o_orderkey % 150 AS INT) AS fc,
               CAST(CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 13 <= 10
                    THEN CAST(floor(o_totalprice) AS BIGINT) % 13 * 10
                    WHEN CAST(floor(o_totalprice) AS BIGINT) % 13 = 11 THEN 95 ELSE 37 END AS INT) AS cls
        FROM {orders}""",
    # population counts on a coarser raster (four terrain cells to a pixel side)
    "counts": """
        SELECT CAST(floor(o_orderkey / 15000.0) AS INT) AS run_id,
               CAST(floor(floor((o_orderkey % 15000) / 50.0) / 4.0) AS INT) AS sr,
               CAST(floor((o_orderkey % 50) / 4.0) AS INT) AS sc,
               CAST(sum(CAST(floor(o_totalprice) AS BIGINT) % 101 - 5) AS DOUBLE) AS cnt
        FROM {orders} GROUP BY 1, 2, 3""",
    "hydrographs": """
        SELECT CAST(floor(user_id / 15.0) AS INT) AS run_id, event_type AS label,
               CAST((day(ts) - 1) * 24 + hour(ts) AS DOUBLE) * CAST(3600 AS DOUBLE) AS t_s,
               sum(value) AS q
        FROM {events} GROUP BY 1, 2, 3""",
    "sar_px": """
        SELECT event_id, CAST(0 AS INT) AS run_id, CAST(floor(user_id / 15.0) AS INT) AS r, CAST(user_id % 15 AS INT) AS c,
               CAST(ts AS DATE) AS acq_date, event_type AS orbit,
               CASE WHEN event_id % 10 = 0 THEN 'EW' ELSE 'IW' END AS mode,
               CASE WHEN event_id % 7 = 0 THEN 'HH' ELSE 'VV,VH' END AS pols,
               CAST(-5 AS DOUBLE) - value / CAST(25 AS DOUBLE) AS db
        FROM {events}""",
    "occurrence": """
        SELECT CAST(0 AS INT) AS run_id, CAST(floor(user_id / 15.0) AS INT) AS r, CAST(user_id % 15 AS INT) AS c,
               CAST(max(event_id % 73) AS INT) AS occurrence
        FROM {events} WHERE event_type = 'view' GROUP BY 1, 2, 3""",
    # status reports of runs, several per run
    "status_events": """
        SELECT CAST(o_custkey AS STRING) AS run_id, o_orderkey AS seq, o_orderdate AS updated_at,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS peak,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('run ', CAST(o_orderkey AS STRING)) END AS headline
        FROM {orders}""",
    "sources": """
        SELECT CONCAT('area', CAST(doc_id % 7 AS STRING), CASE doc_id % 3 WHEN 0 THEN '.dam' WHEN 1 THEN '.breach'
                      ELSE '.blockage' END, '.f', CAST(doc_id AS STRING)) AS key,
               CONCAT('document ', CAST(doc_id AS STRING)) AS citation, quality = 1 AS verified,
               CASE WHEN toxic = 1 THEN 'second-hand' ELSE '' END AS note
        FROM {labels}""",
    "observations": """
        SELECT CAST(floor(s_suppkey / 10.0) AS INT) AS run_id, s_name AS name,
               CASE s_suppkey % 10 WHEN 7 THEN 'A' WHEN 8 THEN 'B' WHEN 9 THEN 'C' END AS label,
               CASE WHEN s_suppkey % 10 < 4 THEN 'police' WHEN s_suppkey % 10 < 7 THEN 'gauge'
                    ELSE 'transformer' END AS kind,
               CAST(s_suppkey * 41 % 60 AS DOUBLE) * CAST(20 AS DOUBLE) + CAST(3 AS DOUBLE) AS x,
               CAST(s_suppkey * 29 % 45 AS DOUBLE) * CAST(20 AS DOUBLE) + CAST(7 AS DOUBLE) AS y,
               CASE WHEN s_suppkey % 10 < 7 THEN CAST(1050 AS DOUBLE) + CAST(s_suppkey % 13 AS DOUBLE) END AS ws_obs_m,
               CASE WHEN s_suppkey % 10 >= 4 THEN CAST(s_suppkey * 17 % 4000 AS DOUBLE) END AS at_obs_s
        FROM {supplier}""",
    "particles": """
        SELECT CAST(floor(l_suppkey / 10.0) AS INT) AS run_id, CAST(l_linenumber AS DOUBLE) AS t_s,
               l_quantity / CAST(8 AS DOUBLE) AS x, l_tax * CAST(8 AS DOUBLE) AS z,
               l_discount * CAST(10 AS DOUBLE) AS u, CAST(l_partkey % 8 + 1 AS DOUBLE) / CAST(4 AS DOUBLE) AS m,
               CAST(1000 AS DOUBLE) AS rho, l_returnflag <> 'R' AS fluid
        FROM {lineitem}""",
    "face_frames": """
        SELECT l_partkey AS face_id, CAST(l_linenumber AS DOUBLE) AS t_s, l_quantity AS depth,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity + l_tax END AS wl
        FROM {lineitem}""",
    "roads": """
        SELECT CAST(floor(s_suppkey / 10.0) AS INT) AS run_id, CAST(s_suppkey AS BIGINT) AS feature_id,
               CAST(s_suppkey * 31 % 60 AS DOUBLE) * CAST(90 AS DOUBLE) + CAST(30 AS DOUBLE) AS xa,
               CAST(s_suppkey * 17 % 60 AS DOUBLE) * CAST(90 AS DOUBLE) + CAST(50 AS DOUBLE) AS ya,
               CAST(s_suppkey * 13 % 60 AS DOUBLE) * CAST(90 AS DOUBLE) + CAST(70 AS DOUBLE) AS xb,
               CAST(s_suppkey * 17 % 60 AS DOUBLE) * CAST(90 AS DOUBLE) + CAST(50 AS DOUBLE) AS yb
        FROM {supplier}""",
    # one breach specification per part
    "breaches": """
        SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS s, p_retailprice AS price,
               CASE p_partkey % 3 WHEN 0 THEN 'instant' WHEN 1 THEN 'linear' ELSE 'erosion' END AS mode,
               CAST(p_partkey % 97 AS DOUBLE) AS a, CAST(p_partkey % 11 AS DOUBLE) AS b
        FROM {part}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Paths(dict):
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def __missing__(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _typed(spark.sql(VIEWS[name].format_map(_Paths(sf_dir))), name)


def _typed(df: DataFrame, name: str) -> DataFrame:
    if name == "pop":
        df = df.select("r", F.col("c_").cast("int").alias("c"), "pop")
    if name == "sar_px":
        df = df.withColumn("pol", F.split("pols", ",")).drop("pols")
    return df


def stream_view(spark: SparkSession, sf_dir: str, name: str, view_name: str) -> DataFrame:
    """A table read as a stream of files, through the same view as the batch side."""
    src = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")
    src.createOrReplaceTempView(f"stream_{name}")
    return _typed(spark.sql(VIEWS[view_name].format_map({name: f"stream_{name}"})), view_name)


def setup_columns(cells: DataFrame) -> DataFrame:
    """Adds ``initially_wet``: the lake fills the first rows of every run."""
    return cells.withColumn("initially_wet", F.col("r") < INITIAL_ROWS)
