"""Text, JSON and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodspark.functions import text


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with ``#`` comment lines above a header; names and values are trimmed.

    Columns are found by their names in the header, in any order; a missing one is an error.
    """
    raw = (spark.read.option("header", True).option("comment", "#")
                .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def unite_observations(police: DataFrame, transformers: DataFrame, gauges: DataFrame) -> DataFrame:
    """The three families as one table tagged with their kind."""
    p = police.select(F.col("point").alias("name"), F.col("x_m").alias("x"), F.col("y_m").alias("y"),
                      "ws_obs_m", F.lit("police").alias("kind"))
    t = transformers.select(F.col("transformer").alias("name"), F.col("x_m").alias("x"), F.col("y_m").alias("y"),
                            "at_obs_s", F.lit("transformer").alias("kind"))
    g = gauges.select(F.col("gauge").alias("name"), F.col("x_m").alias("x"), F.col("y_m").alias("y"),
                      F.col("ws_lab_m").alias("ws_obs_m"), F.col("at_lab_s").alias("at_obs_s"),
                      F.lit("gauge").alias("kind"))
    return p.unionByName(t, allowMissingColumns=True).unionByName(g, allowMissingColumns=True)


def grep(docs: DataFrame, pattern: str, context: int, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Matching lines with ``context`` lines around them, whole texts, no exchange."""
    lines = docs.select(key, F.split(F.col(body), "\n").alias("_l"))
    hit = lines.select(key, "_l", F.posexplode("_l").alias("pos", "line")).where(
        F.col("line").rlike(f"(?i){pattern}"))
    first = F.greatest(F.col("pos") - context, F.lit(0))
    return hit.select(key, (F.col("pos") + 1).alias("line_no"), "line",
                      F.array_join(F.slice("_l", first + 1, F.col("pos") + context - first + 1), "\n").alias("context"))


def page_number(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Split at form feeds: one row per page."""
    return docs.select(key, F.posexplode(F.split(F.col(body), "\f")).alias("page", "text")).withColumn(
        "page", F.col("page") + 1)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    doc = F.from_json(F.col(column), f"{schema}, _corrupt STRING",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_d", doc).withColumn("doc", F.when(F.col("_d._corrupt").isNull(), F.col("_d"))).drop("_d")


def path_or(column: Column, *paths: str) -> Column:
    """First non-null value among JSON paths."""
    return F.coalesce(*[F.get_json_object(column, p) for p in paths])


def status_from_metadata(docs: DataFrame, column: str = "meta") -> DataFrame:
    """Scalars of a run read out of its metadata document."""
    m = F.col(column)
    num = lambda *p: path_or(m, *p).cast("double")
    people = num("$.scenario.results.exposure.reported_population")
    return docs.select(
        "run_id", F.lit("done").alias("status"), path_or(m, "$.scenario.study_area").alias("area"),
        num("$.scenario.grid.dx_m").alias("dx_m"), num("$.scenario.run.duration_s").alias("duration_s"),
        path_or(m, "$.generated_utc").alias("finished_utc"), path_or(m, "$.scenario.headline").alias("headline"),
        path_or(m, "$.honesty.presentable_as_fact", "$.scenario.honesty.presentable_as_fact").cast("boolean")
        .alias("presentable"), num("$.scenario.results.peak_depth_m").alias("peak_depth_m"),
        F.coalesce(F.when(people != 0, people), num("$.scenario.results.exposure.total_population"))
        .alias("exposed_people"))


def band_names(column: Column) -> Column:
    """Band labels in the order the document lists them."""
    return F.map_keys(F.from_json(F.get_json_object(column, "$.area_by_arrival_band_km2"), "map<string,double>"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: relative path, size and kind; contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return describe_artifacts(f.select(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("name"),
                                       F.col("length").alias("size_bytes")))


def describe_artifacts(files: DataFrame) -> DataFrame:
    return files.where(~F.col("name").endswith(".tmp")).withColumn("kind", text.artifact_kind(F.col("name")))


def features(extract: DataFrame, west: float, south: float, east: float, north: float, key: str, value: str) -> DataFrame:
    """Map features of an extract by box and tag; columns of mixed type are not part of it."""
    return extract.where(F.col("lon").between(west, east) & F.col("lat").between(south, north)
                         & (F.try_element_at("tags", F.lit(key)) == value))


def last_lines(logs: DataFrame, n: int) -> DataFrame:
    """Last ``n`` lines of each log ``(run_id, line_no, line)``."""
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy(F.col("line_no").desc())
    return logs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
