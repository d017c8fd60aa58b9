"""Catalogues, the run registry, text and JSON documents, tiles, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark import fixed
from floodspark.functions import text as ft
from floodspark.operators import sampling
from floodspark.plans import registry as reg
from floodspark.queries.base import query, rounded
from floodspark.session import scratch_path
from floodspark.sinks import bands
from floodspark.sources import catalog, documents, tiles
from floodspark.sources.tables import DX, stream_view, table, view
from floodspark.streaming import frames as st

# --- tables the registry queries share -------------------------------------------------------


def _boxes(s, d):
    n = table(s, d, "customer")
    w = (F.col("c_custkey") % 300 - 150).cast("double")
    sth = (F.col("c_custkey") % 140 - 70).cast("double")
    east = w + F.when(F.col("c_custkey") % 2 == 0, 2.0).otherwise(1.5)
    north = sth + F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(2.25)
    return n.select(F.col("c_custkey").alias("box_id"), w.alias("west"), sth.alias("south"), east.alias("east"), north.alias("north"))


_BOX = """(SELECT c_custkey AS box_id, CAST(c_custkey % 300 - 150 AS DOUBLE) AS west, CAST(c_custkey % 140 - 70 AS DOUBLE) AS south,
    c_custkey % 300 - 150 + CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 1.5 END AS east,
    c_custkey % 140 - 70 + CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 2.25 END AS north FROM customer)"""


@query("src3_elevation_tiles", "SRC3", f"""
    SELECT box_id, lat, lon, 'Copernicus_DSM_COG_10_' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || '_00_'
      || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_00_DEM' AS tile
    FROM (SELECT box_id, CAST(floor(south) AS INT) + a.i AS lat, CAST(floor(west) AS INT) + b.j AS lon, north, east FROM {_BOX}, unnest(range(4)) AS a(i), unnest(range(4)) AS b(j))
    WHERE lat < north AND lon < east""")
def _(s, d):
    return tiles.elevation_tiles(_boxes(s, d))


@query("src4_landcover_tiles", "SRC4", f"""
    SELECT box_id, lat, lon, 'ESA_WorldCover_10m_2021_v200_' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0')
      || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_Map' AS tile
    FROM (SELECT box_id, CAST(floor(south / 3) * 3 AS INT) + a.i * 3 AS lat, CAST(floor(west / 3) * 3 AS INT) + b.j * 3 AS lon, north, east
          FROM {_BOX}, unnest(range(3)) AS a(i), unnest(range(3)) AS b(j))
    WHERE lat < north - 0.000000001 AND lon < east - 0.000000001""")
def _(s, d):
    return tiles.landcover_tiles(_boxes(s, d))


@query("agg33_bounding_boxes", "AGG33", """
    SELECT run_id AS box_id, floor((min(x) - 500) / 90) * 90 AS xmin, floor((min(y) - 500) / 90) * 90 AS ymin,
           ceil((max(x) + 500) / 90) * 90 AS xmax, ceil((max(y) + 500) / 90) * 90 AS ymax FROM poi GROUP BY run_id""", ("poi",))
def _(s, d):
    return tiles.metric_extent(view(s, d, "poi").withColumnRenamed("run_id", "box_id"), DX, 0.5)


@query("agg33_geographic_box", "AGG33", """
    SELECT run_id AS box_id, round(min(lon) - 5 / (111.32 * greatest(0.2, cos(radians((min(lat) + max(lat)) * 0.5)))), 6) AS west, round(min(lat) - 5 / 111.32, 6) AS south,
           round(max(lon) + 5 / (111.32 * greatest(0.2, cos(radians((min(lat) + max(lat)) * 0.5)))), 6) AS east, round(max(lat) + 5 / 111.32, 6) AS north
    FROM (SELECT run_id, 78 + x / 100000 AS lon, 30 + y / 110000 AS lat FROM poi) GROUP BY run_id""", ("poi",))
def _(s, d):
    p = view(s, d, "poi").select(F.col("run_id").alias("box_id"), (78 + F.col("x") / 100000).alias("lon"), (30 + F.col("y") / 110000).alias("lat"))
    return rounded(tiles.box_around(p, 5.0))


@query("prj8_points_in_domain", "PRJ8", """
    SELECT poi_id, x BETWEEN 300 AND 5000 AND y BETWEEN 300 + run_id * 10 AND 5000 AS inside FROM poi""", ("poi",))
def _(s, d):
    p = view(s, d, "poi").withColumnRenamed("run_id", "box_id")
    b = p.select("box_id").distinct().select("box_id", F.lit(300.0).alias("xmin"), (300.0 + F.col("box_id") * 10).alias("ymin"),
                                             F.lit(5000.0).alias("xmax"), F.lit(5000.0).alias("ymax"))
    return tiles.contains(p, b).select("poi_id", "inside")


# --- sources and study areas ---------------------------------------------------------------------

@query("prj11_unverified_sources", "PRJ11 STR9", """
    SELECT key, '[UNVERIFIED] ' || citation || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END AS text
    FROM sources WHERE NOT verified AND starts_with(key, 'area3')""", ("sources",))
def _(s, d):
    u = catalog.unverified(view(s, d, "sources"), "area3")
    return u.select("key", ft.source_text(F.col("verified"), F.col("citation"), F.col("note")).alias("text"))


@query("prj12_unverified_specs", "PRJ12", """
    SELECT area, upper(left(owner, 1)) || substr(owner, 2) || '.' || field || ': ' || citation AS text
    FROM (SELECT 'area' || (doc_id % 7) AS area, CASE doc_id % 3 WHEN 0 THEN 'dam' WHEN 1 THEN 'breach' ELSE 'blockage' END AS owner, 'f' || doc_id AS field FROM documents) s
    JOIN (SELECT key, citation FROM sources WHERE NOT verified) q ON q.key = s.area || '.' || s.owner || '.' || s.field""", ("sources",))
def _(s, d):
    t = table(s, d, "documents")
    owner = F.when(F.col("doc_id") % 3 == 0, "dam").when(F.col("doc_id") % 3 == 1, "breach").otherwise("blockage")
    specs = t.select(F.concat(F.lit("area"), F.col("doc_id") % 7).alias("area"), owner.alias("owner"), F.concat(F.lit("f"), "doc_id").alias("field"))
    return catalog.unverified_specs(specs, view(s, d, "sources"))


def _areas(s, d):
    n = table(s, d, "customer")
    return n.select(F.concat(F.lit("area"), "c_custkey").alias("key"), F.col("c_name").alias("title"),
                    (F.col("c_nationkey") * 900.0 + 9000).alias("width_m"), (F.col("c_custkey") % 50 * 90.0 + 9000).alias("height_m"),
                    F.lit(90.0).alias("dx_fast"), F.lit(30.0).alias("dx_fine"), F.when(F.col("c_custkey") % 4 > 0, 90.0).otherwise(5.0).alias("dx_default"),
                    F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_mktsegment").alias("river"), F.lit(30.5).alias("lat"), F.lit(78.5).alias("lon"))).alias("dam"),
                    F.when(F.col("c_custkey") % 2 == 1, F.struct(F.lit("upper").alias("river"), F.lit(30.0).alias("lat"), F.lit(79.0).alias("lon"))).alias("blockage"))


@query("agg40_provenance_report", "AGG40", """
    SELECT 'area' || c_custkey AS key, (c_nationkey * 900.0 + 9000) / 1000 AS width_km, (c_custkey % 50 * 90.0 + 9000) / 1000 AS height_km,
           CAST(round_even((c_nationkey * 900.0 + 9000) / 90, 0) * round_even((c_custkey % 50 * 90.0 + 9000) / 90, 0) AS BIGINT) AS cells_fast,
           CAST(round_even((c_nationkey * 900.0 + 9000) / 30, 0) * round_even((c_custkey % 50 * 90.0 + 9000) / 30, 0) AS BIGINT) AS cells_fine,
           coalesce(pending, 0) AS pending, coalesce(keys, 'all registered quantities verified') AS keys
    FROM customer LEFT JOIN (SELECT split_part(key, '.', 1) AS area, count(*) AS pending, string_agg(key, '; ' ORDER BY key) AS keys FROM sources WHERE NOT verified GROUP BY 1) p
      ON p.area = 'area' || c_custkey""", ("sources",))
def _(s, d):
    return catalog.provenance(_areas(s, d), view(s, d, "sources"))


@query("prj15_study_info", "PRJ15 SRC15", """
    SELECT 'area' || c_custkey AS key, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'upper' END AS river,
           CASE WHEN c_custkey % 2 = 0 THEN 30.5 ELSE 30.0 END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 78.5 ELSE 79.0 END AS lon,
           CASE WHEN c_custkey % 2 = 0 THEN '{"river":"' || c_mktsegment || '","lat":30.5,"lon":78.5}' END AS dam,
           CASE WHEN c_custkey % 2 = 1 THEN '{"river":"upper","lat":30.0,"lon":79.0}' END AS blockage FROM customer""")
def _(s, d):
    return catalog.study_info(_areas(s, d))


@query("src15_area_lookup", "SRC15", "SELECT 'area7' AS key, c_name AS title FROM customer WHERE c_custkey = 7")
def _(s, d):
    return catalog.lookup(_areas(s, d), "area7").select("key", "title")


@query("prj9_request_validation", "PRJ9", """
    SELECT o_orderkey AS request, CASE WHEN c_custkey IS NULL THEN 'unknown study area area' || (o_custkey + o_orderkey % 2 * 100000000)
             WHEN NOT o_totalprice / 10000 BETWEEN 0.01 AND 48 THEN 'duration out of range'
             WHEN NOT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1200 * 1.0 WHEN c_custkey % 4 > 0 THEN 90 ELSE 5 END BETWEEN 10 AND 1000 THEN 'dx out of range' END AS reason
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 2 * 100000000""")
def _(s, d):
    o = table(s, d, "orders")
    area = F.concat(F.lit("area"), F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000000)
    r = o.select(F.col("o_orderkey").alias("request"), area.alias("area"), (F.col("o_totalprice") / 10000).alias("hours"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1200 * 1.0).alias("dx"))
    return catalog.validate_requests(r, _areas(s, d)).select("request", "reason")


# --- run registry ------------------------------------------------------------------------------------

_LATEST = """SELECT run_id, seq, updated_at, status, peak, headline FROM status_events
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) = 1"""


def _latest(s, d):
    return reg.latest(view(s, d, "status_events"))


@query("snk5_latest_status", "SNK5 WIN11", _LATEST, ("status_events",))
def _(s, d):
    return _latest(s, d)


def _split(s, d):
    lt = _latest(s, d)
    return lt.where("peak IS NOT NULL"), lt.where("headline IS NOT NULL")


@query("jn13_local_and_remote_runs", "JN13 SET2", f"""
    SELECT run_id, status, CASE WHEN peak IS NOT NULL THEN 'local' ELSE 'remote' END AS source FROM ({_LATEST})
    WHERE peak IS NOT NULL OR headline IS NOT NULL""", ("status_events",))
def _(s, d):
    return reg.merge_remote(*_split(s, d)).select("run_id", "status", "source")


@query("jn19_delete_runs", "JN19", f"""
    SELECT run_id, status FROM ({_LATEST}) WHERE NOT (peak > 200000 AND status NOT IN ('queued', 'running')) OR peak IS NULL""", ("status_events",))
def _(s, d):
    lt = _latest(s, d)
    return reg.delete(lt, lt.where("peak > 200000")).select("run_id", "status")


@query("jn19_run_lookup", "JN19 JN13", f"SELECT run_id, status FROM ({_LATEST}) WHERE run_id = '12' AND (peak IS NOT NULL OR headline IS NOT NULL)", ("status_events",))
def _(s, d):
    return reg.merge_remote(*_split(s, d)).where("run_id = '12'").select("run_id", "status")


def _meta(s, d):
    """One metadata document per finished run, as JSON text."""
    lt = _latest(s, d)
    doc = F.to_json(F.struct(
        F.lit("2026-01-01T00:00:00Z").alias("generated_utc"),
        F.struct(F.lit("a").alias("study_area"), F.concat(F.lit("doc "), "run_id").alias("headline"),
                 F.struct(F.lit(90.0).alias("dx_m")).alias("grid"), F.struct(F.lit(3600.0).alias("duration_s")).alias("run"),
                 F.struct((F.col("seq") * 1.0).alias("peak_depth_m"), F.struct((F.col("seq") % 2).alias("reported_population"),
                                                                              F.lit(7).alias("total_population")).alias("exposure")).alias("results")).alias("scenario"),
        F.struct((F.col("seq") % 2 == 0).alias("presentable_as_fact")).alias("honesty")))
    return lt.where("status <> 'queued'").select("run_id", doc.alias("meta"))


@query("js1_status_from_metadata", "JS1 SRC10", f"""
    SELECT run_id, 'doc ' || run_id AS headline, seq % 2 = 0 AS presentable, CAST(seq AS DOUBLE) AS peak_depth_m,
           CASE WHEN seq % 2 <> 0 THEN 1.0 ELSE 7.0 END AS exposed_people FROM ({_LATEST}) WHERE status <> 'queued'""", ("status_events",))
def _(s, d):
    return documents.status_from_metadata(_meta(s, d)).select("run_id", "headline", "presentable", "peak_depth_m", "exposed_people")


@query("jn17_metadata_backfill", "JN17", f"""
    SELECT run_id, status, CASE WHEN status = 'done' THEN coalesce(headline, 'doc ' || run_id) ELSE headline END AS headline,
           CASE WHEN status = 'done' THEN coalesce(peak, seq) ELSE peak END AS peak_depth_m, status <> 'queued' AS has_bundle FROM ({_LATEST})""", ("status_events",))
def _(s, d):
    lt = _latest(s, d).withColumnRenamed("peak", "peak_depth_m")
    return reg.backfill(lt, documents.status_from_metadata(_meta(s, d)), ["headline", "peak_depth_m"]).select(
        "run_id", "status", "headline", "peak_depth_m", "has_bundle")


@query("js2_band_names", "JS2", f"""
    SELECT run_id, '0-' || (seq + 1) || ' min|' || (seq + 1) || '-' || (2 * seq + 2) || ' min|>' || (2 * seq + 2) || ' min' AS labels
    FROM ({_LATEST})""", ("status_events",))
def _(s, d):
    a, b = (F.col("seq") + 1).cast("int"), (F.col("seq") * 2 + 2).cast("int")
    j = F.format_string('{"run": %d, "area_by_arrival_band_km2": {"0-%d min": 1.5, "%d-%d min": 0.25, ">%d min": 0}}', F.col("run_id").cast("int"), a, a, b, b)
    return _latest(s, d).select("run_id", F.array_join(documents.band_names(j), "|").alias("labels"))


@query("src10_json_permissive", "SRC10", """
    SELECT conv_id, turn, turn % 3 <> 1 AS parsed FROM conversations""")
def _(s, d):
    c = table(s, d, "conversations")
    raw = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"status": '), F.col("turn").cast("string"))).otherwise(
        F.concat(F.lit('{"status": "'), F.col("role"), F.lit('"}')))
    p = documents.parse_json(c.withColumn("raw", raw), "raw", "status STRING")
    return p.select("conv_id", "turn", F.col("doc").isNotNull().alias("parsed"))


@query("top3_runs_newest_first", "TOP3", f"""
    SELECT run_id, CAST(coalesce(CASE WHEN status = 'done' THEN updated_at END, updated_at - INTERVAL 1 DAY) AS DATE) AS t FROM ({_LATEST})""", ("status_events",))
def _(s, d):
    lt = _latest(s, d).select("run_id", F.when(F.col("status") == "done", F.col("updated_at")).cast("date").alias("finished_utc"),
                              F.date_sub("updated_at", 1).alias("started_utc"), F.date_sub("updated_at", 2).alias("submitted_utc"))
    return reg.newest_first(lt).select("run_id", F.coalesce("finished_utc", "started_utc").alias("t"))


@query("top6_last_log_lines", "TOP6", """
    SELECT run_id, seq AS line_no, status AS line FROM status_events QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 5""", ("status_events",))
def _(s, d):
    logs = view(s, d, "status_events").select("run_id", F.col("seq").alias("line_no"), F.col("status").alias("line"))
    return documents.last_lines(logs, 5)


# --- text -------------------------------------------------------------------------------------------------

@query("src14_line_search", "SRC14 WIN7", """
    SELECT doc_id, i AS line_no, lines[i] AS line, array_to_string(lines[greatest(i - 2, 1):i + 2], chr(10)) AS context
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    WHERE regexp_matches(lines[i], '(?i)licen[cs]e|street|[0-9]{3}')""")
def _(s, d):
    return documents.grep(table(s, d, "documents"), "licen[cs]e|street|[0-9]{3}", 2)


@query("src14_page_numbers", "SRC14", """
    SELECT doc_id, CAST(i AS INT) AS page, length(pages[i]) AS n_chars
    FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM (
      SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS pages FROM documents))""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return documents.page_number(docs).select("doc_id", "page", F.length("text").cast("long").alias("n_chars"))


@query("str1_kml_colours", "STR1", """
    SELECT id, lpad(lower(hex(CAST(round_even(least(1, a / 50) * 255, 0) AS BIGINT))), 2, '0') || bb || gg || rr AS kml
    FROM (SELECT *, h[1:2] AS rr, h[3:4] AS gg, h[5:6] AS bb FROM (SELECT id, a, lower(lpad(hex(CAST(id * 7919 % 16777216 AS BIGINT)), 6, '0')) AS h FROM breaches))""", ("breaches",))
def _(s, d):
    web = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("id") * 7919 % 16777216), 6, "0")))
    return view(s, d, "breaches").select("id", ft.kml_colour(web, F.col("a") / 50).alias("kml"))


@query("str2_field_names", "STR2", """
    SELECT box, count(*) FILTER (WHERE length(name) > 10) AS too_long, count(*) - count(DISTINCT name) AS repeated
    FROM (SELECT doc_id % 50 AS box, left(source || lang || quality_, 12) AS name FROM (SELECT *, CAST(n_chars % 900 AS VARCHAR) AS quality_ FROM documents)) GROUP BY box""")
def _(s, d):
    n = table(s, d, "documents").select((F.col("doc_id") % 50).alias("box"), F.left(
        F.concat("source", "lang", (F.col("n_chars") % 900).cast("string")), F.lit(12)).alias("name"))
    return n.groupBy("box").agg(F.count_if(F.length("name") > fixed.FIELD_NAME_LIMIT).alias("too_long"),
                                (F.count("*") - F.count_distinct("name")).alias("repeated"))


@query("str4_run_names", "STR4", """
    SELECT o_orderkey, 'area' || o_custkey || '_90m_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS run_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'instantaneous full breach' WHEN o_orderkey % 3 = 1 THEN 'dam_break (no breach hydrograph)'
                ELSE printf('overtopping breach, %d m bottom width, %d min formation', o_custkey, o_orderkey % 100) END AS label FROM orders""")
def _(s, d):
    o = table(s, d, "orders")
    mode = F.when(F.col("o_orderkey") % 3 == 0, "instantaneous").when(F.col("o_orderkey") % 3 == 2, "overtopping")
    return o.select("o_orderkey", ft.run_id(F.concat(F.lit("area"), "o_custkey"), F.lit(90.0), F.col("o_orderdate")).alias("run_id"),
                    ft.scenario_label(mode, F.lit("dam_break"), F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 100) * 60.0).alias("label"))


@query("str5_more_formats", "STR5", """
    SELECT o_orderkey, CASE WHEN w < 60 THEN printf('%.1f s', w) ELSE CAST(floor(w / 60) AS INT) || ' min ' || printf('%.0f', w % 60) || ' s' END AS wall,
           printf('%.1f h', o_totalprice / 3600) AS duration FROM (SELECT *, CAST(o_orderkey % 200 AS DOUBLE) AS w FROM orders)""")
def _(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", ft.show_wall_time((F.col("o_orderkey") % 200).cast("double")).alias("wall"), ft.show_duration(F.col("o_totalprice")).alias("duration"))


@query("str7_path_escapes", "STR7 STR8", """
    SELECT page_id, n % 4 = 0 OR n % 4 = 2 AS escapes, CASE WHEN n % 2 = 0 THEN 'geotiff' ELSE 'other' END AS kind,
           CASE WHEN n % 2 = 0 THEN 'image/tiff' ELSE 'application/octet-stream' END AS mime FROM (SELECT page_id, page_id AS n FROM pages)""")
def _(s, d):
    p = table(s, d, "pages")
    n = F.col("page_id") % 4
    path = (F.when(n == 0, F.concat(F.lit("/run/"), "page_id", F.lit(".TIF"))).when(n == 1, F.concat(F.lit("a/../b/"), "page_id"))
             .when(n == 2, F.concat(F.lit("a/../../"), "page_id", F.lit(".tif"))).otherwise(F.concat(F.lit("a/"), "page_id", F.lit("/x.bin"))))
    p = p.select("page_id", path.alias("path"))
    return p.select("page_id", ft.escapes(F.col("path")).alias("escapes"), ft.artifact_kind(F.col("path")).alias("kind"), ft.content_type(F.col("path")).alias("mime"))


@query("dt2_vintage_text", "DT2", """
    SELECT o_orderkey, 'Population surface of 1990 is ' || (year(o_orderdate) - 1990) || ' years old.' AS text FROM orders""")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", ft.vintage_text(F.lit(1990), F.col("o_orderdate")).alias("text"))


@query("prj14_json_safe_values", "PRJ14", """
    SELECT id, CASE WHEN id % 3 = 0 THEN s END AS v FROM breaches""", ("breaches",))
def _(s, d):
    v = F.when(F.col("id") % 3 == 0, F.col("s")).when(F.col("id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return view(s, d, "breaches").select("id", ft.finite(v).alias("v"))


# --- files ----------------------------------------------------------------------------------------------------

@query("src1_csv_with_comments", "SRC1", """
    SELECT s_name AS point, s_suppkey * 1.5 AS x_m, s_suppkey * 2.5 AS y_m, 'left' AS bank, s_acctbal AS ws_obs_m FROM supplier""")
def _(s, d):
    path = scratch_path(s, "csv")
    line = F.concat_ws(" , ", "s_name", (F.col("s_suppkey") * 1.5).cast("string"), (F.col("s_suppkey") * 2.5).cast("string"), F.lit("left"), F.col("s_acctbal").cast("string"))
    body = table(s, d, "supplier").select(F.concat(F.lit("# surveyed points\npoint,x_m,y_m,bank,ws_obs_m\n"), line).alias("value"))
    body.write.option("lineSep", "\n").text(path)
    rows = documents.read_csv(s, path, "bank STRING, ws_obs_m STRING, y_m STRING, x_m STRING, point STRING").where("point <> 'point'")
    return rows.select("point", *[F.col(c).cast("double").alias(c) for c in ("x_m", "y_m")], "bank", F.col("ws_obs_m").cast("double").alias("ws_obs_m"))


@query("src2_observation_families", "SRC2 SET1", """
    SELECT kind, count(*) AS n, count(ws_obs_m) AS ws, count(at_obs_s) AS at_ FROM observations GROUP BY kind""", ("observations",))
def _(s, d):
    o = view(s, d, "observations")
    base = o.select("kind", F.col("name"), F.col("x").alias("x_m"), F.col("y").alias("y_m"), "ws_obs_m", "at_obs_s")
    u = documents.unite_observations(
        base.where("kind = 'police'").withColumnRenamed("name", "point"), base.where("kind = 'transformer'").withColumnRenamed("name", "transformer"),
        base.where("kind = 'gauge'").withColumnsRenamed({"name": "gauge", "ws_obs_m": "ws_lab_m", "at_obs_s": "at_lab_s"}))
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("ws_obs_m").alias("ws"), F.count("at_obs_s").alias("at_"))


@query("src11_artifact_listing", "SRC11 STR8", "SELECT 'text' AS kind, count(*) AS folders, true AS sized FROM (SELECT DISTINCT lang FROM documents)")
def _(s, d):
    root = scratch_path(s, "artifacts")
    table(s, d, "documents").select("lang", "text").write.partitionBy("lang").text(root)
    a = documents.artifacts(s, root).where(~F.col("name").rlike(r"(^|/)[._]"))
    return a.groupBy("kind").agg(F.count_distinct(F.substring_index("name", "/", 1)).alias("folders"), F.bool_and(F.col("size_bytes") > 0).alias("sized"))


@query("snk3_manifest", "SNK3", """SELECT 'p' || page_id || '.html' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages""")
def _(s, d):
    p = table(s, d, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("length"),
                                    F.col("html").cast("binary").alias("content"))
    return bands.hashed(p)


@query("snk3_manifest_of_files", "SNK3", """
    SELECT path, strlen(body) AS bytes, sha256(body) AS sha256, count(*) OVER () AS files, CAST(sum(strlen(body)) OVER () AS BIGINT) AS total_bytes
    FROM (SELECT 'part=' || page_id % 4 AS path, string_agg(html || chr(10), '' ORDER BY page_id) AS body FROM pages GROUP BY 1)""")
def _(s, d):
    root = scratch_path(s, "files")
    p = table(s, d, "pages").select((F.col("page_id") % 4).alias("part"), "page_id", F.col("html").alias("value"))
    (p.repartition(4, "part").sortWithinPartitions("part", "page_id").drop("page_id")
      .write.partitionBy("part").option("lineSep", "\n").text(root))
    found = bands.manifest(s, root).where(~F.col("path").rlike(r"(^|/)[._]"))
    total = found.agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"))  # one row
    return found.select(F.substring_index("path", "/", 1).alias("path"), "bytes", "sha256").join(F.broadcast(total))


@query("snk7_isolated_exports", "SNK7", """
    SELECT 'quality ' || quality AS stage, count(*) FILTER (WHERE toxic > 1) = 0 AS ok, count(*) AS rows FROM labels GROUP BY quality
    UNION ALL SELECT 'every', true, count(*) FROM labels UNION ALL SELECT 'refused', false, NULL""")
def _(s, d):
    rows = table(s, d, "labels")
    refused = F.when(F.col("doc_id").isNotNull(), F.raise_error(F.lit("refused")).cast("long"))

    def write(df, name):
        def run():
            path = scratch_path(s, name)
            df.write.parquet(path)
            return s.read.schema(df.schema).parquet(path).count()
        return run

    sinks = {"refused": write(rows.select(refused.alias("x")), "refused"), "every": write(rows, "every")}
    sinks |= {f"quality {q}": write(rows.where(F.col("quality") == q), "quality") for q in (0, 1)}
    return bands.export_all(sinks, s, scratch_path(s, "export-log")).select("stage", "ok", "rows")


@query("snk4_attribute_rows", "SNK4 STR2 STR3 STR6", """
    SELECT doc_id, left(text, 254) AS info, left(source || ' ' || text, 60) AS name FROM documents""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("info"), F.concat("source", F.lit(" "), "text").alias("name"))
    return bands.attribute_rows(docs)


@query("src13_features_by_tag", "SRC13", """
    SELECT c_custkey FROM customer WHERE c_custkey % 360 - 180 BETWEEN -20 AND 60 AND c_custkey % 180 - 90 BETWEEN -90 AND 45 AND c_mktsegment = 'HOUSEHOLD'""")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).alias("lon"), (F.col("c_custkey") % 180 - 90).alias("lat"),
                                       F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("tags"))
    return documents.features(c, -20, -90, 60, 45, "segment", "HOUSEHOLD").select("c_custkey")


# --- streams ----------------------------------------------------------------------------------------------------

def _at():
    """Event time of a frame: runs start an hour after each other."""
    return F.timestamp_seconds(F.col("run_id") * 3600 + F.col("t_s"))


def _streamed_maxima(s, d):
    frames = stream_view(s, d, "lineitem", "frames").withColumn("at", _at())
    return st.merged_maxima(st.drain(st.running_maxima(frames, "at")))


@query("st1_streaming_maxima", "ST1", """
    SELECT run_id, r, c, max_depth, round(max_speed, 6) AS max_speed, round(max_dv, 6) AS max_dv, arrival_s FROM cells""", ("cells",))
def _(s, d):
    return rounded(_streamed_maxima(s, d))


@query("st6_wetted_on_stream", "ST6 PRJ13", """
    SELECT run_id, m AS minute, count(*) FILTER (WHERE arrival_s / 60.0 <= m) AS wetted
    FROM cells, (SELECT unnest(range(0, 121, 15)) AS m) GROUP BY run_id, m""", ("cells",))
def _(s, d):
    return sampling.wetted_by(_streamed_maxima(s, d), 120, 15)


@query("st2_periodic_log", "ST2", """
    SELECT run_id, bucket, m.t_s AS t_s, m.volume AS volume, m.dt AS dt, m.q AS q FROM (
      SELECT run_id, CAST(floor(t_s / 600) AS BIGINT) AS bucket, max(struct_pack(t_s := t_s, volume := h, dt := hv, q := hu)) AS m FROM frames GROUP BY 1, 2)
    WHERE run_id * 3600 + bucket * 600 + 600 <= (SELECT max(run_id * 3600 + floor(t_s / 600) * 600) FROM frames)""", ("frames",))
def _(s, d):
    f = stream_view(s, d, "lineitem", "frames").select("run_id", "t_s", F.col("h").alias("volume"), F.col("hv").alias("dt"), F.col("hu").alias("q"))
    log = st.drain(st.periodic_log(f.withColumn("at", _at()), 600), "append")
    return log.select("run_id", "bucket", "t_s", "volume", "dt", "q")


@query("st3_streaming_gauge", "ST3", """
    SELECT run_id, t_s, round(coalesce(sum(m / rho * u) FILTER (WHERE fluid AND abs(x - 3.0) < 0.5), 0) / 1.0, 9) AS q FROM particles GROUP BY ALL""", ("particles",))
def _(s, d):
    out = st.drain(st.gauge_samples(stream_view(s, d, "lineitem", "particles"), 3.0, 0.5))
    return rounded(st.latest_emitted(out, ["run_id", "t_s"]), 9)


@query("st4_status_machine", "ST4", """
    SELECT run_id, CASE WHEN status <> 'done' AND last + INTERVAL 60 DAY < (SELECT max(updated_at) FROM status_events) THEN 'failed' ELSE status END AS status, seq
    FROM (SELECT run_id, arg_max(status, struct_pack(a := updated_at, b := seq)) AS status, arg_max(seq, struct_pack(a := updated_at, b := seq)) AS seq,
                 max(updated_at) AS last FROM status_events GROUP BY run_id)""", ("status_events",))
def _(s, d):
    ev = stream_view(s, d, "orders", "status_events").select("run_id", "status", "seq", "updated_at")
    return st.latest_emitted(st.drain(st.status_machine(ev, 60 * 86_400)), ["run_id"])
