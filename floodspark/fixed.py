"""Published tables, class names, thresholds and formats.

These are data, not logic.  Everything that must come out with exactly these
numbers or words is stated here once, in natural order.
"""

# --- hazard rating (Defra / Environment Agency) ---------------------------------
VELOCITY_OFFSET = 0.5
HAZARD_BANDS = (0.75, 1.25, 2.5)
HAZARD_NAMES = ("Low", "Moderate", "Significant", "Extreme")
HAZARD_MEANING = (
    "Caution — shallow flowing water or deep standing water",
    "Dangerous for some — children and the infirm at risk",
    "Dangerous for most people — evacuation on foot unsafe",
    "Dangerous for all — including emergency services",
)
HAZARD_COLOURS = ("#ffeda0", "#feb24c", "#f03b20", "#7f0000")

# debris factor: rows are depth bands, columns the land covers below
DEBRIS_LANDCOVER = ("pasture_arable", "woodland", "urban")
DEBRIS_SHALLOW = (0.0, 0.0, 0.0)
DEBRIS_MEDIUM = (0.0, 0.5, 1.0)
DEBRIS_DEEP = (0.5, 1.0, 1.0)
DEBRIS_MEDIUM_DEPTH = 0.25
DEBRIS_DEEP_DEPTH = 0.75
DEBRIS_DEEP_SPEED = 2.0

# --- combined hazard curves: label, max depth*speed, max depth, max speed, meaning
AIDR_LIMITS = (
    ("H1", 0.3, 0.3, 2.0, "Generally safe for people, vehicles and buildings"),
    ("H2", 0.6, 0.5, 2.0, "Unsafe for small vehicles"),
    ("H3", 0.6, 1.2, 2.0, "Unsafe for vehicles, children and the elderly"),
    ("H4", 1.0, 2.0, 2.0, "Unsafe for people and all vehicles"),
    ("H5", 4.0, 4.0, 4.0,
     "Unsafe for people and vehicles; buildings vulnerable to structural damage; "
     "some less robust buildings fail"),
)
AIDR_NAMES = ("H1", "H2", "H3", "H4", "H5", "H6")
AIDR_COLOURS = ("#ffffb2", "#fed976", "#feb24c", "#fd8d3c", "#e31a1c", "#800026")
STRUCTURAL_AIDR_CLASS = 4          # H5 and above

# --- arrival ---------------------------------------------------------------------
ARRIVAL_BANDS_MIN = (15.0, 30.0, 60.0, 120.0)
BAND_COLOURS = ("#08306b", "#2171b5", "#4292c6", "#7fb8d9", "#bdd7e7")
NEVER_FLOODED = -1
INITIALLY_WET = -2
WET_THRESHOLD_M = 0.1
H_MIN_M = 0.001
OPEN_EDGE_CELLS = 10
EVACUATION_ACTIONS = (
    "No time to move — vertical evacuation in place only",
    "On foot, immediate neighbourhood only",
    "Organised movement with vehicles feasible",
    "Full planned evacuation of settlement feasible",
)
EVACUATION_LATER = "Beyond the last isochrone — lowest priority"

# --- depth-damage curves -----------------------------------------------------------
CURVE_DEPTHS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0)
DAMAGE_CURVES = {
    "residential": (0.0, 0.32, 0.53, 0.68, 0.80, 0.93, 0.98, 1.00, 1.00),
    "commercial": (0.0, 0.24, 0.42, 0.57, 0.70, 0.87, 0.96, 1.00, 1.00),
    "industrial": (0.0, 0.20, 0.36, 0.50, 0.62, 0.81, 0.93, 0.99, 1.00),
    "infrastructure": (0.0, 0.25, 0.42, 0.55, 0.65, 0.80, 0.90, 0.96, 1.00),
    "agriculture": (0.0, 0.42, 0.62, 0.74, 0.83, 0.94, 0.99, 1.00, 1.00),
}
ASSET_VALUE_INR = {
    "residential_building": 1_200_000.0,
    "commercial_building": 4_000_000.0,
    "industrial_building": 12_000_000.0,
    "road_km": 25_000_000.0,
    "agriculture_hectare": 250_000.0,
}
ROAD_FRACTION = 0.35
RANGE_LOW, RANGE_HIGH = 0.5, 2.0
CRORE = 1.0e7

# --- land cover: code, name, Manning n, low, high ------------------------------------
LANDCOVER_CLASSES = (
    (10, "Tree cover", 0.100, 0.080, 0.160),
    (20, "Shrubland", 0.060, 0.035, 0.070),
    (30, "Grassland", 0.035, 0.025, 0.050),
    (40, "Cropland", 0.040, 0.020, 0.050),
    (50, "Built-up", 0.080, 0.050, 0.150),
    (60, "Bare / sparse vegetation", 0.025, 0.020, 0.035),
    (70, "Snow and ice", 0.020, 0.010, 0.030),
    (80, "Permanent water bodies", 0.040, 0.025, 0.055),
    (90, "Herbaceous wetland", 0.050, 0.035, 0.080),
    (95, "Mangroves", 0.100, 0.070, 0.160),
    (100, "Moss and lichen", 0.025, 0.020, 0.035),
)
FALLBACK_N = 0.033
DEBRIS_FLOW_N_FACTOR = 3.0
LANDCOVER_TILE_DEG = 3

# --- hydraulics -----------------------------------------------------------------------
GRAVITY = 9.81
C_WEIR, C_SIDE = 1.7, 1.35
SUBMERGENCE_LIMIT = 0.67
TRANSFORMER_REL_S = {"B": 1140.0, "C": 1320.0}
OUTSIDE_BED_M = 200.0
BLOCKAGE_REACH_M = 700.0

# --- terrain / hydrology ------------------------------------------------------------------
VOID_BELOW_M = -500.0
FILL_EPS = 1.0e-6
D8_DC = (1, 1, 0, -1, -1, -1, 0, 1)          # E SE S SW W NW N NE
D8_DR = (0, 1, 1, 1, 0, -1, -1, -1)
D8_CODES = (1, 2, 4, 8, 16, 32, 64, 128)

# --- geodesy ---------------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996
KM_PER_DEG = 111.32

# --- radar observation ----------------------------------------------------------------------------
SAR_RATIO = 1.25
SAR_MAX_OCCURRENCE = 50
SAR_MAX_SLOPE_DEG = 5.0
SAR_MIN_BLOB_PX = 8
SAR_PRE_DAYS, SAR_POST_DAYS = 24, 16

# --- registry ------------------------------------------------------------------------------------
MIN_HOURS, MAX_HOURS = 0.01, 48.0
MIN_DX_M, MAX_DX_M = 10.0, 1000.0
KIND_BY_SUFFIX = {
    "tif": "geotiff", "tiff": "geotiff", "shp": "shapefile", "shx": "shapefile",
    "dbf": "shapefile", "prj": "shapefile", "cpg": "shapefile", "kml": "kml",
    "kmz": "kml", "pdf": "pdf", "json": "json", "qml": "qml", "png": "image",
    "jpg": "image", "txt": "text", "log": "text",
}
CONTENT_TYPES = {
    "tif": "image/tiff", "tiff": "image/tiff",
    "kml": "application/vnd.google-earth.kml+xml",
    "kmz": "application/vnd.google-earth.kmz",
    "pdf": "application/pdf", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
FIELD_NAME_LIMIT = 10
TEXT_LIMIT = 254
NAME_LIMIT = 60
FLOAT_NODATA = -9999.0
INT_NODATA = -1
