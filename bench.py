"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

import json
import os
import sys
import time

from floodspark.queries import load
from floodspark.session import build_session

HEADLINE = (
    "agg1_field_accumulator", "people_by_hazard_and_arrival", "agg7_exposure_cube", "agg3_run_figures",
    "agg14_building_damage", "jn3_settlements_at_risk", "agg20_observation_samples", "geo5_distance_to_source",
    "geo4_boundary_edges", "agg10_population_resample", "agg11_composite_roughness", "geo8_bilinear_reprojection",
    "jn15_void_fill", "gr1_depression_fill", "gr2_flow_direction", "gr3_flow_accumulation",
    "gr4_height_above_drainage", "gr10_components", "win8_focal_median", "agg17_hydrograph_summary",
    "jn11_interpolation_join", "agg27_depth_quantiles", "snk5_latest_status", "st1_streaming_maxima",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("floodspark-bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        load()[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    digits = "".join(ch for ch in os.path.basename(sf.rstrip("/")) if ch.isdigit() or ch == ".")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(digits) if digits else None}))
    spark.stop()


if __name__ == "__main__":
    main()
