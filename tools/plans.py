"""List the physical operators worth a second look in every query's plan."""

import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from floodspark.queries import load  # noqa: E402
from floodspark.session import build_session  # noqa: E402

SUSPECT = ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython", "PythonUDF ")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("plans", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for name, q in load().items():
        if name.startswith("st"):
            continue
        try:
            plan = q.run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as err:  # noqa: BLE001
            print(name, "failed:", str(err)[:150], flush=True)
            continue
        seen = [p for p in SUSPECT if p in plan]
        if seen:
            print(name, seen, flush=True)
    print("done")


main()
