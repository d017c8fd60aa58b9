"""Registered queries against their SQL at the smallest size, and the shape of plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ("agg1_field_accumulator", "people_by_hazard_and_arrival", "agg3_run_figures", "jn3_settlements_at_risk",
          "gr2_flow_direction", "gr3_flow_accumulation", "gr1_depression_fill", "jn11_interpolation_join",
          "agg10_population_resample", "snk5_latest_status", "src14_line_search", "agg14_building_damage")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in res.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=str)


def test_every_sql_belongs_to_a_query_and_parses(con):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


def test_cells_never_meet_in_a_nested_loop(spark):
    for name in ("people_by_hazard_and_arrival", "agg3_run_figures", "agg20_observation_samples", "jn9_flooded_road_km"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_scratch_is_cleared(spark, tmp_path):
    from floodspark import session
    kept, session._written[:] = list(session._written), []
    cut = session.cut(spark.range(5), "gone")
    assert cut.count() == 5 and session.clear_scratch(spark) == 1
    assert not __import__("os").path.exists(cut.inputFiles()[0].removeprefix("file://"))
    session._written[:] = kept
