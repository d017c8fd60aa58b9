import datetime as dt
import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from floodspark.operators import observe, sampling
from floodspark.operators.accumulate import field_accumulator
from floodspark.session import scratch_path
from floodspark.streaming import frames as st

SCHEMA = "run_id int, r int, c int, t_s double, h double, hu double, hv double"
LOG = "run_id int, t_s double, volume double, dt double, q double"


def put(spark, rows, schema, path):
    """One more file of a folder that is read as a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def frames(rnd, n, runs=2):
    return [(k % runs, rnd.randrange(4), rnd.randrange(4), float(k), rnd.random() * 2, rnd.random(), -rnd.random()) for k in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def at(df, per_run=0):
    return df.withColumn("at", F.timestamp_seconds(F.col("run_id") * per_run + F.col("t_s")))


def state_rows(spark, folder):
    return spark.read.format("statestore").load(f"{folder}/state").count()


def test_shuffled_and_repeated_frames_give_the_batch_answer(spark):
    rnd = random.Random(3)
    rows = frames(rnd, 400)
    path = scratch_path(spark, "frames")
    late = rows + rnd.sample(rows, 80)
    rnd.shuffle(late)
    for k in range(0, len(late), 160):
        put(spark, late[k:k + 160], SCHEMA, path)
    emitted = st.drain(st.running_maxima(source(spark, SCHEMA, path)))
    assert emitted.select("batch_id").distinct().count() > 1
    assert rows_of(st.latest_emitted(emitted, ["run_id", "r", "c"])) == rows_of(field_accumulator(spark.createDataFrame(rows, SCHEMA)))


def test_restarted_maxima_equal_batch_and_leave_no_state(spark):
    rnd = random.Random(4)
    rows = frames(rnd, 500, runs=3)
    path, folder = scratch_path(spark, "frames"), scratch_path(spark, "resumed")
    maxima = lambda: st.running_maxima(at(source(spark, SCHEMA, path)), "at", "60 seconds", "600 seconds")
    for part in (rows[:100], rows[100:200] + rows[50:80]):
        put(spark, part, SCHEMA, path)
    half = rows_of(st.merged_maxima(st.process(maxima(), folder)))
    assert half == rows_of(field_accumulator(spark.createDataFrame(rows[:200], SCHEMA)))
    held = state_rows(spark, folder)
    rest = rows[200:] + rows[120:180]  # new, repeated and late by less than allowed
    rnd.shuffle(rest)
    for k in range(0, len(rest), 120):
        put(spark, rest[k:k + 120], SCHEMA, path)
    emitted = st.process(maxima(), folder)
    assert rows_of(st.merged_maxima(emitted)) == rows_of(field_accumulator(spark.createDataFrame(rows, SCHEMA)))
    assert emitted.agg(F.max("batch_id")).first()[0] > 3
    # a frame far past the watermark: the runs are done, their spans are closed
    put(spark, [(9, 0, 0, 5000.0, 0.5, 0.0, 0.0)], SCHEMA, path)
    st.process(maxima(), folder)
    assert state_rows(spark, folder) == 1 < held


def test_a_repeated_batch_replaces_itself(spark):
    rnd = random.Random(5)
    rows = frames(rnd, 300)
    path, folder = scratch_path(spark, "frames"), scratch_path(spark, "resumed")
    for k in range(0, 300, 100):
        put(spark, rows[k:k + 100], SCHEMA, path)
    stream = lambda: st.running_maxima(at(source(spark, SCHEMA, path)), "at", "60 seconds")
    before = Counter(map(tuple, st.process(stream(), folder).collect()))
    local = folder.removeprefix("file:")
    last = max((int(os.path.basename(p)) for p in glob.glob(f"{local}/state/commits/[0-9]*")))
    os.remove(f"{local}/state/commits/{last}")  # the writer died after its output, before its commit
    if os.path.exists(f"{local}/state/commits/.{last}.crc"):
        os.remove(f"{local}/state/commits/.{last}.crc")
    assert Counter(map(tuple, st.process(stream(), folder).collect())) == before


def test_nothing_arrived_gives_an_empty_result(spark):
    path, folder = scratch_path(spark, "frames"), scratch_path(spark, "resumed")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert st.process(st.running_maxima(source(spark, SCHEMA, path)), folder).count() == 0


@pytest.mark.parametrize("stops", [(6,), (2, 3, 6)])
def test_periodic_log_is_final_once_and_survives_restarts(spark, stops):
    rnd = random.Random(6)
    rows = [(k % 2, float(k * 7 % 900 + 900 * (k // 130)), rnd.random(), rnd.random(), rnd.random()) for k in range(650)]
    order = sorted(rows, key=lambda r: r[1] + rnd.random() * 80)  # out of order by less than allowed
    path, folder = scratch_path(spark, "log"), scratch_path(spark, "resumed")
    parts = [order[k * 110:(k + 1) * 110] for k in range(6)]
    done = 0
    for stop in stops:
        for part in parts[done:stop]:
            put(spark, part, LOG, path)
        done = stop
        log = st.process(st.periodic_log(at(source(spark, LOG, path)), 60, 100), folder, "append").drop("batch_id")
    got = log.collect()
    newest = max(r[1] for r in rows)
    want = {}
    for run, t, v, d, q in rows:
        b = int(t // 60)
        if (b + 1) * 60 <= (newest // 60 + 1) * 60 - 160:
            want[run, b] = max(want.get((run, b), (-1.0,)), (t, v, d, q))
    assert len(got) == len(want)
    assert {(r["run_id"], r["bucket"]): (r["t_s"], r["volume"], r["dt"], r["q"]) for r in got} == want


def test_late_records_are_dropped_only_past_the_watermark(spark):
    path, folder = scratch_path(spark, "log"), scratch_path(spark, "resumed")
    log = lambda: st.process(st.periodic_log(at(source(spark, LOG, path)), 60, 100), folder, "append").drop("batch_id")
    put(spark, [(0, 10.0, 1.0, 0.0, 0.0), (0, 150.0, 2.0, 0.0, 0.0)], LOG, path)
    log()
    put(spark, [(0, 30.0, 3.0, 0.0, 0.0), (0, 500.0, 4.0, 0.0, 0.0)], LOG, path)  # 30 is late, but its interval is open
    log()
    put(spark, [(0, 50.0, 9.0, 0.0, 0.0), (0, 900.0, 5.0, 0.0, 0.0)], LOG, path)  # 50 comes after its line was written
    got = {r["bucket"]: (r["t_s"], r["volume"]) for r in log().collect()}
    assert got == {0: (30.0, 3.0), 2: (150.0, 2.0), 8: (500.0, 4.0)}


def test_event_bands_equal_batch(spark):
    rnd = random.Random(7)
    day = dt.datetime(2024, 1, 16)
    schema = "id long, run_id int, r int, c int, acquired timestamp, mode string, pol array<string>, db double"
    rows = [(k, k % 2, rnd.randrange(5), rnd.randrange(5), day + dt.timedelta(days=rnd.randrange(-40, 40), hours=rnd.randrange(24)),
             rnd.choice(("IW", "IW", "EW")), rnd.choice((["VV", "VH"], ["HH"], ["VV"])), -rnd.random() * 20) for k in range(600)]
    rows.sort(key=lambda r: r[4] + dt.timedelta(days=rnd.random() * 3))
    path, folder = scratch_path(spark, "scenes"), scratch_path(spark, "resumed")
    events = spark.createDataFrame([(0, day.date()), (1, (day + dt.timedelta(days=5)).date())], "run_id int, event_date date")
    occ = spark.createDataFrame([(run, r, c, 10 * (r + c)) for run in (0, 1) for r in range(5) for c in range(4)],
                                "run_id int, r int, c int, occurrence int")
    slope = spark.createDataFrame([(run, r, c, float(r * 2)) for run in (0, 1) for r in range(4) for c in range(5)],
                                  "run_id int, r int, c int, slope_deg double")
    stream = lambda: st.event_scenes(source(spark, schema, path), events, occ, slope, "5 days", ["id"])
    for k in range(0, 600, 200):
        put(spark, rows[k:k + 200] + rows[max(k - 20, 0):k + 30], schema, path)  # with repeated deliveries
        found = st.process(stream(), folder, "append")
    want = []
    for i, run, r, c, when, mode, pol, db in rows:
        event = day.date() if run == 0 else (day + dt.timedelta(days=5)).date()
        days = (when.date() - event).days
        band = "pre" if -24 <= days < 0 else "post" if 0 <= days < 16 else None
        if mode == "IW" and "VV" in pol and band:
            usable = r < 4 and r * 2 <= 5 and (c == 4 or 10 * (r + c) < 50)
            want.append((i, run, r, c, db, event, band, usable))
    got = [tuple(r) for r in found.select("id", "run_id", "r", "c", "db", "event_date", "band", "usable").collect()]
    assert sorted(got) == sorted(want)
    batch = observe.median_composite(spark.createDataFrame([w[1:5] for w in want if w[6] == "pre"], "run_id int, r int, c int, db double"))
    assert rows_of(observe.median_composite(found.where("band = 'pre'"))) == rows_of(batch)
    before = found.count()
    put(spark, [(9001, 0, 0, 0, day - dt.timedelta(days=20), "IW", ["VV"], -3.0)], schema, path)  # weeks past the watermark
    put(spark, [(9002, 0, 0, 0, rows[-1][4] - dt.timedelta(days=30), "IW", ["VV"], -3.0)], schema, path)
    assert st.process(stream(), folder, "append").count() == before


def test_silent_run_fails_and_finished_run_stays(spark):
    path, folder = scratch_path(spark, "status"), scratch_path(spark, "resumed")
    schema = "run_id string, status string, seq long, updated_at timestamp"
    when = lambda m, d: dt.datetime(2024, m, d)
    machine = lambda: st.latest_emitted(st.process(st.status_machine(source(spark, schema, path), 86_400), folder), ["run_id"])
    put(spark, [("a", "queued", 1, when(1, 1)), ("a", "running", 2, when(1, 2)), ("b", "running", 3, when(1, 3))], schema, path)
    assert {x.run_id: x.status for x in machine().collect()}["b"] == "running"
    put(spark, [("b", "done", 4, when(1, 4)), ("b", "running", 3, when(1, 3)), ("c", "running", 5, when(3, 1))], schema, path)
    assert {x.run_id: x.status for x in machine().collect()} == {"a": "failed", "b": "done", "c": "running"}
    assert state_rows(spark, folder) == 1  # only c may still change


def test_runs_share_buckets_of_state(spark):
    """A call for every run took a call's time for every run: state is held, and settled, by bucket."""
    rnd = random.Random(8)
    path, folder = scratch_path(spark, "status"), scratch_path(spark, "resumed")
    schema = "run_id string, status string, seq long, updated_at timestamp"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(f"run {rnd.randrange(300)}", rnd.choice(("queued", "running", "done")), k, day(k // 100)) for k in range(2000)]
    machine = lambda: st.latest_emitted(st.process(st.status_machine(source(spark, schema, path), 5 * 86_400, buckets=4), folder), ["run_id"])
    last = {}
    for part in (rows[:900], rows[900:]):
        put(spark, part, schema, path)
        got = {x.run_id: (x.status, x.seq) for x in machine().collect()}
        last |= {run: (status, k, at) for run, status, k, at in part}
        newest = part[-1][3]
        fails = lambda status, at: status != "done" and at + dt.timedelta(days=5) < newest
        assert got == {run: ("failed" if fails(status, at) else status, k) for run, (status, k, at) in last.items()}
        assert 0 < state_rows(spark, folder) <= 4


def test_wetted_cells_by_minute(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 899.0), (0, 0, 2, 900.0), (0, 0, 3, 901.0), (0, 0, 4, None), (0, 0, 5, 9999.0),
                                   (1, 0, 0, None)], "run_id int, r int, c int, arrival_s double")
    got = {(r["run_id"], r["minute"]): r["wetted"] for r in sampling.wetted_by(cells, 30, 15).collect()}
    assert got == {(0, 0): 1, (0, 15): 3, (0, 30): 4, (1, 0): 0, (1, 15): 0, (1, 30): 0}
