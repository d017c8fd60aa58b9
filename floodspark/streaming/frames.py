"""Frames, logs, radar scenes and status reports as streams."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from floodspark import fixed, grid
from floodspark.functions import text as ft
from floodspark.operators.accumulate import maxima, with_speed
from floodspark.session import scratch_path


def running_maxima(frames: DataFrame, at: str | None = None, span: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """The field accumulator on a stream (update mode).

    Maxima and minima commute, so late, repeated or shuffled frames give the batch answer.  With an event time ``at``
    state is held per cell and ``span``: it ends once the watermark, ``late`` behind the newest frame, has passed the
    span, so a run that is done leaves none behind; ``merged_maxima`` unites a cell's spans.  Without ``at`` every cell
    keeps its state for as long as the query lives.
    """
    body = with_speed(frames)
    if at is None:
        return body.groupBy(*grid.CELL).agg(*maxima())
    spans = body.withWatermark(at, late).groupBy(F.window(at, span).alias("w"), *grid.CELL).agg(*maxima())
    return spans.select(F.col("w.start").alias("span"), *[c for c in spans.columns if c != "w"])


def merged_maxima(emitted: DataFrame) -> DataFrame:
    """A row per cell from what ``running_maxima`` emitted by span."""
    last = latest_emitted(emitted, ["span", *grid.CELL])
    return last.groupBy(*grid.CELL).agg(*[F.max(c).alias(c) for c in ("max_depth", "max_speed", "max_dv")],
                                        F.min("arrival_s").alias("arrival_s"))


def gauge_samples(particles: DataFrame, gauge_x: float, dp: float) -> DataFrame:
    """Flux through a gauge line per run and time, as particles arrive."""
    near = F.col("fluid") & (F.abs(F.col("x") - gauge_x) < dp)
    return particles.groupBy("run_id", "t_s").agg((F.coalesce(
        F.sum(F.when(near, F.col("m") / F.col("rho") * F.col("u"))), F.lit(0.0)) / (2.0 * dp)).alias("q"))


def periodic_log(history: DataFrame, every_s: int, late_s: int = 0, at: str = "at") -> DataFrame:
    """The last record ``t_s, volume, dt, q`` of every ``every_s`` seconds of a run's model time (append mode).

    ``at`` is a record's event time.  A line is emitted once, when the watermark (``late_s`` behind the newest record)
    has passed the end of its interval; later records of the interval are dropped and its state is gone.  Records of
    one time: the largest volume, then ``dt``, then ``q``.
    """
    bucket = F.floor(F.col("t_s") / every_s).cast("long")
    left = (bucket + 1) * every_s - F.col("t_s")  # model seconds to the interval's end, which is an event time too
    closes = F.timestamp_micros((F.unix_micros(at) + F.round(left * 1_000_000)).cast("long"))
    timed = history.withColumn("bucket", bucket).withColumn("closes", closes).withWatermark(
        "closes", f"{every_s + late_s} seconds")  # the newest record may be a whole interval before its end
    log = timed.groupBy("run_id", "bucket", "closes").agg(F.max(F.struct("t_s", "volume", "dt", "q")).alias("m"))
    return log.select("run_id", "bucket", "closes", "m.*")


def event_scenes(scenes: DataFrame, events: DataFrame, occurrence: DataFrame, slope: DataFrame, late: str,
                 key: list[str], polarisation: str = "VV", mode: str = "IW",
                 max_occurrence: float = fixed.SAR_MAX_OCCURRENCE, max_slope: float = fixed.SAR_MAX_SLOPE_DEG) -> DataFrame:
    """Radar pixels of a stream in the bands around their run's events (append mode).

    ``scenes`` is ``run_id, r, c, acquired, mode, pol, db`` and the ``key`` of a pixel; the rest is static:
    ``events`` ``(run_id, event_date)``, ``occurrence`` and ``slope`` by cell.  Adds ``band`` (``pre`` or ``post``;
    a pixel between two events is in a band of each) and ``usable``: not water that is always there, not too steep.
    Repeated deliveries and pixels older than the watermark, ``late`` behind the newest, are dropped.
    """
    good = scenes.where((F.col("mode") == mode) & F.array_contains("pol", polarisation))
    timed = good.withWatermark("acquired", late).dropDuplicatesWithinWatermark(key)
    windows = [F.struct(F.lit(name).alias("band"), w["start"].alias("start"), w["end"].alias("end"))
               for name, w in (("pre", ft.pre_window(F.col("event_date"))), ("post", ft.post_window(F.col("event_date"))))]
    bands = events.select("run_id", "event_date", F.explode(F.array(*windows)).alias("b")).select("run_id", "event_date", "b.*")
    day = F.col("acquired").cast("date")
    placed = timed.join(bands, "run_id").where((day >= F.col("start")) & (day < F.col("end"))).drop("start", "end")
    flat = slope.where(F.col("slope_deg") <= max_slope).select(*grid.CELL, F.lit(True).alias("_flat"))
    wet = occurrence.select(*grid.CELL, F.col("occurrence").alias("_wet"))
    usable = (F.coalesce("_wet", F.lit(0)) < max_occurrence) & F.col("_flat").isNotNull()
    return (placed.join(wet, grid.CELL, "left").join(flat, grid.CELL, "left")
                  .withColumn("usable", usable).drop("_wet", "_flat"))


#: The best report of each run that a bucket holds; ``at`` in microseconds.
_HELD = pa.schema([("run_id", pa.string()), ("status", pa.string()), ("seq", pa.int64()), ("at", pa.int64())])


def _pack(held: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _HELD) as writer:
        writer.write_table(pa.Table.from_pandas(held, _HELD, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(packed) as reader:
        return reader.read_pandas()


def status_machine(events: DataFrame, heartbeat_s: int, delay: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """Best-known status per run; silence longer than the heartbeat turns a live run to failed.

    Time is the reports' own time: once the watermark has passed a run's last report by the heartbeat, a live run
    fails, and the state of any run, one status, number and time, is gone.  Runs are held in ``buckets`` by the hash of
    their name, so a task settles a bucket's runs together and not one call at a time; a bucket without runs leaves no
    state.  Reports without a time are none.
    """
    def step(key, batches, state):
        best = _unpack(state.get[0]) if state.exists else _HELD.empty_table().to_pandas()
        told = []
        for pdf in batches:
            pdf = pdf[pdf["updated_at"].notna()]
            at = pdf["updated_at"].to_numpy().astype("datetime64[us]").astype("int64")
            fresh = pdf[["run_id", "status"]].assign(seq=pdf["seq"].astype("int64"), at=at)
            told.append(fresh["run_id"].drop_duplicates())
            both = pd.concat([best, fresh]) if len(best) else fresh
            best = both.sort_values(["at", "seq"], ascending=False, kind="stable").drop_duplicates("run_id")  # ties: the first told
        now = state.getCurrentWatermarkMs()
        ends = best["at"] // 1000 + heartbeat_s * 1000
        silent = ends < now
        heard = best[best["run_id"].isin(pd.concat(told))] if told else best[:0]
        failed = best[silent & best["status"].isin(["queued", "running"])]
        out = pd.concat([heard[~heard["run_id"].isin(failed["run_id"])], failed.assign(status="failed")])
        if silent.all():
            state.remove()
        else:
            state.update((_pack(best[~silent]),))
            state.setTimeoutTimestamp(max(int(ends[~silent].min()), now + 1))
        yield out[["run_id", "status", "seq"]]

    timed = events.select("run_id", "status", "seq", F.col("updated_at").cast("timestamp").alias("updated_at"),
                          F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")).withWatermark("updated_at", delay)
    return timed.groupBy("bucket").applyInPandasWithState(
        step, "run_id string, status string, seq long", "held binary", "update", GroupStateTimeout.EventTimeTimeout)


def process(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Process what has arrived and return everything emitted so far, with its ``batch_id``.

    ``folder`` (shared storage) holds the checkpoint and the output.  The next call with the same folder goes on where
    this one ended.  A batch is written under its number: one that is repeated after a failure replaces itself, so
    nothing is emitted twice.  Nothing passes the driver.
    """
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/out"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # an empty result is one too

    def put(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
               .trigger(availableNow=True).foreachBatch(put).start())
    q.awaitTermination()
    fields = [*stream.schema.fields, T.StructField("batch_id", T.IntegerType()), T.StructField("batch", T.IntegerType())]
    return spark.read.option("basePath", out).schema(T.StructType(fields)).parquet(out).drop("batch")


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """``process`` once, in a folder of its own."""
    return process(stream, scratch_path(stream.sparkSession, "stream"), mode)


def latest_emitted(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")).select(*keys, "_v.*")
