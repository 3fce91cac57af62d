"""Registered queries that run as streams until their input is read, and return what the sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frame_buffer as frames
from ..operators.active_window import Rule
from ..operators.evidence import Scan
from ..streaming import active_window, activity, frame_buffer, incremental, object_state, persistent_states, ray_index
from ..streaming.epochs import EpochTable
from .inputs import HOUR, micros, points
from .presence_queries import ORACLES as BATCH
from .presence_queries import RULE
from .scratch import scratch
from .space_queries import _AB, _RAYS, _SEEN, _rays
from .track_queries import ORACLES as TRACKS
from .track_queries import state_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, sf_dir: str, files: int | None = 4) -> DataFrame:
    """The events; files: how many a trigger reads, None for all."""
    # a pattern, as a stream takes a file or a folder of files only by a pattern
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/event[s].parquet")


def _observed(events: DataFrame) -> DataFrame:
    verdict = F.when(F.col("event_type").isin("view", "click"), "present").when(F.col("event_type") == "error", "absent").otherwise("inconclusive")
    return events.select("event_id", F.col("user_id").alias("entity"), micros("ts").alias("t"), verdict.alias("verdict"), "value")


def stream_incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = incremental.ChangeState(["entity"], "t", "verdict", RULE)
    run = _observed(_stream(spark, sf_dir)).writeStream.foreachBatch(state.update).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return state.result


def stream_tracker_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions: those whose gap has passed before the stream's last stamp. One trigger reads all files: these are in no
    order of time, and of a later trigger the watermark would drop the rows older than those before it."""
    events = _stream(spark, sf_dir, None).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = scratch(spark, "sessions")
    run = activity.sessions(events, "user_id", "ts", "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last_end").alias("last_end"), "n")


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Everything that the stream emits until its input is read, with its epoch; the state is kept by RocksDB."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        sink = EpochTable(scratch(spark, "epochs"))
        df.writeStream.foreachBatch(sink.write).outputMode(mode).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return sink.read(spark)


def stream_active_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' tracks that have left a window of two hours, each emitted once by its timer."""
    rows = _stream(spark, sf_dir, None).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = _run(active_window.window_tracks(rows, Rule(2 * HOUR, None, 3, 50.0)), "append")
    return out.select(F.col("key").alias("user_id"), "first", "last", "n", "confidence", F.round("far", 9).alias("far"), "dynamic")


def stream_persistent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of object_persistent_states, by triggers. All files come in one, as they are in no order of time."""
    events = state_events(_stream(spark, sf_dir, None)).withColumnRenamed("entity", "key")
    out = persistent_states.last_states(_run(persistent_states.persistent_states(events), "update"))
    return out.withColumnRenamed("key", "entity")


def stream_frame_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sensors: views are frames, other events sights of a track of their kind; every second frame is stored, eight at most."""
    e = _stream(spark, sf_dir, None).select(F.col("user_id").alias("key"), micros("ts").alias("ts"), "event_type")
    kind = F.when(F.col("event_type") == "view", frames.FRAME).otherwise(frames.SIGHT)
    sights = e.select("key", "ts", kind.alias("kind"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("track"))
    # a track also sees the frame of its own stamp
    seen = e.where("event_type <> 'view'").select("key", "ts", F.lit(frames.FRAME).alias("kind"), F.lit(None).cast("string").alias("track"))
    out = frame_buffer.last_buffers(_run(frame_buffer.buffered(sights.unionByName(seen), frames.Rule(8, 2, 24 * HOUR)), "update"))
    return out.withColumnRenamed("key", "user_id")


def stream_object_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        rows = _observed(_stream(spark, sf_dir)).select(F.col("entity").alias("key"), F.col("t").alias("ts"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
        out = scratch(spark, "fragments")
        keep = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        run = object_state.fragments(rows, 60.0).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    found = spark.read.parquet(f"{out}/*")
    newest = Window.partitionBy("key", "fragment").orderBy(F.col("epoch").desc(), F.col("death").isNull(), F.col("last_support").desc())
    return found.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(F.col("key").alias("entity"), "fragment", "birth", "last_support", "death", "n", F.when(F.col("death").isNull(), "current").otherwise("closed").alias("status"))


#: The scan of ray_changes_by_epochs, and its epochs.
RAY_RULE, EPOCHS = Scan(50), 4


def ray_changes_by_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of ray_verify and what changed by it, as points and rays arrive by ranges of ids: each epoch looks up what its own rows
    touch in the index of those before, and its evidence scans the points anew that it is about."""
    index = ray_index.RayIndex(scratch(spark, "rays"), point_id="vid", ray_id="ray", block=0.1, radial=0.02, depth=0.03, fan=EPOCHS)
    state = incremental.ChangeState(["vid"], "ts", "verdict", RAY_RULE, fan=EPOCHS)
    low, high = points(spark, sf_dir).agg(F.min("vid"), F.max("vid")).first()
    width = (0 if low is None else high - low) // EPOCHS + 1
    for epoch in range(EPOCHS):
        of = lambda df, c: df.where(F.floor((F.col(c) - F.lit(low)) / width) == epoch)  # noqa: B023, E731
        state.update(index.update(spark, epoch, of(points(spark, sf_dir, 0), "vid"), of(_rays(spark, sf_dir), "ray")), epoch)
    seen = index.evidence(spark).where("verdict <> 'occluded'").groupBy("vid").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("present", "absent")])
    return seen.join(state.result, "vid")


QUERIES = {f.__name__: f for f in (stream_incremental_changes, stream_tracker_activity, stream_object_state, stream_active_window, stream_persistent_states, stream_frame_buffer, ray_changes_by_epochs)}
ORACLES = {
    "ray_changes_by_epochs": f"""{_AB}, {_RAYS}, {_SEEN}, v AS (SELECT vid, ray // {RAY_RULE.resolution} AS bin, count(*) FILTER (abs(reach - d) <= 0.03) AS p, count(*) FILTER (reach - d > 0.03) AS n FROM h WHERE aside <= 0.02 AND d - reach <= 0.03 GROUP BY 1, 2),
        s AS (SELECT *, min(bin) FILTER (n > p) OVER (PARTITION BY vid) AS stop FROM v)
        SELECT vid, sum(p)::BIGINT AS present, sum(n)::BIGINT AS absent, any_value(stop) * {RAY_RULE.resolution} AS closest_absent, max(bin) FILTER (p > n AND (stop IS NULL OR bin < stop)) * {RAY_RULE.resolution} AS furthest_persistent FROM s GROUP BY vid""",
    "stream_persistent_states": TRACKS["object_persistent_states"],
    # the watermark is the newest stamp in whole milliseconds
    "stream_active_window": f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {2 * HOUR} AS gap FROM e),
        i AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g), f AS (SELECT *, first_value(value) OVER (PARTITION BY user_id, k ORDER BY t, event_id) AS v0 FROM i)
        SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, least(count(*) / 6.0, 1.0)::DOUBLE AS confidence, round(max(abs(value - v0)), 9) AS far, max(abs(value - v0)) >= 50 AS dynamic
        FROM f GROUP BY user_id, k HAVING max(t) < (SELECT max(t) // 1000 * 1000 FROM e) - {2 * HOUR}""",
    "stream_incremental_changes": BATCH["change_scan_forward"],
    "stream_object_state": BATCH["object_state_fold"],
    "stream_tracker_activity": f"SELECT * FROM ({BATCH['session_windows']}) WHERE last_end <= (SELECT epoch_us(max(ts)) FROM events)",
}
