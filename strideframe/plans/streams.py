"""Queries over the streaming operators: a view is written in parts to the shared folder, streamed through, and the result read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.tables import shared_folder, stored
from strideframe.operators import contacts, features, kinematics
from strideframe.params import LIMBS
from strideframe.plans import body as b
from strideframe.plans import fixtures as fx
from strideframe.plans import machines as mc
from strideframe.plans import steps as st
from strideframe.plans.fixtures import sql
from strideframe.streaming import live

FILE_ROWS = 500_000
QUERIES: dict = {}
SQL: dict[str, str] = {}
W = b.W


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def streamed(df: DataFrame, order: str, operator, parts: int = 3, mode: str = "append") -> DataFrame:
    """``operator`` over ``df`` as a stream of ``parts`` batches in the order of a column; what it emits, read back."""
    spark, root = df.sparkSession, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    kept = stored(df, "source")
    cuts = kept.select(F.percentile_approx(F.col(order).cast("double"), [(i + 1) / parts for i in range(parts - 1)])).first()[0]
    at = F.col(order).cast("double")
    inside = [(at > cuts[i - 1] if i else F.lit(True)) & (at <= cuts[i] if i < parts - 1 else F.lit(True)) for i in range(parts)]
    files = max(1, min(kept.select(*[F.count_if(x) for x in inside]).first()) // FILE_ROWS)  # of each batch; so many rows that none is empty
    for rows in inside:
        kept.where(rows).repartition(files).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    out = operator(source)
    writer = out.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{root}/out")
    else:  # each batch's rows replace those of the keys they update: the last batch's are what is left
        writer = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{root}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(out.schema if mode == "append" else out.schema.add("_batch", "long")).parquet(f"{root}/out")


_POINT = sql(b.BASE, ", pts AS MATERIALIZED (SELECT video_id, frame_index, com_x, com_y FROM body), ema AS (SELECT video_id, frame_index, com_x AS s_x, com_y AS s_y FROM pts WHERE frame_index = 0 UNION ALL SELECT p.video_id, p.frame_index, 0.6::DOUBLE * com_x + 0.4::DOUBLE * s_x, 0.6::DOUBLE * com_y + 0.4::DOUBLE * s_y FROM ema e JOIN pts p ON p.video_id = e.video_id AND p.frame_index = e.frame_index + 1), v AS (SELECT *, "
  + ", ".join(f"(s_{c} - lag(s_{c}) {W}) * 25 AS v{c}" for c in "xy") + " FROM ema), a AS (SELECT *, " + ", ".join(f"(v{c} - lag(v{c}) {W}) * 25 AS a{c}" for c in "xy") + " FROM v), j AS (SELECT *, " + ", ".join(f"(a{c} - lag(a{c}) {W}) * 25 AS j{c}" for c in "xy") + " FROM a) SELECT video_id, frame_index, "
  + ", ".join(f"round({c}, 4) AS {c}" for c in ("s_x", "s_y", "vx", "vy", "ax", "ay", "jx", "jy")) + ", CAST(0 AS BIGINT) AS late FROM j")


@query("live_kinematics", _POINT)
def live_kinematics(spark, sf_dir):
    """Smoothed centre and its derivatives, in three batches."""
    pts = b.bodies(spark, sf_dir).select("video_id", "frame_index", F.col("com_x").alias("x"), F.col("com_y").alias("y"))
    out = streamed(pts, "frame_index", live.live_kinematics)
    return out.select("video_id", "frame_index", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 4).alias(c) for c in ("s_x", "s_y", "vx", "vy", "ax", "ay", "jx", "jy")], "late")


@query("live_late_frames", sql("contact_events contact_rows", "SELECT video_id, max(frame_index) AS last, count(*) AS frames, CAST(sum(CASE WHEN frame_index % 10 = 3 AND frame_index + 6 <= m THEN 1 ELSE 0 END) AS BIGINT) AS late FROM (SELECT *, max(frame_index) OVER (PARTITION BY video_id) AS m FROM contact_rows) GROUP BY video_id"))
def live_late_frames(spark, sf_dir):
    """Frames that come again five frames later are dropped and counted."""
    rows = fx.contact_rows(spark, sf_dir).select("video_id", "frame_index", F.col("com_x").alias("x"), F.col("com_y").alias("y"))
    rows = stored(rows, "rows").withColumn("when", F.col("frame_index").cast("double"))
    last = stored(rows.groupBy("video_id").agg(F.max("frame_index").alias("_m")), "last")
    again = rows.join(last.hint("merge"), "video_id").where((F.col("frame_index") % 10 == 3) & (F.col("frame_index") + 6 <= F.col("_m"))).drop("_m").withColumn("when", F.col("when") + 5.5)
    out = streamed(rows.unionByName(again), "when", live.live_kinematics)
    return out.groupBy("video_id").agg(F.max("frame_index").alias("last"), F.count(F.lit(1)).alias("frames"), F.max("late").alias("late"))


@query("live_without_repeats", sql("contact_events", "SELECT user_id AS video_id, frame_index FROM contact_events"))
def live_without_repeats(spark, sf_dir):
    """Each event twice in the stream, once in the result."""
    e = _events(spark, sf_dir, "video_id", "frame_index", "ts")
    return streamed(e.union(e), "ts", lambda s: live.without_repeats(s, "1 hour")).select("video_id", "frame_index")


def _events(spark, sf_dir, *columns):
    e = fx.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("motion"))
    return fx.contact_rows(spark, sf_dir).select("video_id", "frame_index", "event_id").join(stored(e, "events").hint("merge"), "event_id").select(*(columns or ("video_id", "ts", "motion")))


@query("live_contacts", sql(b.NEARED, mc.CONTACTED + " SELECT video_id, limb, frame_index, held::INT AS contact_on, kind AS contact_type, hold AS contact_hold, CAST(0 AS BIGINT) AS late FROM machine WHERE frame_index >= 0"))
def live_contacts(spark, sf_dir):
    """T3."""
    rows = contacts.limb_rows(kinematics.derivatives(features.nearest_holds(b.bodies(spark, sf_dir), fx.holds(spark, sf_dir)), 1.0))
    return streamed(rows, "frame_index", lambda s: live.live_contacts(s, b.TOUCHY))


@query("live_windows", "SELECT video_id, day, count(*) AS frames, round(avg(v), 6) AS mean_motion, round(max(v), 6) AS max_motion FROM (SELECT user_id AS video_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(value AS DOUBLE) AS v FROM events) WHERE (day + 1) * 86400 <= (SELECT max(epoch(ts)) - 60 FROM events) GROUP BY video_id, day")
def live_windows(spark, sf_dir):
    """T4: days that have ended a minute before the last event."""
    out = streamed(_events(spark, sf_dir), "ts", lambda s: live.motion_windows(s, "1 day"))
    return b.rounded(out.select("video_id", F.floor(F.unix_seconds("start") / 86400).alias("day"), "frames", "mean_motion", "max_motion"))


@query("live_bouts", "WITH m AS (SELECT user_id AS video_id, ts, CAST(value AS DOUBLE) AS v FROM events WHERE value > 0), g AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(prev) < 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY ts) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY video_id ORDER BY ts) AS prev FROM m)) SELECT video_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS begun, count(*) AS frames, round(sum(v), 4) AS motion FROM g GROUP BY video_id, k HAVING epoch(max(ts)) + 86400 <= (SELECT max(epoch(ts)) - 60 FROM m)")
def live_bouts(spark, sf_dir):
    """T4: sessions with gaps of a day that have ended a minute before the last event."""
    out = streamed(_events(spark, sf_dir), "ts", lambda s: live.movement_bouts(s, "1 day"))
    return out.select("video_id", F.unix_seconds("start").alias("begun"), "frames", F.round("motion", 4).alias("motion"))


@query("live_tracks")
def live_tracks(spark, sf_dir):
    """T5: the tracks after the last batch; tested against the batch form."""
    out = streamed(fx.tracked_boxes(spark, sf_dir), "frame_index", live.live_tracks, mode="update")
    last = out.groupBy("video_id").agg(F.max("_batch").alias("_batch"))
    return b.rounded(out.join(stored(last, "last").hint("merge"), ["video_id", "_batch"]).drop("_batch"))


@query("live_next_holds", st.SQL["next_holds"])
def live_next_holds(spark, sf_dir):
    """T6."""
    frames = st.touching(spark, sf_dir).select("video_id", "frame_index", "com_x", "com_y", *[f"{p}_contact_hold" for p in LIMBS])
    return b.rounded(streamed(frames, "frame_index", lambda s: live.live_next_holds(s, fx.holds(spark, sf_dir))))
