"""Activity segments, contact steps, and the metrics of frames within segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from strideframe.functions.fold import Machine, fold
from strideframe.functions.blocks import by_frame, in_blocks
from strideframe.params import JOINTS, LIMBS



def motion(frames: DataFrame, joints: tuple[str, ...] = tuple(JOINTS), targets: tuple[str, ...] = tuple(f"{p}_target" for p in LIMBS)) -> DataFrame:
    """motion_score: mean of what is known of the changes of centre and joints (in half turns); hold_changed: a target differs."""
    step = lambda c, scale=1.0: F.abs(F.col(c) - F.lag(c).over(by_frame())) / scale
    parts = [step("com_x"), step("com_y"), *[step(j, 180.0) for j in joints]]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    changed = F.lit(False)
    for t in targets:
        changed = changed | ~F.col(t).eqNullSafe(F.lag(t).over(by_frame()))
    first = F.row_number().over(by_frame()) == 1
    return in_blocks(frames, lambda f: f.select("*", F.when(n > 0, total / n).otherwise(0.0).alias("motion_score"), (~first & changed).alias("hold_changed")), 1)


def activity_scores(frames: DataFrame, hold_bonus: float = 0.12) -> DataFrame:
    return frames.withColumn("activity", F.greatest(F.lit(0.0), F.col("motion_score")) + F.when(F.col("hold_changed"), hold_bonus).otherwise(0.0))


def thresholds(scored: DataFrame, percentile: float = 75.0, least: float = 0.05, given: float | None = None) -> DataFrame:
    """video_id, threshold: the given one, else a percentile of the scores (their maximum where that is too low), at least ``least``."""
    if given is not None:
        value = F.lit(float(given))
    else:
        p = F.percentile("activity", F.lit(percentile / 100))
        value = F.when(p <= least, F.max("activity")).otherwise(p)
    return scored.groupBy("video_id").agg(F.greatest(F.lit(least), F.max(value) if given is not None else value).alias("threshold"))


class Sustain(Machine):
    """State: label, frames of movement and of rest in a row, up to ``frames``. Output: where the new segment begins, at a flip."""

    def __init__(self, frames: int):
        self.n = frames

    def entries(self):
        return [(label, *run) for label in ("movement", "rest") for k in range(self.n + 1) for run in dict.fromkeys([(k, 0), (0, k)])]

    def __call__(self, state, row):
        frame, label = row
        if state is None:
            return (label, 0, 0), (None,)
        current, active, rest = state
        active, rest = (min(active + 1, self.n), 0) if label == "movement" else (0, min(rest + 1, self.n))
        if label != current and max(active, rest) >= self.n:
            return (label, active, rest), (frame - self.n + 1,)
        return (current, active, rest), (None,)


def activity_segments(scored: DataFrame, limits: DataFrame, min_duration: float = 0.5, sustain: int = 1) -> DataFrame:
    """video_id, segment_id, start_index, end_index, start_time, end_time, label. Neighbours share their boundary frame;
    short segments are dropped, the last one only if another is left."""
    rows = scored.join(limits.hint("merge"), "video_id").select("video_id", "frame_index", "ts", F.when(F.col("activity") >= F.col("threshold"), "movement").otherwise("rest").alias("label"))
    if sustain == 1:
        flips = rows.withColumn("begin", F.when(F.lag("label").over(by_frame()).isNull() | (F.col("label") != F.lag("label").over(by_frame())), F.col("frame_index")))
    else:
        out = fold(rows, ["video_id"], ["frame_index"], ["frame_index", "label"], StructType([StructField("flip", LongType())]), Sustain(sustain))
        flips = out.withColumn("begin", F.coalesce("flip", F.when(F.row_number().over(by_frame()) == 1, F.col("frame_index"))))
    ends = rows.groupBy("video_id").agg(F.max("frame_index").alias("last"))
    starts = flips.where("begin IS NOT NULL").select("video_id", F.col("begin").alias("start_index"), "label")
    by = Window.partitionBy("video_id").orderBy("start_index")
    spans = starts.withColumn("next", F.lead("start_index").over(by)).join(ends.hint("merge"), "video_id").withColumn("end_index", F.coalesce("next", "last"))
    at = rows.select("video_id", F.col("frame_index").alias("at"), F.col("ts").alias("time"))
    timed = spans.join(at.select("video_id", F.col("at").alias("start_index"), F.col("time").alias("start_time")).hint("merge"), ["video_id", "start_index"]).join(at.select("video_id", F.col("at").alias("end_index"), F.col("time").alias("end_time")).hint("merge"), ["video_id", "end_index"])
    long = F.col("end_time") - F.col("start_time") >= min_duration
    others = F.max((long & F.col("next").isNotNull()).cast("int")).over(Window.partitionBy("video_id"))
    kept = timed.withColumn("_others", others).where(long | (F.col("next").isNull() & (F.col("_others") == 0)))
    return kept.select("video_id", (F.row_number().over(by) - 1).cast("bigint").alias("segment_id"), "start_index", "end_index", "start_time", "end_time", "label")


CUT = StructType([StructField("cut", BooleanType()), StructField("from_index", LongType()), StructField("open_index", LongType())])


class StepCut(Machine):
    """State: start and its time of the open step, whether any step ended. A step ends at a candidate frame. Times rise with frames.

    What enters a block matters up to the block's first cut alone, which comes within ``max_duration`` or never: its summary
    is the state in which each candidate of that time leaves the block if it is the first cut."""

    def __init__(self, min_frames: int, max_duration: float):
        self.min_frames, self.max_duration = min_frames, max_duration

    def __call__(self, state, row):
        frame, ts, candidate = row
        if state is None:
            return (frame, ts, False), (False, frame, frame)
        start, began, some = state
        if candidate and self.cuts(state, frame, ts):
            return (frame, ts, True), (True, start, frame)
        return state, (False, start, start)

    def cuts(self, state, frame, ts):
        start, began, some = state
        return (frame - start >= self.min_frames or not some) and max(0.0, ts - began) <= self.max_duration

    def summary(self, rows):
        heads, open_, until = [], {}, None  # open_: of each state the heads that have come to it
        for frame, ts, candidate in rows:
            until = ts + self.max_duration if until is None else until
            if not candidate:
                continue
            moved = {}
            for state, mine in open_.items():
                moved.setdefault((frame, ts, True) if self.cuts(state, frame, ts) else state, []).extend(mine)
            if ts <= until:
                moved.setdefault((frame, ts, True), []).append(len(heads))
                heads.append((frame, ts))
            open_ = moved
        left = {h: state for state, mine in open_.items() for h in mine}
        return [(*head, left[k]) for k, head in enumerate(heads)]

    def after(self, summary, state):
        return next((left for frame, ts, left in summary if self.cuts(state, frame, ts)), state)


def contact_steps(rows: DataFrame, fps: float = 25.0, min_duration: float = 0.2, max_duration: float = 4.0) -> DataFrame:
    """video_id, step_id, start_index, end_index, start_time, end_time: a step ends where one limb's contact changes with two in support."""
    differs = lambda p: (~F.col(f"{p}_contact_type").eqNullSafe(F.lag(f"{p}_contact_type").over(by_frame())) | ~F.col(f"{p}_contact_hold").eqNullSafe(F.lag(f"{p}_contact_hold").over(by_frame()))).cast("int")
    changed = sum((differs(p) for p in LIMBS[1:]), differs(LIMBS[0]))
    support = sum((F.coalesce(F.col(f"{p}_contact_on"), F.lit(0)) for p in LIMBS[1:]), F.coalesce(F.col(f"{LIMBS[0]}_contact_on"), F.lit(0)))
    marked = rows.select("video_id", "frame_index", "ts", ((F.row_number().over(by_frame()) > 1) & (changed == 1) & (support >= 2)).alias("candidate"))
    cuts = fold(marked, ["video_id"], ["frame_index"], ["frame_index", "ts", "candidate"], CUT, StepCut(max(1, int(min_duration * fps)), max_duration))
    last = F.lead("frame_index").over(by_frame()).isNull()
    ended = cuts.withColumn("_last", last).where(F.col("cut") | F.col("_last")).select("video_id", F.col("from_index").alias("start_index"), F.col("frame_index").alias("end_index"), F.col("ts").alias("end_time"))
    begun = cuts.select("video_id", F.col("frame_index").alias("start_index"), F.col("ts").alias("start_time"))
    by = Window.partitionBy("video_id").orderBy("end_index")
    return ended.join(begun.hint("merge"), ["video_id", "start_index"]).select("video_id", (F.row_number().over(by) - 1).cast("bigint").alias("step_id"), "start_index", "end_index", "start_time", "end_time")


def frames_of(segments: DataFrame, key: str = "segment_id") -> DataFrame:
    """One row a segment and frame, both ends included: joins by equality, however long a video is."""
    return segments.select("video_id", key, "start_index", "end_index", F.explode(F.sequence("start_index", "end_index")).alias("frame_index"))


def within(frames: DataFrame, segments: DataFrame, key: str = "segment_id") -> DataFrame:
    return frames.join(frames_of(segments, key).hint("merge"), ["video_id", "frame_index"])


def label_steps(rows: DataFrame, steps: DataFrame, strict: bool = True) -> DataFrame:
    """Adds the label of each step, first match. ``strict``: arms of changed hands and feet see no change, as a step
    starts where the one before ended; otherwise the frame before the cut is compared."""
    support = sum((F.coalesce(F.col(f"{p}_contact_on"), F.lit(0)) for p in LIMBS[1:]), F.coalesce(F.col(f"{LIMBS[0]}_contact_on"), F.lit(0)))
    state = lambda limbs: F.struct(*[F.col(f"{p}_contact_{c}") for p in limbs for c in ("type", "hold")])
    marked = rows.select("video_id", "frame_index", "com_y", "com_speed", support.alias("support"), (~state(LIMBS[:2]).eqNullSafe(F.lag(state(LIMBS[:2])).over(by_frame()))).alias("hands"), (~state(LIMBS[2:]).eqNullSafe(F.lag(state(LIMBS[2:])).over(by_frame()))).alias("feet"))
    first, final = F.col("frame_index") == F.col("start_index"), F.col("frame_index") == F.col("end_index")
    facts = within(marked, steps, "step_id").groupBy("video_id", "step_id").agg(
        F.coalesce(F.avg("com_speed"), F.lit(0.0)).alias("speed"), F.max(F.when(first, F.col("support"))).alias("s0"), F.max(F.when(final, F.col("support"))).alias("s1"),
        F.max(F.when(final, F.col("com_y"))).alias("y1"), F.max(F.when(first, F.col("hands"))).alias("hands"), F.max(F.when(first, F.col("feet"))).alias("feet"),
    )
    moved = lambda c: F.lit(False) if strict else F.col(c) & (F.col("step_id") > 0)
    hands, feet = moved("hands"), moved("feet")
    label = (
        F.when((F.col("speed") < 0.01) & (F.col("s0") >= 3), "rest").when((F.col("y1") < 0.3) & (F.col("speed") < 0.02) & (F.col("s1") >= 3), "finish")
        .when(feet & ~hands, "foot_adjust").when((F.col("s1") > F.col("s0")) | ((F.col("speed") > 0.05) & hands), "reach")
        .when((F.col("s0") == F.col("s1")) & (F.col("speed") < 0.03), "stabilize").when((hands & feet) | (F.col("speed") > 0.08), "dynamic_move").otherwise("movement")
    )
    return steps.join(facts.select("video_id", "step_id", label.alias("label")).hint("merge"), ["video_id", "step_id"])


def step_of_frame(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds step_id; the shared frame belongs to the later step."""
    ids = frames_of(steps, "step_id").groupBy("video_id", "frame_index").agg(F.max("step_id").alias("step_id"))
    return rows.join(ids.hint("merge"), ["video_id", "frame_index"], "left")


def segment_metrics(frames: DataFrame, segments: DataFrame, joints: tuple[str, ...] = tuple(JOINTS)) -> DataFrame:
    """Frames, duration, detection, path of the centre, range and speed of joints, and contact changes of each segment."""
    key = ["video_id", "segment_id"]
    by = Window.partitionBy(*key).orderBy("frame_index")
    rows = within(frames, segments)
    com = F.col("com_x").isNotNull() & F.col("com_y").isNotNull()
    last_com = lambda c: F.last(F.when(com, F.col(c)), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    hop = F.when(com, F.hypot(F.col("com_x") - last_com("com_x"), F.col("com_y") - last_com("com_y")))
    def speed(j: str) -> Column:
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        old, when = F.last(j, True).over(before), F.last(F.when(F.col(j).isNotNull(), F.col("ts")), True).over(before)
        return F.when(F.col("ts") > when, F.abs(F.col(j) - old) / (F.col("ts") - when))
    change = lambda p: (F.coalesce(f"{p}_target", F.lit("")) != F.lag(F.coalesce(f"{p}_target", F.lit(""))).over(by)).cast("int")
    rows = rows.select("*", hop.alias("_hop"), *[speed(j).alias(f"_v_{j}") for j in joints], *[change(p).alias(f"_c_{p}") for p in LIMBS])
    point = F.struct("com_x", "com_y")
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("frame_count"), F.greatest(F.lit(0.0), F.max("ts") - F.min("ts")).alias("duration"), F.avg(F.coalesce("detection_score", F.lit(0.0))).alias("mean_detection"),
        F.count(F.when(com, 1)).alias("_n"), F.min_by(point, F.when(com, F.col("frame_index"))).alias("_a"), F.max_by(point, F.when(com, F.col("frame_index"))).alias("_b"), F.sum("_hop").alias("com_path"),
        *[(F.max(j) - F.min(j)).alias(f"{j}_range") for j in joints], *[F.avg(f"_v_{j}").alias(f"{j}_velocity") for j in joints],
        *[F.coalesce(F.sum(f"_c_{p}"), F.lit(0)).alias(f"{p}_contact_changes") for p in LIMBS],
    )
    two = F.col("_n") >= 2
    net = F.hypot(F.col("_b.com_x") - F.col("_a.com_x"), F.col("_b.com_y") - F.col("_a.com_y"))
    return out.withColumn("com_displacement", F.when(two, net)).withColumn("com_path", F.when(two, F.col("com_path"))).drop("_n", "_a", "_b")
