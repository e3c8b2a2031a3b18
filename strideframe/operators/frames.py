"""Frame selection: sampling, filters, greedy diversity, contact moments, key frames and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from strideframe.functions.fold import Carried, Machine, bound, fold
from strideframe.functions.blocks import by_frame

BY_VIDEO = "video_id"


def sample_interval(frames: DataFrame, fps: float, interval: float) -> DataFrame:
    """Every so many frames one, numbered, with its time."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    step = max(round(fps * interval), 1) if fps > 0 else 1
    kept = frames.where(F.col("frame_index") % step == 0).withColumn("saved_index", (F.row_number().over(by_frame()) - 1).cast("bigint"))
    return kept.withColumn("timestamp", F.col("frame_index") / fps if fps > 0 else F.col("saved_index") * interval)


def keep_or_all(frames: DataFrame, wanted: Column, *keys: str) -> DataFrame:
    """Rows that are wanted; all rows of a key none of whose rows is."""
    some = F.max(F.coalesce(wanted, F.lit(False)).cast("int")).over(Window.partitionBy(*(keys or (BY_VIDEO,))))
    return frames.withColumn("_some", some).where(wanted | (F.col("_some") == 0)).drop("_some")


def low_motion(frames: DataFrame, threshold: float = 5.0) -> DataFrame:
    return keep_or_all(frames, F.col("motion_score") < threshold)


def similarity(a: Column, b: Column, least: float = 0.5) -> Column:
    """Of two frames' landmark arrays (name, x, y, visibility): 1 / (1 + 2 mean distance) over what both see; 0 if nothing."""
    seen = lambda ps: F.filter(ps, lambda p: p["visibility"] >= least)
    other = F.map_from_entries(F.transform(seen(b), lambda q: F.struct(q["name"], F.struct(q["x"].alias("x"), q["y"].alias("y")))))
    d = F.filter(F.transform(seen(a), lambda p: F.hypot(p["x"] - F.try_element_at(other, p["name"])["x"], p["y"] - F.try_element_at(other, p["name"])["y"])), lambda x: x.isNotNull())
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    return F.when(F.size(d) > 0, 1 / (1 + 2 * mean)).otherwise(0.0)


def consecutive_similarity(landmarks: DataFrame, least: float = 0.5) -> DataFrame:
    """Similarity of each frame to the one before, by a join on video, name and frame."""
    now = landmarks.where(F.col("visibility") >= least).select("video_id", "frame_index", "name", "x", "y")
    old = now.select("video_id", (F.col("frame_index") + 1).alias("frame_index"), "name", F.col("x").alias("x0"), F.col("y").alias("y0"))
    mean = now.join(old.hint("merge"), ["video_id", "frame_index", "name"]).groupBy("video_id", "frame_index").agg(F.avg(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).alias("d"))
    every = landmarks.select("video_id", "frame_index").distinct()
    return every.join(mean.hint("merge"), ["video_id", "frame_index"], "left").select("video_id", "frame_index", F.coalesce(1 / (1 + 2 * F.col("d")), F.lit(0.0)).alias("similarity"))


KEEP = StructType([StructField("kept", BooleanType())])


class Diverse:
    """State: the last kept frame and its seen landmarks."""

    def __init__(self, threshold: float, gap: int, least: float):
        self.threshold, self.gap, self.least = threshold, gap, least

    def __call__(self, state, row):
        frame, points = row
        mine = {p["name"]: (p["x"], p["y"]) for p in points if p["visibility"] >= self.least} if points else {}
        if state is None:
            return (frame, mine), (True,)
        shared = [n for n in mine if n in state[1]]
        mean = sum(((mine[n][0] - state[1][n][0]) ** 2 + (mine[n][1] - state[1][n][1]) ** 2) ** 0.5 for n in shared) / len(shared) if shared else None
        near = 1 / (1 + 2 * mean) if mean is not None else 0.0
        if near < self.threshold and frame - state[0] >= self.gap:
            return (frame, mine), (True,)
        return state, (False,)


def diverse(frames: DataFrame, threshold: float = 0.8, gap: int = 5, least: float = 0.5) -> DataFrame:
    """Adds kept: the first frame, then each unlike enough and far enough from the last kept. frames: landmarks array."""
    return fold(frames, ["video_id"], ["frame_index"], ["frame_index", "landmarks"], KEEP, Diverse(threshold, gap, least))


class Apart(Machine):
    """State: the last kept frame. It matters up to a block's first kept frame, which is among the first ``gap`` and one more:
    the summary is the last kept frame for each of them."""

    def __init__(self, gap: int):
        self.gap = gap

    def __call__(self, state, row):
        (frame,) = row
        keep = state is None or frame - state[0] >= self.gap
        return ((frame,) if keep else state), (keep,)

    def summary(self, rows):
        heads, last, opened = [], [], True
        for k, (frame,) in enumerate(rows):
            first = frame if k == 0 else first
            last = [frame if frame - x >= self.gap else x for x in last]
            if opened:
                heads.append(frame)
                last.append(frame)
                opened = frame - first < self.gap - 1
        return list(zip(heads, last, strict=True))

    def after(self, summary, state):
        return next(((last,) for head, last in summary if head - state[0] >= self.gap), state)


def spaced(frames: DataFrame, gap: int = 5) -> DataFrame:
    return fold(frames, ["video_id"], ["frame_index"], ["frame_index"], KEEP, Apart(gap))


def at_least_three(frames: DataFrame) -> DataFrame:
    """Where fewer than three are kept, three spread over the video are kept instead."""
    all_ = Window.partitionBy("video_id")
    n, kept, k = F.count(F.lit(1)).over(all_), F.sum(F.col("kept").cast("int")).over(all_), F.row_number().over(by_frame()) - 1
    out = frames.select("*", n.alias("_n"), kept.alias("_kept"), k.alias("_k"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    spread = (F.col("_k") % step == 0) & (F.col("_k") / step < 3)
    return out.withColumn("kept", F.when(F.col("_kept") < 3, spread).otherwise(F.col("kept"))).drop("_n", "_kept", "_k")


FASTEST = ("left_wrist", "right_wrist", "left_ankle", "right_ankle")


def limb_velocity(landmarks: DataFrame, least: float = 0.5) -> DataFrame:
    """Step of wrists and ankles between neighbouring frames, a column each, and their largest; 0 where a side is not seen."""
    point = lambda n: F.max(F.when((F.col("name") == n) & (F.col("visibility") >= least), F.struct("x", "y")))
    wide = landmarks.groupBy("video_id", "frame_index").agg(*[point(n).alias(n) for n in FASTEST])
    out = wide.withColumns({f"_{n}x": F.col(f"{n}.x") for n in FASTEST} | {f"_{n}y": F.col(f"{n}.y") for n in FASTEST})
    step = lambda n: F.coalesce(F.hypot(F.col(f"_{n}x") - F.lag(f"_{n}x").over(by_frame()), F.col(f"_{n}y") - F.lag(f"_{n}y").over(by_frame())), F.lit(0.0))
    out = out.select("video_id", "frame_index", *[step(n).alias(f"{n}_velocity") for n in FASTEST])
    return out.withColumn("velocity", F.greatest(*[F.col(f"{n}_velocity") for n in FASTEST]))


class Moments(Machine):
    """State: velocity before, whether holding, since when. After a block's first frame the velocity is known."""

    def __init__(self, spike: float, low: float, frames: int):
        self.spike, self.low, self.n = spike, low, frames

    def __call__(self, state, row):
        i, now = row
        if state is None:
            return (now, False, 0), (None,)
        old, holding, begun = state
        i_held = None if isinstance(begun, Carried) else i - begun
        if old > self.spike and now < self.low:
            return (now, True, i), ("contact",)
        if holding and old < self.low and now > self.spike:
            return (now, False, begun), ("release" if i_held is not None and i_held >= self.n else None,)
        return (now, holding, begun), ("middle" if holding and i_held == self.n // 2 else None,)

    def summary(self, rows):
        first = next(rows)
        return first, self.lead([(first[1], holding, Carried(2)) for holding in (False, True)], rows)

    def after(self, summary, state):
        first, leads = summary
        state = self(state, first)[0]
        return bound(leads[state[1]], state)


def contact_moments(velocities: DataFrame, spike: float = 0.05, low: float = 0.01, frames: int = 3) -> DataFrame:
    out = fold(velocities, ["video_id"], ["frame_index"], ["frame_index", "velocity"], StructType([StructField("moment", StringType())]), Moments(spike, low, frames))
    return out.where("moment IS NOT NULL").select("video_id", "frame_index", "moment")


def cap(frames: DataFrame, most: int = 30) -> DataFrame:
    """An even stride over more than ``most`` frames."""
    rows = frames.withColumn("_k", F.row_number().over(by_frame()) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    stride = F.floor(F.col("_n") / most)
    return rows.where((F.col("_n") <= most) | ((F.col("_k") % stride == 0) & (F.col("_k") / stride < most))).drop("_k", "_n")


def detector_selection(detections: DataFrame, required: tuple[str, ...], targets: tuple[str, ...], least: float = 0.35, most: int | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """video_id, frame_index, score, position: frames with a required and a target label, else all; optionally the best ones, in frame order."""
    label = F.lower("label")
    if aliases:
        label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]), label), label)
    rows = detections.withColumn("_l", label)
    best = lambda names: F.max(F.when(F.col("_l").isin(*names), F.col("confidence")))
    frames = rows.groupBy("video_id", "frame_index").agg((best(required) if required else F.lit(1.0)).alias("_r"), (best(targets) if targets else F.max("confidence")).alias("score"))
    ok = (F.lit(not required) | F.coalesce(F.col("_r") >= least, F.lit(False))) & (F.lit(not targets) | F.coalesce(F.col("score") >= least, F.lit(False)))
    kept = keep_or_all(frames.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("_ok", ok), F.col("_ok"))
    if most is not None:
        kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "frame_index"))).where(F.col("_k") <= most)
    return kept.select("video_id", "frame_index", "score", (F.row_number().over(by_frame()) - 1).cast("bigint").alias("position"))


def grey_difference(images: DataFrame) -> DataFrame:
    """Mean absolute change of a pixel array since the last readable image, in shares of 255; 0 for the first and for unreadable ones."""
    old = F.last("pixels", True).over(by_frame().rowsBetween(Window.unboundedPreceding, -1))
    rows = images.withColumn("_old", old)
    total = F.aggregate(F.zip_with("pixels", "_old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("difference", F.coalesce(total / F.size("pixels") / 255, F.lit(0.0))).drop("_old")


def zip_manifest(manifest: DataFrame, motion: DataFrame, flags: DataFrame) -> DataFrame:
    """Frames with motion and hold flag by their place, as many as the shortest has."""
    key = ["video_id", "ordinal"]
    return manifest.join(motion.hint("merge"), key).join(flags.hint("merge"), key)


def key_frames(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.where(F.col("probability") >= threshold)


def filter_manifest(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """The manifest's frames that are selected; all of a video's frames if none is."""
    marked = manifest.join(selected.select("video_id", "relative_path", F.lit(True).alias("_in")).distinct().hint("merge"), ["video_id", "relative_path"], "left")
    return keep_or_all(marked, F.coalesce(F.col("_in"), F.lit(False))).drop("_in")


def key_labels(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds label 1.0 for chosen file names; fails if there is none."""
    out = frames.join(chosen.select("file_name", F.lit(1.0).alias("label")).distinct().hint("merge"), "file_name", "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    if not out.where("label = 1.0").limit(1).count():
        raise ValueError("no frame was chosen")
    return out
