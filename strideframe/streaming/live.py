"""The causal operators as Structured Streaming queries, equal to their batch forms.

State is kept by video (or video and limb) in the state store. Frames that arrive in a batch are put in frame
order first; a frame not newer than the last one emitted is late: it is dropped and counted. ``idle`` ends the
state of a video that has no new frames, see ``keyed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators.contacts import ContactStep
from strideframe.operators.holds import TRACKS, Tracker, advance_videos
from strideframe.operators.recommend import next_holds_by_boxes
from strideframe.params import ContactParams, TrackerParams
from strideframe.streaming.keyed import keyed

KINEMATICS = "video_id long, frame_index long, s_x double, s_y double, vx double, vy double, ax double, ay double, jx double, jy double, late long"


def live_kinematics(points: DataFrame, alpha: float = 0.6, fps: float = 25.0, idle: str | None = None) -> DataFrame:
    """Smoothed point, velocity, acceleration and jerk. points: video_id, frame_index, x, y. State: the last row and the count of late frames."""

    def step(keys, number, rows: pd.DataFrame, states):
        states = [(-1, 0, *[None] * 8) if s is None else s for s in states]
        by = np.lexsort((rows["frame_index"], number))
        out = []
        for k, (frame, x, y) in zip(number[by].tolist(), rows[["frame_index", "x", "y"]].iloc[by].itertuples(index=False, name=None), strict=True):
            last, late, *held = states[k]
            if frame <= last:
                states[k] = (last, late + 1, *held)
                continue
            old = held if last >= 0 and frame == last + 1 else [None] * 8
            now = [v if p is None or not 0 < alpha < 1 else alpha * v + (1 - alpha) * p for v, p in zip((x, y), old[:2], strict=True)]
            for order in range(3):  # each derivative from the one below it, now and before
                now += [None if p is None or q is None else (q - p) * fps for p, q in zip(old[2 * order : 2 * order + 2], now[2 * order : 2 * order + 2], strict=True)]
            out.append((keys[k][0], frame, *now, late))
            states[k] = (int(frame), late, *now)
        return states, pd.DataFrame(out, columns=[c.split()[0] for c in KINEMATICS.split(", ")])

    kept = "last long, late long, " + ", ".join(f"v{i} double" for i in range(8))
    return keyed(points, ["video_id"], step, KINEMATICS, kept, idle=idle)


def live_contacts(rows: DataFrame, params: ContactParams = ContactParams(), idle: str | None = None) -> DataFrame:
    """Contact hysteresis, and the late rows so far. rows: as ``limb_rows`` gives."""
    advance = ContactStep(params)
    out = "video_id long, limb string, frame_index long, contact_on int, contact_type string, contact_hold string, late long"

    def step(keys, number, rows: pd.DataFrame, states):
        states = [(-1, 0, None) if s is None else (s[0], s[1], tuple(s[2:])) for s in states]
        by = np.lexsort((rows["frame_index"], number))
        rows = rows[["frame_index", "limb", "distance", "speed", "body_scale", "z", "target"]].iloc[by].astype(object)
        rows = rows.where(rows.notna(), None)
        made = []
        for k, r in zip(number[by].tolist(), rows.itertuples(index=False, name=None), strict=True):
            last, late, held = states[k]
            if r[0] <= last:
                states[k] = (last, late + 1, held)
                continue
            held, (on, kind, hold) = advance(held, r[1:])
            states[k] = (int(r[0]), late, held)
            made.append((*keys[k], r[0], on, kind, hold, late))
        kept = [None if held is None else (last, late, *held) for last, late, held in states]
        return kept, pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return keyed(rows, ["video_id", "limb"], step, out, "last long, late long, on boolean, since int, pending int, kind string, hold string", idle=idle)


def without_repeats(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Frames repeated within the watermark once. frames: ts as TIMESTAMP."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "frame_index"])


def motion_windows(frames: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """T4: frames and mean and largest motion of each video in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = frames.withWatermark("ts", delay).groupBy("video_id", w.alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.avg("motion").alias("mean_motion"), F.max("motion").alias("max_motion"))
    return out.select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "mean_motion", "max_motion")


def movement_bouts(frames: DataFrame, gap: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """T4: sessions of moving frames (motion > 0). A session is defined by a gap, so it comes near activity segments but is not the same."""
    moving = frames.where(F.col("motion") > 0).withWatermark("ts", delay)
    out = moving.groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.sum("motion").alias("motion"))
    return out.select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "motion")


def live_tracks(boxes: DataFrame, params: TrackerParams = TrackerParams(), idle: str | None = None) -> DataFrame:
    """T5: confirmed tracks after each batch (update mode). State: the last frame, the number of tracks made, and the live
    tracks, which go when they have been missed too often; a frame must arrive whole. The videos of a bucket advance together."""

    def step(keys, number, rows: pd.DataFrame, states):
        states = [(-1, 0, [], [], []) if s is None else s for s in states]
        last = np.array([s[0] for s in states])
        new = rows["frame_index"].to_numpy() > last[number]
        rows, number = rows[new], number[new]
        by = np.lexsort((rows["y_center"], rows["x_center"], rows["frame_index"], number))
        rows, number = rows.iloc[by], number[by]

        def begin(order: np.ndarray) -> Tracker:
            tracker = Tracker(params, len(order))
            tracker.unpack([states[k][1] for k in order], [states[k][2:] for k in order])
            return tracker

        order, ended = advance_videos(rows, number, len(keys), begin)
        np.maximum.at(last, number, rows["frame_index"].to_numpy())
        tracks = {k: t for tracker in ended for k, t in tracker.packed().items()}
        kept: list = [None] * len(keys)
        for n, k in enumerate(order.tolist()):
            kept[k] = (int(last[k]), int(ended[-1].made[n]), *tracks.get(n, ([], [], [])))
        return kept, pd.DataFrame([(keys[order[t[0]]][0], *t[1:]) for tracker in ended for t in tracker.confirmed()], columns=TRACKS.names)

    return keyed(boxes, ["video_id"], step, TRACKS, "last long, made long, counts array<long>, numbers array<double>, names array<string>", "update", idle)


def live_next_holds(frames: DataFrame, holds: DataFrame, k: int = 3) -> DataFrame:
    """The best next holds of each frame as it arrives: joins of the stream with a tree of the holds, see ``next_holds_by_boxes``."""
    return next_holds_by_boxes(frames, holds, k)
