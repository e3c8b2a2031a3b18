"""Body model, thresholds and weights. The values are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

# Landmarks, joints and the share of body mass near each landmark.
LANDMARKS = (
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip",
    "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle", "left_foot_index", "right_foot_index",
)
JOINTS = {
    "left_elbow_angle": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_angle": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_knee_angle": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_angle": ("right_hip", "right_knee", "right_ankle"),
    "left_hip_angle": ("left_shoulder", "left_hip", "left_knee"),
    "right_hip_angle": ("right_shoulder", "right_hip", "right_knee"),
    "left_shoulder_angle": ("left_hip", "left_shoulder", "left_elbow"),
    "right_shoulder_angle": ("right_hip", "right_shoulder", "right_elbow"),
}
MASS = {
    "left_shoulder": 0.08, "right_shoulder": 0.08, "left_elbow": 0.05, "right_elbow": 0.05, "left_wrist": 0.02,
    "right_wrist": 0.02, "left_hip": 0.14, "right_hip": 0.14, "left_knee": 0.13, "right_knee": 0.13,
    "left_ankle": 0.08, "right_ankle": 0.08, "left_foot_index": 0.06, "right_foot_index": 0.06,
}
LIMBS = ("left_hand", "right_hand", "left_foot", "right_foot")
TRACKED = {
    "left_hand": "left_wrist", "right_hand": "right_wrist", "left_foot": "left_ankle",
    "right_foot": "right_ankle", "left_knee": "left_knee", "right_knee": "right_knee",
}
TOUCHING = {"left_hand": "left_wrist", "right_hand": "right_wrist", "left_foot": "left_foot_index", "right_foot": "right_foot_index"}
INCLINATIONS = {
    "torso_inclination": ("left_hip", "left_shoulder"),
    "spine_inclination": ("right_hip", "right_shoulder"),
    "hip_line_inclination": ("left_hip", "right_hip"),
    "shoulder_line_inclination": ("left_shoulder", "right_shoulder"),
}
# Types of holds and names of routes, in this order.
HOLD_TYPES = ("jug", "crimp", "sloper", "pinch", "foot_only", "volume", "unknown")
ROUTE_COLOURS = ("red", "blue", "green", "yellow", "orange", "purple", "pink", "white", "black", "gray")


@dataclass(frozen=True)
class ContactParams:
    r_on: float = 0.22
    r_off: float = 0.28
    v_hold: float = 0.03
    smear_distance: float = 0.25
    smear_z: float = 0.03
    min_on: int = 3


@dataclass(frozen=True)
class StepWeights:
    stability: float = 0.35
    path: float = 0.25
    support: float = 0.20
    wall: float = 0.10
    smoothness: float = 0.07
    reach: float = 0.03
    stability_alpha: float = 4.0
    reach_threshold: float = 1.1


@dataclass(frozen=True)
class PlannerParams:
    candidates: int = 10
    upward_bias: float = 0.3
    min_support: int = 2
    max_reach: float = 1.2
    polygon_tolerance: float = 0.15
    stability_alpha: float = 4.0
    jug_bonus: float = 0.05
    reach_bonus: float = 0.03
    top_k: int = 3


@dataclass(frozen=True)
class TrackerParams:
    min_iou: float = 0.5
    max_misses: int = 5
    min_hits: int = 3
    process_noise: float = 0.1
    measurement_noise: float = 0.5
