"""Settings with their defaults; a file's or a caller's values go over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Validation:
    iou_threshold: float = 0.4
    distance_threshold: float = 10.0
    interval: int = 20


@dataclass(frozen=True)
class Config:
    patch_size: int = 400
    patch_overlap: float = 0.05
    score_thresh: float = 0.1
    nms_thresh: float = 0.05
    mosaic_thresh: float = 0.15
    point_radius: float = 5.0
    detections_per_image: int = 300
    label_dict: dict = field(default_factory=lambda: {"Tree": 0})
    validation: Validation = Validation()


def load(*overrides: dict, base: Config = Config()) -> Config:
    """Later overrides win; label_dict is replaced, not merged; an unknown name is an error."""

    def over(at, values: dict):
        known = {f.name for f in fields(at)}
        unknown = set(values) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(at, **{k: over(getattr(at, k), v) if is_dataclass(getattr(at, k)) else v for k, v in values.items()})

    for values in overrides:
        base = over(base, values)
    check_labels(base.label_dict)
    return base


def check_labels(labels: dict, num_classes: int | None = None) -> None:
    if len(set(labels.values())) != len(labels):
        raise ValueError("two labels have one number")
    if num_classes is not None and len(labels) != num_classes:
        raise ValueError("labels and classes differ in number")
