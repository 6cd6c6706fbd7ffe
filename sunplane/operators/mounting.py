"""Mounting classes from confidence-scored rules, and the tracker flag."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunplane.functions.confidence import conf_ge, conf_le

# The labels and flags of the output.
LABELS = ("flush_mount_rooftop", "tilted_rack_rooftop", "carport", "ground_mount_fixed", "ground_mount_tracker_suspected", "ambiguous")
FLAGS = ("low_density", "poor_fit", "near_horizontal", "roof_complex", "roof_insufficient", "east_west_rack", "tracker_suspected")


@dataclass(frozen=True)
class Thresholds:
    flush_angle: float = 5.0
    flush_height: float = 0.5
    rack_angle: float = 5.0
    rack_height: float = 1.5
    rack_tilt: float = 5.0
    rack_ground_height: float = 2.5
    carport_height: float = 2.0
    carport_aspect: float = 2.0
    tracker_height: float = 2.0
    tracker_aspect: float = 4.0
    tracker_tilt: float = 35.0
    fixed_height: float = 2.0
    fixed_tilt: float = 5.0
    margin: float = 0.5


class Classifier(Protocol):
    """Anything that turns feature columns into a struct<label, confidence, rule> column."""

    def classify(self, features: Mapping[str, Column]) -> Column: ...


@dataclass(frozen=True)
class RuleClassifier:
    """The first rule with a confidence of 0.5 or more decides; without one the class is ambiguous, with one less the best
    near miss as its confidence. A rule's confidence is its least clause's, 0 if its guard fails."""

    thresholds: Thresholds = Thresholds()

    def confidences(self, f: Mapping[str, Column]) -> list[tuple[str, str, Column]]:
        t = self.thresholds
        le = lambda c, limit: conf_le(f[c], limit, t.margin)
        ge = lambda c, limit: conf_ge(f[c], limit, t.margin)
        roof, on = f["roof_available"], f["on_building"]
        rules = [
            ("R1", "flush_mount_rooftop", on & roof, F.least(le("panel_roof_angle", t.flush_angle), le("height_above_roof", t.flush_height))),
            (
                "R2",
                "tilted_rack_rooftop",
                on,
                F.when(roof, F.least(ge("panel_roof_angle", t.rack_angle), le("height_above_roof", t.rack_height))).otherwise(F.least(ge("tilt", t.rack_tilt), ge("height_above_ground", t.rack_ground_height))),
            ),
            ("R3", "carport", ~on, F.least(ge("height_above_ground", t.carport_height), ge("aspect_ratio", t.carport_aspect))),
            ("R4", "ground_mount_tracker_suspected", ~on, F.least(le("height_above_ground", t.tracker_height), ge("aspect_ratio", t.tracker_aspect), le("tilt", t.tracker_tilt))),
            ("R5", "ground_mount_fixed", ~on, F.least(le("height_above_ground", t.fixed_height), ge("tilt", t.fixed_tilt))),
        ]
        return [(rule, label, F.when(F.coalesce(guard, F.lit(False)), c).otherwise(F.lit(0.0))) for rule, label, guard, c in rules]

    def classify(self, features: Mapping[str, Column]) -> Column:
        scored = self.confidences(features)
        out = F.struct(F.lit("ambiguous").alias("label"), (F.lit(1.0) - F.greatest(*[c for _, _, c in scored])).alias("confidence"), F.lit("R6").alias("rule"))
        for rule, label, c in reversed(scored):
            out = F.when(c >= 0.5, F.struct(F.lit(label).alias("label"), c.alias("confidence"), F.lit(rule).alias("rule"))).otherwise(out)
        return out


def is_tracker_suspected(on_building: Column, aspect: Column, height_above_ground: Column, tilt: Column, least_aspect: float = 4.0, most_height: float = 2.0, most_tilt: float = 35.0) -> Column:
    """Off a building, long, low and flat; false where a value is null."""
    return F.coalesce(~on_building & (aspect >= least_aspect) & (height_above_ground < most_height) & (tilt < most_tilt), F.lit(False))
