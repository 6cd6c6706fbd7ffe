"""Configuration: nested dataclasses with defaults for everything, from YAML or JSON, with a stable hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
from dataclasses import dataclass, field

from sunplane.operators.mounting import Thresholds

log = logging.getLogger(__name__)

# The sections, keys and defaults that a configuration file has.


@dataclass(frozen=True)
class Crs:
    target: str = "EPSG:6341"


@dataclass(frozen=True)
class PanelPlane:
    erosion_m: float = 0.15
    ransac_threshold_m: float = 0.05
    min_inlier_frac: float = 0.6
    max_iter: int = 200
    min_density_pts_per_m2: float = 3.0
    min_points: int = 30
    tilt_floor_deg: float = 1.0
    uncertainty_method: str = "bootstrap"
    bootstrap_samples: int = 50


@dataclass(frozen=True)
class MultiPlane:
    enabled: bool = True
    secondary_min_frac: float = 0.20
    ew_rack_azimuth_tol_deg: float = 25.0
    ew_rack_tilt_tol_deg: float = 5.0


@dataclass(frozen=True)
class RoofPlane:
    enabled: bool = True
    buffer_m: float = 3.0
    buffer_max_m: float = 5.0
    buffer_step_m: float = 0.5
    min_points: int = 100
    ransac_threshold_m: float = 0.15
    rmse_max_m: float = 0.10


@dataclass(frozen=True)
class Heights:
    ground_search_radius_m: float = 10.0
    use_whitebox_dem: bool = False


@dataclass(frozen=True)
class FlushMount:
    panel_roof_angle_deg_max: float = 5.0
    height_above_roof_m_max: float = 0.5


@dataclass(frozen=True)
class RoofRack:
    panel_roof_angle_deg_min: float = 5.0
    height_above_roof_m_max: float = 1.5
    fallback_tilt_deg_min: float = 5.0
    fallback_height_above_ground_m_min: float = 2.5


@dataclass(frozen=True)
class Carport:
    height_above_ground_m_min: float = 2.0
    aspect_ratio_min: float = 2.0


@dataclass(frozen=True)
class Tracker:
    aspect_ratio_min: float = 4.0
    tilt_deg_max: float = 35.0
    height_above_ground_m_max: float = 2.0


@dataclass(frozen=True)
class FixedGround:
    tilt_deg_min: float = 5.0
    height_above_ground_m_max: float = 2.0


@dataclass(frozen=True)
class MountingRules:
    R1: FlushMount = field(default_factory=FlushMount)
    R2: RoofRack = field(default_factory=RoofRack)
    R3: Carport = field(default_factory=Carport)
    R4: Tracker = field(default_factory=Tracker)
    R5: FixedGround = field(default_factory=FixedGround)
    confidence_margin: float = 0.5

    @property
    def thresholds(self) -> Thresholds:
        flush, rack, port, track, fixed = self.R1, self.R2, self.R3, self.R4, self.R5
        return Thresholds(
            flush_angle=flush.panel_roof_angle_deg_max,
            flush_height=flush.height_above_roof_m_max,
            rack_angle=rack.panel_roof_angle_deg_min,
            rack_height=rack.height_above_roof_m_max,
            rack_tilt=rack.fallback_tilt_deg_min,
            rack_ground_height=rack.fallback_height_above_ground_m_min,
            carport_height=port.height_above_ground_m_min,
            carport_aspect=port.aspect_ratio_min,
            tracker_height=track.height_above_ground_m_max,
            tracker_aspect=track.aspect_ratio_min,
            tracker_tilt=track.tilt_deg_max,
            fixed_height=fixed.height_above_ground_m_max,
            fixed_tilt=fixed.tilt_deg_min,
            margin=self.confidence_margin,
        )


@dataclass(frozen=True)
class S3:
    requester_pays: bool = False
    region: str = "us-east-2"


@dataclass(frozen=True)
class Classification:
    panel_class_primary: int = 6
    panel_class_fallback: int = 1
    ground_class: int = 2
    fallback_height_above_ground_m: float = 1.5


@dataclass(frozen=True)
class Io:
    """lidar_reader: native reads LAS, laspy also LAZ where that package and a LAZ backend are installed."""

    lidar_reader: str = "laspy"
    s3: S3 = field(default_factory=S3)
    classification: Classification = field(default_factory=Classification)


@dataclass(frozen=True)
class Workers:
    n_workers: int = 8
    threads_per_worker: int = 2


@dataclass(frozen=True)
class Compute:
    """backend local runs on as many threads as `local` tells, unless `master` names a Spark master; any other backend needs
    one. Sections of other backends are kept in `other` and tell nothing here. The cell sizes are for joins."""

    backend: str = "local"
    local: Workers = field(default_factory=Workers)
    master: str = ""
    other: dict = field(default_factory=dict)
    cell_size_m: float = 25.0
    tile_cell_size_m: float = 1000.0

    @property
    def spark_master(self) -> str:
        return self.master or f"local[{self.local.n_workers * self.local.threads_per_worker}]"


@dataclass(frozen=True)
class Output:
    partition_size: int = 100000
    write_geoparquet: bool = True
    also_write_csv: bool = False


@dataclass(frozen=True)
class Config:
    crs: Crs = field(default_factory=Crs)
    panel_plane: PanelPlane = field(default_factory=PanelPlane)
    multi_plane: MultiPlane = field(default_factory=MultiPlane)
    roof_plane: RoofPlane = field(default_factory=RoofPlane)
    heights: Heights = field(default_factory=Heights)
    mounting_rules: MountingRules = field(default_factory=MountingRules)
    io: Io = field(default_factory=Io)
    compute: Compute = field(default_factory=Compute)
    output: Output = field(default_factory=Output)

    @property
    def hash(self) -> str:
        """sha256 of the canonical JSON of every value."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()

    @classmethod
    def from_dict(cls, values: dict | None) -> Config:
        out = _build(cls, values or {}, "")
        if out.panel_plane.uncertainty_method not in ("bootstrap", "covariance"):
            raise ValueError(f"uncertainty_method: {out.panel_plane.uncertainty_method!r} is neither bootstrap nor covariance")
        if out.panel_plane.uncertainty_method == "covariance":
            log.warning("uncertainty_method covariance gives no uncertainties")
        if out.io.lidar_reader not in ("native", "laspy"):
            raise ValueError(f"io.lidar_reader: {out.io.lidar_reader!r} is neither laspy nor native")
        if out.compute.backend != "local" and not out.compute.master:
            raise ValueError(f"compute.backend: name the Spark master of {out.compute.backend!r} in compute.master")
        for path, given, default in (("heights.use_whitebox_dem", out.heights.use_whitebox_dem, False), ("io.s3", out.io.s3, S3()), ("output.write_geoparquet", out.output.write_geoparquet, True)):
            if given != default:
                log.warning("%s has no effect", path)
        return out

    @classmethod
    def from_file(cls, path: str) -> Config:
        """YAML (if PyYAML is installed) or JSON; keys that don't exist are errors."""
        text = open(path).read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text))
        return cls.from_dict(json.loads(text))


def _build(kind, values: dict, where: str):
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if "other" in fields:
        sections = {k: v for k, v in values.items() if k not in fields and (v is None or isinstance(v, dict))}
        values = {k: v for k, v in values.items() if k not in sections} | ({"other": sections | values.get("other", {})} if sections else {})
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(where + k for k in unknown))}")
    given = {}
    for name, v in values.items():
        default = fields[name].default_factory() if fields[name].default_factory is not dataclasses.MISSING else fields[name].default
        if dataclasses.is_dataclass(default):
            given[name] = _build(type(default), v or {}, f"{where}{name}.")
        elif isinstance(default, bool) != isinstance(v, bool) or not isinstance(v, (type(default), int) if isinstance(default, float) else type(default)):
            raise ValueError(f"{where}{name}: {v!r} isn't a {type(default).__name__}")
        else:
            given[name] = type(default)(v)
    return kind(**given)
