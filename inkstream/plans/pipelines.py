"""End-to-end plans: screens to observations, detections to pushed tracks; their settings and errors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, EngineError, InvalidHandle, NotCapable
from ..functions import observations, recognition
from ..operators import geometry, heatmap, predicates, ranking
from ..streaming import dealer, push, tracker

__all__ = ["ClassSettings", "ConfigError", "EngineError", "NotCapable", "Pipeline", "Settings", "capabilities", "dealt", "filtered", "follow", "limit_tracks", "observe", "pushed"]
VERSION = "1.1.0"
CLASSES = ("body", "vehicle", "cycle", "face", "plate")


@dataclass(frozen=True)
class ClassSettings:
    confidence: float = 0.5
    min_w: int = 0
    min_h: int = 0
    max_count: int = 0
    quality: float = 0.0
    expand: float = 0.1
    #: what a pushed face must measure, and how far it may be turned (degrees) and blurred
    crop_w: int = 0
    crop_h: int = 0
    pitch: float = 180.0
    yaw: float = 180.0
    roll: float = 180.0
    blur: float = 1.0


#: Keys that hold several settings, and what their parts set here ({} is the class).
GROUPED = {
    "push_strategy": {"mode": "push_strategy", "interval_ms": "push_interval_ms", "counts": "push_counts", "same_frame": "push_same_frame"},
    "detect_roi": {"rect": "detect_roi"},
    "push_panorama": {"enable": "push_panorama", "quality": "panorama_quality"},
    "resize_panorama_encoder_config": {"size": "panorama_size"},
    "push_quality": {"quality": "{}_quality", "width": "{}_crop_w", "height": "{}_crop_h", "pitch": "{}_pitch", "yaw": "{}_yaw", "roll": "{}_roll", "blur": "{}_blur"},
}


def _grouped(key: str, value: object) -> dict[str, object]:
    """A key and its value as keys of single settings."""
    kind, _, name = key.partition("_")
    if kind in CLASSES and name == "max_target_count":
        return {f"{kind}_max_count": value}
    if kind in CLASSES and name == "min_size":
        if not isinstance(value, (tuple, list)) or len(value) != 2:
            raise ConfigError(f"{key}: {value!r}")
        return {f"{kind}_min_w": value[0], f"{kind}_min_h": value[1]}
    if key == "crop_encoder_qpLevel":
        return {"crop_quality": value}
    if key == "crop_encoder":  # one share for all classes, or one each
        each = value if isinstance(value, Mapping) else dict.fromkeys(CLASSES, value)
        return {f"{c}_expand": v for c, v in each.items()}
    if key.startswith("push_quality_"):
        group, kind = "push_quality", key.rpartition("_")[2]
        if not isinstance(value, Mapping):
            return {f"{kind}_quality": value}
    else:
        group = key
    if group in GROUPED and isinstance(value, Mapping):
        if value.keys() - GROUPED[group].keys() - {"enable"}:
            raise ConfigError(f"{key}: {value!r}")
        if group in ("detect_roi", "resize_panorama_encoder_config") and value.get("enable") is False:
            return {next(iter(GROUPED[group].values())): None}
        return {GROUPED[group][p].format(kind): v for p, v in value.items() if p in GROUPED[group]}
    return {key: value}


def _fitting(key: str, value: object, like: object) -> object:
    """The value, if it is of the kind of ``like``; lists become tuples, whole numbers may stand for others."""
    if isinstance(value, list):
        value = tuple(value)
    if like is None:
        if value is None or (isinstance(value, tuple) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value)):
            return value
    elif isinstance(like, float) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    elif isinstance(value, type(like)) and isinstance(value, bool) == isinstance(like, bool):
        return value
    raise ConfigError(f"{key}: {value!r}")


@dataclass(frozen=True)
class Settings:
    """What a tracking pipeline can be told. Push is off unless asked for, as is the panorama."""

    track_disable: bool = False
    push_disable: bool = True
    push_strategy: str = "BEST"
    push_interval_ms: int = push.INTERVAL_MS
    push_counts: int = push.MOST
    push_same_frame: bool = False
    push_panorama: bool = False
    panorama_quality: float = 0.0
    panorama_size: tuple[int, int] | None = None
    crop_quality: float = 0.0
    target_config: tuple[str, ...] = ()
    detect_roi: tuple[float, float, float, float] | None = None
    classes: Mapping[str, ClassSettings] = field(default_factory=lambda: {c: ClassSettings(confidence=0.55 if c == "body" else 0.5, expand={"face": 0.25, "plate": 1.0}.get(c, 0.1)) for c in CLASSES})

    @staticmethod
    def read(values: Mapping[str, object], base: "Settings | None" = None) -> "Settings":
        """From keys: fields of this class, <class>_<field of a class>, and the keys of ``GROUPED``; types must fit.

        What isn't named is as in ``base``.
        """
        base = base or Settings()
        own, per = {f.name for f in fields(Settings)} - {"classes"}, {f.name: f for f in fields(ClassSettings)}
        out, classes = {}, {c: dict(vars(s)) for c, s in base.classes.items()}
        flat: dict[str, object] = {}
        for key, value in values.items():
            flat |= _grouped(key, value)
        for key, value in flat.items():
            kind, _, name = key.partition("_")
            if key in own:
                out[key] = _fitting(key, value, getattr(Settings(), key))
            elif kind in classes and name in per:
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise ConfigError(f"{key}: {value!r}")
                classes[kind][name] = value
            else:
                raise ConfigError(f"unknown key {key!r}")
        if out.get("push_strategy", "BEST") not in dealer.MODES:
            raise ConfigError(f"push_strategy: {out['push_strategy']!r}")
        kept = {f: getattr(base, f) for f in own}
        return Settings(**kept | out, classes={c: ClassSettings(**s) for c, s in classes.items()})

    def get(self, key: str) -> object:
        """The value of a key that ``read`` knows as a field."""
        kind, _, name = key.partition("_")
        if key in {f.name for f in fields(Settings)}:
            return getattr(self, key)
        if kind in self.classes and name in {f.name for f in fields(ClassSettings)}:
            return getattr(self.classes[kind], name)
        raise ConfigError(f"unknown key {key!r}")

    def push_settings(self, version: int = 0) -> dealer.PushSettings:
        """What the dealer of tracks is told."""
        sizes = tuple((c, float(s.min_w), float(s.min_h), float(s.quality), float(s.crop_w), float(s.crop_h)) for c, s in self.classes.items())
        return dealer.PushSettings(version, not self.push_disable, self.push_strategy, self.push_interval_ms, self.push_counts, self.push_same_frame, push.IDLE_MS, push.LEAST_UPDATES, self.detect_roi, sizes)

    def table(self, spark) -> DataFrame:
        rows = [(c, s.min_w, s.min_h, float(s.confidence), float(s.quality), s.max_count, float(s.expand)) for c, s in self.classes.items()]
        return spark.createDataFrame(rows, "class string, min_w int, min_h int, confidence double, quality double, max_count int, expand double")


def filtered(detections: DataFrame, settings: Settings) -> DataFrame:
    """Suppression, wanted classes, region, size and confidence, then the limit per class: the limit must be last."""
    d = ranking.suppress(detections).where(predicates.wanted(list(settings.target_config)))
    if settings.detect_roi:
        d = d.where(predicates.inside("x", "y", "w", "h", settings.detect_roi))
    config = settings.table(detections.sparkSession)
    return ranking.limit_per_class(predicates.large_and_sure(d, config), config).select(*detections.columns)


def detection_items(detections: DataFrame) -> DataFrame:
    """Detections as items: no track."""
    return detections.select("stream_id", "frame_id", F.lit(None).cast("long").alias("track_id"), "class", F.lit("NEW").alias("state"), "x", "y", "w", "h", "score")


def limit_tracks(items: DataFrame, settings: Settings) -> DataFrame:
    """The first max_count tracks, by number, of each limited class in a frame; 0 is no limit. Faces and plates have none."""
    limited = {c: s.max_count for c, s in settings.classes.items() if s.max_count > 0 and c in ("body", "vehicle", "cycle")}
    if not limited:
        return items
    from pyspark.sql import Window

    most = F.coalesce(*[F.when(F.col("class") == c, n) for c, n in limited.items()])
    place = F.row_number().over(Window.partitionBy("stream_id", "frame_id", "class").orderBy("track_id"))
    return items.withColumns({"_place": place, "_most": most}).where("_most is null or _place <= _most").drop("_place", "_most")


def track_items(tracks: DataFrame) -> DataFrame:
    """Tracks as items, at their last detection's box; lost ones show nothing."""
    return tracks.withColumn("state", push.item_state("state")).where("state is not null")


def follow(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Items of every frame (stream_id, frame_id, track_id, class, state, box, score)."""
    settings = settings or Settings()
    kept = filtered(detections, settings)
    return detection_items(kept) if settings.track_disable else limit_tracks(track_items(tracker.track(kept)), settings)


def pushed(detections: DataFrame, settings: Settings) -> DataFrame:
    """Snapshots to push of the followed tracks, with the crop that shows them."""
    if settings.push_disable:
        raise ConfigError("push_disable")
    spark = detections.sparkSession
    times = detections.select("stream_id", "frame_id", "ts").groupBy("stream_id", "frame_id").agg(F.min("ts").alias("ts"))
    tracks = follow(detections, settings).where("state <> 'DIE'").join(times, ["stream_id", "frame_id"])
    config = settings.table(spark)
    good = predicates.worth_pushing(tracks, config, settings.detect_roi)
    idle = f"{push.IDLE_MS} milliseconds"
    chosen = push.best_of_sessions(good, idle).select(*push.KEY, "frame_id") if settings.push_strategy == "BEST" else push.paced(good, settings.push_interval_ms, settings.push_counts, settings.push_strategy == "INTERVAL").select(*push.KEY, "frame_id")
    out = chosen.join(good, [*push.KEY, "frame_id"]).join(F.broadcast(config.select("class", "expand")), "class")
    grown = geometry.expand_by_class("x", "y", "w", "h", "expand")
    snapped = geometry.snap_for_encoder(*grown, F.lit(1920), F.lit(1080))
    return out.select("stream_id", "class", "track_id", "frame_id", "score", *[v.alias(n) for v, n in zip(snapped, ("crop_x", "crop_y", "crop_w", "crop_h", "fits"), strict=True)]).withColumn("state", F.lit("SELECT"))


def dealt(detections: DataFrame, settings: Settings, uses: bool = False) -> DataFrame:
    """What becomes of the followed tracks: pushes and ends, in the time of the frames; nothing with push off."""
    times = detections.groupBy("stream_id", "frame_id").agg(F.min("ts").alias("ts"))
    items = follow(detections, settings).join(times, ["stream_id", "frame_id"])
    return dealer.deal(items, settings.push_settings(), uses=uses)


class Pipeline:
    """Settings that can be read and changed, with what they do to a stream that is running.

    A change is a row for the streams' control table; ``dealer.deal_stream`` makes it hold from its time on.
    """

    def __init__(self, settings: Settings | None = None):
        self.settings, self.version, self.open = settings or Settings(), 0, True

    def _used(self) -> None:
        if not self.open:
            raise InvalidHandle("the pipeline is closed")

    def get_config(self, *keys: str) -> dict[str, object]:
        self._used()
        return {k: self.settings.get(k) for k in (keys or [f.name for f in fields(Settings)])}

    def set_config(self, values: Mapping[str, object]) -> Settings:
        """All of the values or none; what isn't named stays."""
        self._used()
        self.settings = Settings.read(values, self.settings)
        self.version += 1
        return self.settings

    def control(self, spark, at) -> DataFrame:
        """The row that tells running streams of the settings from ``at`` on."""
        self._used()
        return spark.createDataFrame([(at, self.settings.push_settings(self.version).text())], "ts timestamp, settings string")

    def close(self) -> None:
        self._used()
        self.open = False


def observe(heat: DataFrame, readings: DataFrame, screens: DataFrame, least_pixels: int = 500, least_area: int = 0) -> DataFrame:
    """Heatmap pixels and readings (image_id, ord, text, confidence) to observations: regions in order meet readings in order."""
    mask = heatmap.merge_or(heat)
    boxes = heatmap.component_boxes(heatmap.components(mask), least_pixels, least_area).join(screens.select("image_id", "width", "height"), "image_id")
    grown = geometry.expand_by_height("x1", "y1", "x2", "y2", "width", "height")
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1
    placed = boxes.select("image_id", order.alias("ord"), *[v.alias(n) for v, n in zip(grown, ("x1", "y1", "x2", "y2"), strict=True)])
    good = readings.where(recognition.valid(success="success"))
    return observations.observations(placed.join(good, ["image_id", "ord"]), screens)


def capabilities(requirements: DataFrame, models: DataFrame, pipeline: str | None = None) -> DataFrame:
    """Pipelines whose models are all there; asking for one that isn't is an error."""
    from ..operators.tracks import capable

    out = capable(requirements, models)
    if pipeline is not None and out.where(F.col("pipeline") == pipeline).isEmpty():
        raise NotCapable(pipeline)
    return out
