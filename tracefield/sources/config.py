"""Configuration of an exploration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Entrance:
    lat: float
    lon: float
    id: int = 0
    heading: float = -1.0


@dataclass
class Config:
    """Fields have the defaults of a configuration that lacks them."""

    entrances: list[Entrance] = field(default_factory=list)
    exits: list[tuple[float, float]] = field(default_factory=list)
    region: tuple[float, float, float, float] = (-90.0, -180.0, 90.0, 180.0)
    output: str = ""
    history_length: int = 3
    least_trips: int = 2
    least_trips_branch: int = 2
    merge_detector: str = "kde_based"
    search_threshold: float = 0.00025
    evaluate_all: bool = True
    path_length: int = 12
    keep_dead_ends: bool = False


def parse(text: str) -> Config:
    raw = json.loads(text)
    c = Config()
    c.entrances = [Entrance(e["Lat"], e["Lon"], e.get("ID", i), e.get("InitDirection", -1.0)) for i, e in enumerate(raw.get("Entrances", []))]
    c.exits = [(e["Lat"], e["Lon"]) for e in raw.get("Exits", [])]
    c.region = tuple(raw.get("Region", c.region))
    c.output = raw.get("OutputFolder", c.output)
    names = {
        "history_length": "history_length",
        "minimal_number_of_trips": "least_trips",
        "minimal_number_of_trips_deferred_branch": "least_trips_branch",
        "merge_detector": "merge_detector",
        "merge_detector_search_threshold": "search_threshold",
        "merge_detector_evaluate_all": "evaluate_all",
        "merge_detector_path_length": "path_length",
        "keep_deadend": "keep_dead_ends",
    }
    for key, name in names.items():
        if key in raw:
            setattr(c, name, raw[key])
    return c


def read_config(spark: SparkSession, path: str) -> Config:
    """A configuration from any store that Spark reads."""
    return parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
