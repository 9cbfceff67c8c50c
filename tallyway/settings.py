"""Settings in layers: defaults, a file, the environment, and what the caller gives; a later layer wins where it has a value."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from tallyway import model

#: Before a setting's name, in capitals, in the environment.
PREFIX = "TALLYWAY_"
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Settings:
    raw_dir: str = "data/raw"
    out_dir: str = "data/build"
    box: Box = model.STUDY_BBOX
    cell_m: float = model.CHUNK_CELL_M
    simplify: bool = True
    keep_service: bool = False
    external_zones: int = model.EXTERNAL_ZONES
    auto_factor: float = model.AUTO_FACTOR
    iterations: int = model.MAX_ITERATIONS
    gap: float = model.GAP


def box_of(value: Any) -> Box:
    """West, south, east and north, as four numbers or as text with commas."""
    at = [float(x) for x in (value.split(",") if isinstance(value, str) else value)]
    if len(at) != 4 or not (at[0] < at[2] and at[1] < at[3]):
        raise ValueError("a box is west,south,east,north")
    return at[0], at[1], at[2], at[3]


def flag(value: Any) -> bool:
    told = {"true": True, "false": False}.get(str(value).lower())
    if told is None:
        raise ValueError("a flag is true or false")
    return told


READ = {"Box": box_of, "bool": flag, "int": int, "float": float, "str": str}


def flat(table: Mapping[str, Any]) -> dict[str, Any]:
    """The values of a file with or without sections; names are the settings', whatever section they are in."""
    out: dict[str, Any] = {}
    for name, value in table.items():
        out |= flat(value) if isinstance(value, Mapping) else {name: value}
    return out


def layered(path: str | None = None, environment: Mapping[str, str] | None = None, **given: Any) -> Settings:
    """Settings of all layers. A file that isn't there, empty variables and None say nothing; unknown names and bad values are errors."""
    known = {f.name: READ[str(f.type)] for f in fields(Settings)}
    layers: list[tuple[str, dict[str, Any]]] = []
    if path is not None:
        try:
            with open(path, "rb") as file:
                layers.append((path, flat(tomllib.load(file))))
        except FileNotFoundError:
            pass
    told = {n: (environment or {}).get(PREFIX + n.upper()) for n in known}
    layers += [("the environment", {n: v for n, v in told.items() if v}), ("the call", {n: v for n, v in given.items() if v is not None})]
    made: dict[str, Any] = {}
    for where, layer in layers:
        for name, value in layer.items():
            if name not in known:
                raise ValueError(f"{name} in {where} isn't a setting")
            try:
                made[name] = known[name](value)
            except (TypeError, ValueError) as error:
                raise ValueError(f"{name} in {where}: {error}") from error
    return Settings(**made)
