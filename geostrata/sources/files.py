"""Small files: polygons, filters, settings, manifests, states and the replication log."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from geostrata.operators.extract import Ring


def parse_poly(text: str) -> tuple[str, Ring]:
    """Name and ring of a polygon file: a name line, a ring id, 'lon lat' lines, END. Only the first ring counts."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    ring: Ring = []
    for line in lines[2:]:
        if line == "END":
            break
        lon, lat = line.split()[:2]
        ring.append((float(lon), float(lat)))
    if len(ring) < 3:
        raise ValueError("a polygon needs three points")
    return lines[0], ring


def parse_filter(text: str) -> tuple[tuple[int, int, int, int], Ring | None]:
    """A box and perhaps a ring from 'a,b,c,d' (units of 1e-7 degrees if all four are integers, else degrees),
    'tile:x,y,z' or 'tile:x,y,z:buffer', 'planet', or the content of a polygon file."""
    from geostrata.operators.extract import ring_bbox

    if text.strip() in ("", "planet"):
        return (-1800000000, -900000000, 1800000000, 900000000), None
    if m := re.fullmatch(r"\s*tile:(\d+),(\d+),(\d+)(?::([0-9.]+))?\s*", text):
        return tile_box(int(m[1]), int(m[2]), int(m[3]), float(m[4] or 0)), None
    if "\n" not in text.strip():
        parts = [p.strip() for p in text.split(",")]
        if len(parts) != 4:
            raise ValueError(f"no filter: {text}")
        if all(re.fullmatch(r"-?\d+", p) for p in parts):
            return tuple(map(int, parts)), None
        return ring_bbox([(float(parts[0]), float(parts[1])), (float(parts[2]), float(parts[3]))]), None
    ring = parse_poly(text)[1]
    return ring_bbox(ring), ring


def tile_box(x: int, y: int, z: int, buffer: float = 0.0) -> tuple[int, int, int, int]:
    import math

    n, span = 2**z, 1 + 2 * buffer
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    unit = lambda v: int(v * 1e7 + (0.5 if v > 0 else -0.5))
    return unit(lon(x - buffer)), unit(lat(y - buffer + span)), unit(lon(x - buffer + span)), unit(lat(y - buffer))


@dataclass
class Settings:
    InitialState: int = 0
    DiffsLocation: str = ""
    SourcePrfx: str = ""
    RoundTime: bool = True
    MaxQtLevel: int = 18
    QtBuffer: float = 0.05

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            return cls(**json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)


@dataclass
class Manifest:
    """The list of files: base first, then change files in order of state."""

    entries: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Manifest:
        with open(path) as f:
            return cls(json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.entries, f)

    def append(self, filename: str, end_date: str, num_tiles: int, state: int) -> None:
        if self.entries and state <= self.entries[-1]["State"]:
            raise ValueError(f"state {state} isn't after {self.entries[-1]['State']}")
        self.entries.append({"Filename": filename, "EndDate": end_date, "NumTiles": num_tiles, "State": state})

    def drop_last(self, n: int = 1) -> None:
        """The base stays."""
        self.entries = self.entries[: max(1, len(self.entries) - n)]

    @property
    def last_state(self) -> int:
        return self.entries[-1]["State"] if self.entries else -1


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """state and timestamp (epoch seconds) of a state list: 'state,timestamp' lines without a header."""
    from pyspark.sql import functions as F

    from geostrata.functions.text import parse_timestamp

    raw = spark.read.csv(path, schema="state long, ts string")
    return raw.select("state", parse_timestamp(F.col("ts")).alias("timestamp"))


def parse_state(text: str) -> tuple[int, str]:
    """Sequence number and time of a replication state file."""
    got = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    return int(got["sequenceNumber"]), got["timestamp"].replace("\\", "")


def diff_name(state: int, suffix: str = ".osc.gz") -> str:
    """Where a state's change file lies below the log's address: 1234567 is 001/234/567.osc.gz."""
    return f"{state // 1_000_000:03d}/{state // 1000 % 1000:03d}/{state % 1000:03d}{suffix}"


def download(prefix: str, target: str, last: int, get: Callable[[str], bytes] | None = None, most: int | None = None) -> list[tuple[int, str]]:
    """S19. Fetch the change files after the last state into target (N.osc.gz), each whole or not at all, and append
    'state,timestamp' to its state.csv. The states fetched, with their times."""
    get, out = get or fetch, []
    newest, _ = parse_state(get(f"{prefix}state.txt").decode())
    for state in range(last + 1, newest + 1)[:most]:
        at = parse_state(get(prefix + diff_name(state, ".state.txt")).decode())[1]
        with open(f"{target}/{state}.osc.gz.part", "wb") as f:
            f.write(get(prefix + diff_name(state)))
        os.replace(f"{target}/{state}.osc.gz.part", f"{target}/{state}.osc.gz")
        with open(f"{target}/state.csv", "a") as f:
            f.write(f"{state},{at.rstrip('Z').replace(':', '-')}\n")
        out.append((state, at))
    return out


def find_initial(prefix: str, timestamp: str, get: Callable[[str], bytes] | None = None) -> int:
    """S20. The last state that isn't after the time (ISO), by halving; 0 if all are."""
    get = get or fetch
    low, high = 0, parse_state(get(f"{prefix}state.txt").decode())[0]
    while low < high:
        mid = (low + high + 1) // 2
        if parse_state(get(prefix + diff_name(mid, ".state.txt")).decode())[1].rstrip("Z") <= timestamp.rstrip("Z"):
            low = mid
        else:
            high = mid - 1
    return low


def fetch(url: str, timeout: float = 60) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()
