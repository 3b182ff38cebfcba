"""Files of tracks and of map-query answers as data sources of their own: `spark.read.format("gpx_tracks").load(folder)`, and the same as a stream.

Files are dealt to partitions by size and read where they are parsed; one that can't be read or parsed gives a row that says so and fails nothing. Paths may be
local or of any store that Arrow's file systems reach; for other stores read the files with Spark and use tables.tracks() and tables.overpass_elements().
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions import kernels
from .tables import DENSE_EPSILON, DENSE_POINTS

#: Bytes of files in a partition; a larger file is alone.
PARTITION_BYTES = 32 << 20
POINT = "struct<lng:double,lat:double>"


@dataclass
class Files(InputPartition):
    """Some files, read one after the other."""

    paths: list[str]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(folder: str, pattern: str) -> list[tuple[int, str, int]]:
    """Time of the last change (microseconds), path and size of the files of a folder, at any depth, whose names match; a path of one file is that file."""
    from pyarrow import fs

    system, path = _system(folder)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(((f.mtime_ns or 0) // 1000, f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def dealt(files: list[tuple[int, str, int]], size: int) -> list[Files]:
    """Files in order of their paths, in partitions of about so many bytes."""
    out: list[Files] = []
    held = size
    for _, path, n in sorted(files, key=lambda f: f[1]):
        if held + n > size and held:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += max(n, 1)
    return out


class _Rows:
    """What batch and stream readers share: rows of the files of a partition."""

    def __init__(self, options: dict, pattern: str, parse, width: int):
        if "path" not in options:
            raise ValueError("load() needs the path of a folder or file")
        self.folder, self.pattern, self.parse, self.width = options["path"], options.get("pathGlobFilter", pattern), parse, width
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.system_of = options["path"]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.system_of)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    rows = list(self.parse(f.read().decode("utf-8-sig")))
            except Exception as e:  # whatever is wrong with one file is that file's row
                yield (path, *[None] * self.width, f"{type(e).__name__}: {e}"[:500])
                continue
            for row in rows:
                yield (path, *row, None)


class _Reader(_Rows, DataSourceReader):
    def __init__(self, *args):
        super().__init__(*args)
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters by path choose files; Spark sees to the others."""
        for f in filters:
            if isinstance(f, EqualTo | StringStartsWith) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        keep = lambda p: all(p == f.value if isinstance(f, EqualTo) else p.startswith(f.value) for f in self.wanted)
        return dealt([f for f in listed(self.folder, self.pattern) if keep(f[1])], self.size) or [Files([])]


class _StreamReader(_Rows, DataSourceStreamReader):
    """Files as they come, by the time of their last change and path: an offset is that of the last file read."""

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder, self.pattern)
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return dealt([f for f in listed(self.folder, self.pattern) if low < f[:2] <= high], self.size)


def _track(text: str) -> Iterator[tuple]:
    name, line = kernels.track(text)
    if line is None:
        raise ValueError("not a track file")
    points = [p for p in line if -180 <= p["lng"] <= 180 and -90 <= p["lat"] <= 90]
    if len(points) > DENSE_POINTS:
        xy = np.array([(p["lng"], p["lat"]) for p in points])
        points = [p for p, keep in zip(points, kernels.douglas_peucker(xy, DENSE_EPSILON), strict=True) if keep]
    yield name, [(p["lng"], p["lat"]) for p in points] if len(points) >= 2 else None


def _line(nodes) -> list[tuple[float, float]] | None:
    return None if nodes is None else [(float(p["lon"]), float(p["lat"])) for p in nodes if p is not None]


def _elements(text: str) -> Iterator[tuple]:
    for e in json.loads(text)["elements"]:
        outers = None if e.get("members") is None else [_line(m["geometry"]) for m in e["members"] if m.get("role") == "outer" and m.get("geometry") is not None]
        lng, lat = e.get("lon"), e.get("lat")
        yield e.get("type"), e.get("id"), None if lng is None else float(lng), None if lat is None else float(lat), None if e.get("tags") is None else {k: str(v) for k, v in e["tags"].items()}, _line(e.get("geometry")), outers


class TrackFiles(DataSource):
    """Track files: path, name, line (as tables.tracks() gives it) and error. Options: pathGlobFilter (*.gpx), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "gpx_tracks"

    def schema(self) -> str:
        return f"path string, name string, line array<{POINT}>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "*.gpx", _track, 2)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, "*.gpx", _track, 2)


class MapAnswers(DataSource):
    """Map-query answers, one row an element: path, the columns of tables.overpass_elements(), and error. Options: pathGlobFilter (*.json), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "map_answers"

    def schema(self) -> str:
        return f"path string, type string, id bigint, lng double, lat double, tags map<string,string>, line array<{POINT}>, outers array<array<{POINT}>>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "*.json", _elements, 7)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, "*.json", _elements, 7)


#: The sources by name.
SOURCES = {c.name(): c for c in (TrackFiles, MapAnswers)}


def register(spark: SparkSession, pushdown: bool = True) -> None:
    """Makes the sources known to the session by their names; pushdown lets filters by path choose the files."""
    for source in SOURCES.values():
        spark.dataSource.register(source)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
