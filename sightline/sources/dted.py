"""Terrain tiles in DTED files as a data source: partitions are planned from the headers, so that a box leaves most files unread.

A file has fixed headers, then a record for each line of longitude, west to east: its elevations from south to north as 16-bit numbers, the
first bit the sign, and a sum of the record's bytes.  Elevations stand at whole intervals, so they are taken as the centres of cells.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice, product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .named import located

#: Fixed values of the format: bytes of the headers, the mark of a record, the bytes of a record besides its elevations, and the value of none.
UHL, DSI, ACC, MARK, AROUND, VOID = 80, 648, 2700, 0xAA, 12, -32767
HEAD = UHL + DSI + ACC
#: Cells on the side of the pieces that a tile is read in, bytes of files that a task reads, headers read at a time, and those that are asked for at a time.
SIDE, BATCH_BYTES, OPEN, TOLD = 256, 64 << 20, 32, 4096
SCHEMA = (
    "file string, ordinal long, west double, south double, east double, north double, min_lon double, max_lat double, step_lon double, step_lat double, "
    "row0 int, col0 int, rows int, cols int, cells array<float>, error string"
)
_BOX = ("west", "south", "east", "north")


@dataclass
class Tile:
    """What a file's first header tells."""

    path: str
    file: str
    ordinal: int
    west: float = 0.0
    south: float = 0.0
    step_lon: float = 1.0
    step_lat: float = 1.0
    lines: int = 0
    points: int = 0
    error: str | None = None

    @property
    def east(self) -> float:
        return self.west + (self.lines - 1) * self.step_lon

    @property
    def north(self) -> float:
        return self.south + (self.points - 1) * self.step_lat


@dataclass
class Batch(D.InputPartition):
    """Files that one task reads, one after the other: their places below the path, put together by a sign that no name has, and their ordinals."""

    files: str
    ordinals: bytes

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return zip(self.files.split("\0"), np.frombuffer(self.ordinals, np.int64).tolist(), strict=True)


def degrees(text: str) -> float:
    """DDDMMSSH, H the hemisphere."""
    value = int(text[0:3]) + int(text[3:5]) / 60 + int(text[5:7]) / 3600
    return -value if text[7] in "SW" else value


def header(path: str, file: str, ordinal: int, head: bytes) -> Tile:
    """A tile by its user header label; one that can't be read is told by its error."""
    try:
        text = head.decode("ascii")
        if len(text) < UHL or text[:3] != "UHL":
            raise ValueError("no user header label")
        tile = Tile(path, file, ordinal, degrees(text[4:12]), degrees(text[12:20]), int(text[20:24]) / 36_000, int(text[24:28]) / 36_000, int(text[47:51]), int(text[51:55]))
        if min(tile.step_lon, tile.step_lat) <= 0 or min(tile.lines, tile.points) < 1:
            raise ValueError("no intervals or no lines")
        return tile
    except ValueError as e:
        return Tile(path, file, ordinal, error=f"header: {e}")


def decoded(tile: Tile, data: bytes) -> tuple[np.ndarray, str | None]:
    """(elevations from the north, west first, none as NaN; error or None).  A line whose mark or sum is wrong, or that is cut off, has none."""
    size = AROUND + 2 * tile.points
    body = np.frombuffer(data, np.uint8, offset=min(HEAD, len(data)))
    whole = min(len(body) // size, tile.lines)
    records = body[: whole * size].reshape(whole, size)
    raw = np.ascontiguousarray(records[:, 8:-4]).view(">u2").astype(np.int32)
    value = np.where(raw & 0x8000, -(raw & 0x7FFF), raw).astype(np.float32)
    value[value == VOID] = np.nan
    sums = np.ascontiguousarray(records[:, -4:]).view(">u4")[:, 0]
    bad = (records[:, 0] != MARK) | (records[:, :-4].sum(axis=1, dtype=np.uint32) != sums)
    value[bad] = np.nan
    grid = np.full((tile.points, tile.lines), np.nan, np.float32)
    grid[:, :whole] = value.T[::-1]
    faults = ([f"{int(bad.sum())} lines with a wrong sum or mark, the first {int(np.flatnonzero(bad)[0])}"] if bad.any() else []) + ([f"{tile.lines - whole} lines cut off"] if whole < tile.lines else [])
    return grid, "; ".join(faults) or None


def encoded(west: int, south: int, grid: np.ndarray, tenths_lon: int, tenths_lat: int) -> bytes:
    """A file of elevations from the north, west first (NaN for none), at intervals of so many tenths of a second."""
    points, lines = grid.shape
    place = lambda v, sides: f"{abs(v):03d}0000{sides[v < 0]}"
    head = f"UHL1{place(west, 'EW')}{place(south, 'NS')}{tenths_lon:04d}{tenths_lat:04d}NA  U  {'':12}{lines:04d}{points:04d}0{'':24}".encode()
    value = np.where(np.isnan(grid), VOID, np.round(grid)).astype(np.int32)
    raw = np.where(value < 0, -value | 0x8000, value).astype(">u2")
    out = [head.ljust(UHL), b"DSI".ljust(DSI), b"ACC".ljust(ACC)]
    for i in range(lines):
        record = struct.pack(">BBHHH", MARK, 0, i, i, 0) + raw[::-1, i].tobytes()
        out.append(record + struct.pack(">I", sum(record)))
    return b"".join(out)


class Boxes:
    """Boxes (west, south, east, north) by the whole degrees that they touch, so that a tile is held against those near it alone."""

    def __init__(self, boxes: list[list[float]]):
        self.near: dict[tuple[int, int], list[list[float]]] = {}
        for box in boxes:
            for square in self._squares(*box):
                self.near.setdefault(square, []).append(box)

    @staticmethod
    def _squares(west: float, south: float, east: float, north: float) -> Iterator[tuple[int, int]]:
        return product(range(math.floor(west), math.floor(east) + 1), range(math.floor(south), math.floor(north) + 1))

    def meets(self, t: Tile) -> bool:
        return any(t.west <= e and t.east >= w and t.south <= n and t.north >= s for at in self._squares(t.west, t.south, t.east, t.north) for w, s, e, n in self.near.get(at, ()))


class DtedReader(D.DataSourceReader):
    def __init__(self, path: str, boxes: list[list[float]] | None, size: int):
        self.path, self.boxes, self.size = path, boxes, size

    def _files(self, system: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        """The tiles' files in the order of their paths, a folder at a time."""
        found = system.get_file_info(fs.FileSelector(folder))
        kept = [f for f in found if f.type == fs.FileType.Directory or f.extension.lower() in ("dt0", "dt1", "dt2")]
        del found
        for f in sorted(kept, key=lambda f: f.path + "/" * (f.type == fs.FileType.Directory)):
            if f.type == fs.FileType.Directory:
                yield from self._files(system, f.path)
            elif f.type == fs.FileType.File:
                yield f

    def partitions(self) -> list[Batch]:
        """Batches of the files whose box meets one of those asked for, each of so many bytes or one file; a file without a box, as its header is wrong, is read always.

        Headers are read TOLD at a time, and of a file that is wanted its place alone is kept.
        """
        system, root = located(self.path)
        root = root.rstrip("/")
        meets = None if self.boxes is None else Boxes(self.boxes)

        def wanted(f: fs.FileInfo) -> bool:
            with system.open_input_file(f.path) as data:
                tile = header(f.path, f.base_name, 0, data.read(UHL))
            return bool(tile.error) or meets.meets(tile)

        batches, own, ordinals, room, number = [], [], [], 0, 0
        done = lambda: own and batches.append(Batch("\0".join(own), np.array(ordinals, np.int64).tobytes()))
        files = self._files(system, root)
        with ThreadPoolExecutor(OPEN) as pool:
            while some := list(islice(files, TOLD)):
                for keep, file in zip(pool.map(wanted, some) if meets else (True for _ in some), some, strict=True):
                    if keep:
                        if not own or room < file.size:
                            done()
                            own, ordinals, room = [], [], self.size
                        own.append(file.path[len(root) + 1 :])
                        ordinals.append(number)
                        room -= file.size
                    number += 1
        done()
        return batches

    def read(self, batch: Batch | None) -> Iterator[pa.RecordBatch]:
        system, root = located(self.path)
        for file, ordinal in batch or []:  # none where there is no file at all
            with system.open_input_file(f"{root.rstrip('/')}/{file}") as f:
                data = f.read()
            yield from self.tile(header(f"{root.rstrip('/')}/{file}", file.rpartition("/")[2], ordinal, data[:UHL]), data)

    def tile(self, tile: Tile, data: bytes) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<float>": pa.list_(pa.float32())}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        own = {"file": tile.file, "ordinal": tile.ordinal, "error": tile.error}
        if tile.error is None:
            own |= {side: getattr(tile, side) for side in _BOX} | {"min_lon": tile.west - tile.step_lon / 2, "max_lat": tile.north + tile.step_lat / 2, "step_lon": tile.step_lon, "step_lat": tile.step_lat}
            grid, own["error"] = decoded(tile, data)
            for row in range(0, tile.points, SIDE):
                for col in range(0, tile.lines, SIDE):
                    piece = grid[row : row + SIDE, col : col + SIDE]
                    yield pa.RecordBatch.from_pylist([own | {"row0": row, "col0": col, "rows": piece.shape[0], "cols": piece.shape[1], "cells": piece.ravel(), "error": None}], schema=schema)
        if own["error"]:
            yield pa.RecordBatch.from_pylist([own], schema=schema)


class Dted(D.DataSource):
    """``spark.read.format("dted").load(path)``: a row for each piece of a tile, and one with the error of a file that is wrong."""

    @classmethod
    def name(cls) -> str:
        return "dted"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DtedReader:
        boxes = self.options.get("boxes")
        return DtedReader(self.options["path"], json.loads(boxes) if boxes else None, int(self.options.get("bytes", BATCH_BYTES)))


def read_tiles(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]] | None = None, size: int = BATCH_BYTES) -> DataFrame:
    """The pieces of the DTED files under a path (``SCHEMA``), of all or of those that meet one of ``boxes`` (west, south, east, north).

    The boxes go with the source, not with a filter: filters pushed down to a Python source are kept by it in this version of Spark, so that
    two plans on one table would read by each other's.

    A piece has its tile's box (west to north, of the outer elevations), the tile's corner (min_lon, max_lat, half an interval beyond them), and
    its place, size and elevations; a later file's ordinal is higher.  A file of a wrong header, sum or length has a row with its ``error``
    and no cells; its good lines come all the same.
    """
    spark.dataSource.register(Dted)
    source = spark.read.format("dted").option("bytes", size)
    return (source if boxes is None else source.option("boxes", json.dumps(boxes))).load(path)
