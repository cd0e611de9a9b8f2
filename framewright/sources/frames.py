"""Raw video frames and model files.

``rgb24`` is a Python data source over files of raw rgb24 frames: one partition for each run of frames, so a file of any
length is read in parallel; a short last frame is left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Run(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class Rgb24Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fps = options["path"], float(options.get("fps", 25))
        self.size = 3 * int(options["width"]) * int(options["height"])
        self.run = int(options.get("framesPerPartition", 256))
        self.rid = options.get("rid", self.path.rsplit("/", 1)[-1])

    def partitions(self) -> list[InputPartition]:
        import os

        total = os.path.getsize(self.path) // self.size
        return [Run(self.path, i, min(self.run, total - i)) for i in range(0, total, self.run)]

    def read(self, partition: Run) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.size)
            for i in range(partition.first, partition.first + partition.n):
                yield self.rid, i, i / self.fps, f.read(self.size)


class Rgb24(DataSource):
    """Options: path (on a file system that every executor mounts), width, height, fps, rid, framesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "rgb24"

    def schema(self) -> str:
        return "rid string, frame bigint, time_s double, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return Rgb24Reader(self.options)


#: Layout by file length: (features, logo weight, channel weights, loudness weight).
LAYOUTS = {5124: (1280, False, 0, False), 5128: (1280, True, 0, False), 5148: (1280, False, 6, False), 5152: (1280, True, 6, False), 5132: (1280, True, 0, True), 5156: (1280, True, 6, True)}


def parse_head(content: bytes) -> dict:
    """A head file's weights, little-endian floats in the order features, logo, channels, loudness, bias."""
    if len(content) not in LAYOUTS:
        raise ValueError(f"a head of {len(content)} bytes has no known layout")
    n, logo, channels, loud = LAYOUTS[len(content)]
    v = struct.unpack(f"<{len(content) // 4}f", content)
    at = n + logo
    return {"w": list(v[:n]), "w_logo": v[n] if logo else 0.0, "w_channels": list(v[at : at + channels]), "w_rms": v[at + channels] if loud else 0.0, "bias": v[-1]}


def write_head(w: list[float], bias: float, w_logo: float | None = None, w_channels: list[float] = (), w_rms: float | None = None) -> bytes:
    v = [*w, *([] if w_logo is None else [w_logo]), *w_channels, *([] if w_rms is None else [w_rms]), bias]
    return struct.pack(f"<{len(v)}f", *v)


HEADS = "path string, w array<float>, w_logo float, w_channels array<float>, w_rms float, bias float"


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, w_logo, w_channels, w_rms, bias): head files as weights; a file of no known layout is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                h = {"path": path, **parse_head(content)}
                yield pa.RecordBatch.from_pylist([h], pa.schema([("path", pa.string()), ("w", pa.list_(pa.float32())), ("w_logo", pa.float32()), ("w_channels", pa.list_(pa.float32())), ("w_rms", pa.float32()), ("bias", pa.float32())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, HEADS)


# Size, means and deviations of the network's input.
INPUT = 224
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)


def network_input(rgb: np.ndarray, side: int = INPUT) -> np.ndarray:
    """A frame as planes of float32: bilinear at the top left corners, to 0..1, then by mean and deviation."""
    h, w = rgb.shape[:2]

    def axis(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(side, dtype=np.float32) * np.float32(n / side)
        lo = at.astype(np.int64)
        return lo, np.minimum(lo + 1, n - 1), at - lo.astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = axis(h), axis(w)
    wide = rgb.astype(np.float32)
    fx, fy = fx[None, :, None], fy[:, None, None]
    top = wide[y0][:, x0] * (1 - fx) + wide[y0][:, x1] * fx
    low = wide[y1][:, x0] * (1 - fx) + wide[y1][:, x1] * fx
    mixed = (top * (1 - fy) + low * fy) / np.float32(255)
    return ((mixed - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)).transpose(2, 0, 1)


def preprocessed(frames: DataFrame, width: int, height: int, side: int = INPUT) -> DataFrame:
    """(rid, frame, input): the network's input as little-endian float32 bytes, plane by plane."""
    own = frames.select("rid", "frame", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("pixels")):
                a = network_input(np.frombuffer(raw.as_buffer(), np.uint8, 3 * width * height).reshape(height, width, 3), side)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("rid"), one.column("frame"), pa.array([a.astype("<f4").tobytes()], pa.binary())], names=["rid", "frame", "input"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("rid", "frame")}
    return own.mapInArrow(run, f"rid {kinds['rid']}, frame {kinds['frame']}, input binary")


def encoded(frames: DataFrame, encoder: Callable[[], Callable[[list[bytes]], list]], schema: str, batch: int = 8, column: str = "pixels") -> DataFrame:
    """Frames through a frozen network: encoder() builds, once a task, a function from a list of byte strings to rows.

    The network sees ``batch`` frames at a time, fewer only at the end of an Arrow batch.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        model = encoder()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"rid": part["rid"].values, "frame": part["frame"].values, "features": list(model(list(part[column])))})

    return frames.select("rid", "frame", column).mapInPandas(run, schema)


# ---- pictures of bumpers

#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing as rows of rgb; transparency darkens towards black."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, chunks = 8, {}
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    step = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height + 1, width + 1, step), np.int32)  # a row and a pixel of zeros before the first
    for y in range(height):
        line, up = raw[y, 1:].reshape(width, step).astype(np.int32), rows[y, 1:]
        how = raw[y, 0]
        if how == 2:
            line = line + up
        elif how == 1:
            line = np.cumsum(line, axis=0)
        elif how in (3, 4):
            own = rows[y + 1]
            for x in range(width):
                left, above, corner = own[x], rows[y, x + 1], rows[y, x]
                guess = (left + above) // 2 if how == 3 else _paeth(left, above, corner)
                own[x + 1] = (line[x] + guess) & 255
            continue
        rows[y + 1, 1:] = line & 255
    px = rows[1:, 1:]
    if colour == 3:
        alpha = np.full(256, 255)
        transparent = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)
        alpha[: len(transparent)] = transparent
        rgb = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3).astype(np.int32)[px[..., 0]]
        return (rgb * alpha[px[..., 0]][..., None] // 255).astype(np.uint8)
    rgb = np.repeat(px[..., :1], 3, axis=2) if colour in (0, 4) else px[..., :3]
    return (rgb * px[..., -1:] // 255 if colour in (4, 6) else rgb).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """To a frame's size by the nearest pixel at or before."""
    return rgb[np.arange(height) * rgb.shape[0] // height][:, np.arange(width) * rgb.shape[1] // width]


def bumper_templates(spark: SparkSession, path: str, width: int, height: int, threshold: int = 80) -> DataFrame:
    """(path, mask, white): bumper pictures (PNG) at a frame's size as the bits of pixels above the threshold."""
    from framewright.operators.pixels import luma_of, words_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                bits = (luma_of(resized(decode_png(content), width, height)) > threshold).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words_of(bits)], pa.list_(pa.int64())), pa.array([int(bits.sum())], pa.int64())], names=["path", "mask", "white"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, mask array<bigint>, white bigint")
