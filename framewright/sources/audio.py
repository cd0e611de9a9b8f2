"""Decoded audio: files of mono little-endian float32 samples, as binary chunks.

A chunk holds ``CHUNK`` samples, a whole number of voice frames, so no row is ever a single sample.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RATE = 16_000
#: Samples of a chunk: ten seconds, a multiple of the 400 of a voice frame.
CHUNK = 160_000


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rid = options.get("rid", self.path.rsplit("/", 1)[-1])
        self.chunk = int(options.get("chunk", CHUNK))
        self.chunks = int(options.get("chunksPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        import os

        total = -(-(os.path.getsize(self.path) // 4) // self.chunk)
        return [Stretch(self.path, i, min(self.chunks, total - i)) for i in range(0, total, self.chunks)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(4 * partition.first * self.chunk)
            for i in range(partition.first, partition.first + partition.n):
                raw = f.read(4 * self.chunk)
                yield self.rid, i, i * self.chunk, raw[: len(raw) // 4 * 4]


class Pcm(DataSource):
    """Options: path (on a file system that every executor mounts), rid, chunk (samples), chunksPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "pcm_f32"

    def schema(self) -> str:
        return "rid string, chunk bigint, first bigint, samples binary"

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self.options)
