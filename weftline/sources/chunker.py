"""An array in chunks as a Python data source: a batch, or a stream that gives so many chunks a step."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def cut_chunks(data: list[float], size: int, fs: float, tzero: float, start: int, end: int) -> Iterator[tuple[int, float, list[float]]]:
    for i in range(start, end):
        yield i, i * size / fs + tzero, data[i * size : (i + 1) * size]


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str], per_part: int = 100):
        self.given, self.per_part = given(options), per_part

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, count(*self.given[:2]), self.per_part)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return cut_chunks(*self.given, partition.value, min(partition.value + self.per_part, count(*self.given[:2])))


class ChunkStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.given, self.step = given(options), int(options.get("step", "10"))

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(count(*self.given[:2]), start["chunk"] + self.step)
        return iter(list(cut_chunks(*self.given, start["chunk"], end))), {"chunk": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(cut_chunks(*self.given, start["chunk"], end["chunk"])))


def given(options: dict[str, str]) -> tuple[list[float], int, float, float]:
    return json.loads(options["data"]), int(options.get("chunk_len", "10")), float(options.get("fs", "1000")), float(options.get("tzero", "0"))


def count(data: list[float], size: int) -> int:
    return -(-len(data) // size)


class Chunks(DataSource):
    """options: data (JSON array), chunk_len, fs, tzero; step (chunks a step of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "array_chunks"

    def schema(self) -> str:
        return "chunk int, offset double, data array<double>"

    def reader(self, schema: object) -> DataSourceReader:
        return ChunkReader(dict(self.options))

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return ChunkStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Chunks)
