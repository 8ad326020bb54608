"""Replay of message logs as a Python data source: in order, at a pace."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from weftline.functions.codec import START


def records(path: str) -> list[tuple[int, float, str]]:
    """line_no, ts and obj as JSON; start markers and lines that are no JSON are skipped."""
    out = []
    with open(path) as f:
        for i, line in enumerate(f):
            try:
                x = json.loads(line)
                if x.get("obj") != START:
                    out.append((i, float(x["ts"]), json.dumps(x["obj"])))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
    return out


class ReplayBatch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line_no, ts, obj in records(partition.value):
            yield partition.value, line_no, ts, obj, False, None


def lines_from(path: str, byte: int, most: int) -> Iterator[tuple[bytes, int]]:
    """Up to `most` lines from a byte on, each with the byte where the next one begins."""
    with open(path, "rb") as f:
        f.seek(byte)
        for _ in range(most):
            if not (line := f.readline()):
                return
            yield line, f.tell()


def message(line: bytes) -> tuple[float | None, str | None]:
    """ts and obj as JSON; neither for start markers and lines that are no messages."""
    try:
        x = json.loads(line)
        return (None, None) if x["obj"] == START else (float(x["ts"]), json.dumps(x["obj"]))
    except (ValueError, KeyError, TypeError):
        return None, None


class ReplayStream(SimpleDataSourceStreamReader):
    """Replays files in order, a row for each line and a last one for each file.

    A step gives the lines that are due by now, `step` at most; it never waits
    itself, so pauses of any length hold.  The offset has the file's place in
    the queue, the byte and number of the next line, the messages sent, when
    the file began and how many commands were read: a step reads on from
    there, and a restarted query goes on where it was.

    Commands are lines that are appended to a control file: pause, resume,
    skip (go to the next file), stop (and forget the queue), add PATH.
    """

    def __init__(self, path: str, rate: float | None, step: int, control: str | None = None, clock: Callable[[], float] = time.time):
        self.paths, self.rate, self.step, self.control, self.clock = path.split(","), rate, step, control, clock

    def initialOffset(self) -> dict:
        return {"file": 0, "byte": 0, "line": 0, "sent": 0, "began": None, "first": None, "commands": 0, "paused": False, "added": [], "from": 0, "end": False}

    def queue(self, at: dict) -> list[str]:
        return [*self.paths, *at["added"]]

    def obey(self, at: dict) -> dict:
        """The offset after commands that are new."""
        if self.control is None or not os.path.exists(self.control):
            return at
        with open(self.control) as f:
            commands = f.read().splitlines()
        for line in commands[at["commands"] :]:
            word, _, rest = line.strip().partition(" ")
            if word == "add":
                at = {**at, "added": [*at["added"], rest.strip()]}
            elif word in ("pause", "resume"):
                at = {**at, "paused": word == "pause"}
            elif word in ("skip", "stop") and at["file"] < len(self.queue(at)):
                at = {**at, "end": True, "from": len(self.queue(at)) if word == "stop" else at["from"]}
        return {**at, "commands": len(commands)}

    def due(self, at: dict, ts: float | None, sent: int) -> float:
        """When a message is due."""
        if self.rate is None or ts is None:
            return 0.0
        return at["began"] + ((sent + 1) / self.rate if self.rate > 0 else ts - at["first"])

    def advance(self, at: dict, most: int, until: float | None) -> tuple[list[tuple], dict]:
        """Rows of up to `most` lines that are due until then, or all of them, and the offset after them."""
        rows: list[tuple] = []
        while len(rows) < most and at["file"] < len(self.queue(at)):
            path = self.queue(at)[at["file"]]
            done = at["end"]
            if not done:
                if at["began"] is None:
                    at = {**at, "began": until if until is not None else 0.0}
                for line, after in lines_from(path, at["byte"], most - len(rows)):
                    ts, obj = message(line)
                    if at["first"] is None and ts is not None:
                        at = {**at, "first": ts}
                    if until is not None and self.due(at, ts, at["sent"]) > until:
                        return rows, at
                    at = {**at, "byte": after, "line": at["line"] + 1, "sent": at["sent"] + (obj is not None)}
                    rows.append((path, at["line"], ts, obj, False, None))
                done = at["byte"] >= os.path.getsize(path)
            if done and (len(rows) < most or at["end"]):
                rows.append((path, at["line"], None, None, True, at["sent"]))
                at = {**at, "file": max(at["file"] + 1, at["from"]), "byte": 0, "line": 0, "sent": 0, "began": None, "first": None, "end": False}
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = self.obey({k: v for k, v in start.items() if k not in ("rows", "state")})
        rows, end = ([], at) if at["paused"] else self.advance(at, self.step, self.clock())
        return iter(rows), {**end, "rows": len(rows), "state": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A step again, as the offset says it began: neither clock nor commands count."""
        return iter(self.advance(end["state"], end["rows"], None)[0])


class Replay(DataSource):
    """options: path (comma-separated files), rate (messages a second; 0: as logged; absent: at once), step, control (a file of commands).

    Rows: file, line_no (from 1 in streams, the line's number from 0 in
    batches), ts, obj (JSON; null for lines that are no message), done (the
    row that ends a file) and total (its messages).
    """

    @classmethod
    def name(cls) -> str:
        return "message_replay"

    def schema(self) -> str:
        return "file string, line_no bigint, ts double, obj string, done boolean, total bigint"

    def reader(self, schema: object) -> DataSourceReader:
        return ReplayBatch(self.options["path"])

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        rate = self.options.get("rate")
        return ReplayStream(self.options["path"], None if rate is None else float(rate), int(self.options.get("step", "1000")), self.options.get("control"))


def messages(rows: DataFrame) -> DataFrame:
    """What was logged."""
    return rows.where("obj is not null").select("file", "line_no", "ts", "obj")


def status(rows: DataFrame) -> DataFrame:
    """How far each file is."""
    return rows.select("file", F.col("line_no").alias("idx"), "done")


def totals(rows: DataFrame) -> DataFrame:
    """Messages of each file that is through."""
    return rows.where("done").select("file", "total")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Replay)
