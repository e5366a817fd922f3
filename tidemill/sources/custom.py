"""Sources of one's own: streams that read from anything with numbered positions, and receivers of pushed records."""

from __future__ import annotations

import json
import socket
import struct
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage


class PositionedReader:
    """What a stream source has to supply, for connect(): where it stands now, how a range is dealt out, and a part's rows.

    Positions are integers. A range that was planned must give the same rows whenever it is read again.
    """

    def latest(self) -> int:
        raise NotImplementedError

    def parts(self, start: int, end: int) -> list[tuple[int, int]]:
        return [(start, end)]

    def read(self, start: int, end: int) -> Iterator[tuple]:
        raise NotImplementedError


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Stream(DataSourceStreamReader):
    def __init__(self, reader: PositionedReader, most: int):
        self.reader, self.most, self.at = reader, most, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        end = self.reader.latest()
        self.at = min(end, self.at + self.most) if self.most else end
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])
        return [_Range(a, b) for a, b in self.reader.parts(start["at"], end["at"]) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.reader.read(partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


def connect(spark: SparkSession, name: str, make, schema: str) -> None:
    """Registers a stream source: make(options) gives a PositionedReader. Option `most` bounds the positions of a batch."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema):
            return _Stream(make(dict(self.options)), int(self.options.get("most", 0)))

    spark.dataSource.register(Source)


class BlockFile(PositionedReader):
    """A file of length-prefixed blocks (four bytes, big end first), as block streams over sockets have them. A position is a block's number."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _blocks(self) -> Iterator[bytes]:
        with open(self.path, "rb") as f:
            while len(head := f.read(4)) == 4:
                body = f.read(struct.unpack(">I", head)[0])
                yield body

    def latest(self) -> int:
        return sum(1 for _ in self._blocks())

    def parts(self, start: int, end: int) -> list[tuple[int, int]]:
        step = max(1, (end - start + 7) // 8)
        return [(i, min(end, i + step)) for i in range(start, end, step)]

    def read(self, start: int, end: int) -> Iterator[tuple]:
        for i, body in enumerate(self._blocks()):
            if start <= i < end:
                yield i, body


class LineSocket(DataSource):
    """Lines of a TCP connection, split by an option `delimiter` (a line end by default) and decoded as UTF-8."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_socket"

    def schema(self) -> str:
        return "position long, value string"

    def simpleStreamReader(self, schema):
        return _LineReader(dict(self.options))


class _LineReader(SimpleDataSourceStreamReader):
    """Keeps what it has received until it is committed, so that a batch can be read again. Runs on the driver: for feeds of few records."""

    def __init__(self, options: dict):
        self.options, self.held, self.first, self.rest, self.line = options, [], 0, b"", None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _receive(self) -> None:
        if self.line is None:
            self.line = socket.create_connection((self.options["host"], int(self.options["port"])), timeout=10)
            self.line.settimeout(0.2)
        end = self.options.get("delimiter", "\n").encode().decode("unicode_escape").encode()
        try:
            while data := self.line.recv(1 << 16):
                *lines, self.rest = (self.rest + data).split(end)
                self.held += [x.decode("utf-8", "replace") for x in lines]
        except TimeoutError:
            pass

    def read(self, start: dict):
        self._receive()
        at = start["at"] - self.first
        rows = [(self.first + at + i, x) for i, x in enumerate(self.held[at:])]
        return iter(rows), {"at": self.first + len(self.held)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(i, self.held[i - self.first]) for i in range(start["at"], end["at"])])

    def commit(self, end: dict) -> None:
        drop = end["at"] - self.first
        self.held, self.first = self.held[drop:], end["at"]


def converted_socket(spark: SparkSession, host: str, port: int, convert, schema: str, delimiter: str = "\n") -> DataFrame:
    """A socket stream whose records a function turns into rows: convert(text) gives tuples of `schema`."""
    spark.dataSource.register(LineSocket)
    lines = spark.readStream.format("tidemill_socket").option("host", host).option("port", str(port)).option("delimiter", delimiter).load()
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [row for text in b["value"] for row in convert(text)]
            if rows:
                yield pd.DataFrame(rows)

    return lines.mapInPandas(_named(run, schema), schema)


def _named(run, schema: str):
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def inner(batches):
        for df in run(batches):
            df.columns = names
            yield df

    return inner


class Pushed:
    """Records that a program hands over itself: put() appends to a folder that a file stream reads, as a receiver's store does."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None):
        from ..storage import scratch

        self.spark, self.schema, self.path = spark, schema, path or scratch(spark)
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)

    def put(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, per_batch: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(self.path)


class Receiver:
    """A program's own feed: work(put) runs on a thread and hands rows over with put(rows); after an error it starts again.

    Rows are stored `block` seconds apart, a file each, before a stream reads them, so that a batch that fails reads them again.
    """

    def __init__(self, pushed: Pushed, work, pause: float = 1.0, block: float = 0.2, tries: int = 10):
        self.pushed, self.work, self.pause, self.block, self.tries = pushed, work, pause, block, tries
        self.held: list[tuple] = []
        self.errors: list[BaseException] = []
        self._lock, self._end = threading.Lock(), threading.Event()
        self._threads = [threading.Thread(target=t, daemon=True) for t in (self._run, self._store)]

    def _put(self, rows: list[tuple]) -> None:
        with self._lock:
            self.held += rows

    def _run(self) -> None:
        for _ in range(self.tries):
            try:
                self.work(self._put)
                return
            except Exception as e:  # noqa: BLE001  kept for the caller; the feed starts again
                self.errors.append(e)
                if self._end.wait(self.pause):
                    return

    def _flush(self) -> None:
        with self._lock:
            rows, self.held = self.held, []
        if rows:
            self.pushed.put(rows)

    def _store(self) -> None:
        while not self._end.wait(self.block):
            self._flush()

    def start(self) -> Receiver:
        for t in self._threads:
            t.start()
        return self

    def stop(self, timeout: float = 10) -> None:
        """Waits for the feed to end, at most `timeout` seconds, and stores what it has handed over."""
        self._threads[0].join(timeout)
        self._end.set()
        self._threads[1].join()
        self._flush()


class Sink:
    """What a stream sink has to supply, for connect_sink(): writing one part of a batch, and making a batch count, once all its parts are written.

    A batch that runs again after a failure has the same number; what its parts left before must not count twice.
    """

    def write(self, batch_rows: Iterator) -> object:
        """On an executor; gives a message for done()."""
        raise NotImplementedError

    def done(self, messages: list, batch: int) -> None:
        raise NotImplementedError

    def failed(self, messages: list, batch: int) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, message: object):
        self.message = message


class _SinkWriter(DataSourceStreamWriter):
    def __init__(self, sink: Sink):
        self.sink = sink

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _Written(self.sink.write(iterator))

    def commit(self, messages: list, batchId: int) -> None:
        self.sink.done([m.message for m in messages if m is not None], batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.sink.failed([m.message for m in messages if m is not None], batchId)


def connect_sink(spark: SparkSession, name: str, make) -> None:
    """Registers a stream sink: make(options) gives a Sink."""

    class Target(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite):
            return _SinkWriter(make(dict(self.options)))

    spark.dataSource.register(Target)


def records(rows: list[dict]) -> list[str]:
    """Dictionaries as lines of JSON, for feeds of text."""
    return [json.dumps(r, sort_keys=True) for r in rows]
