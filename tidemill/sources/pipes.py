"""Rows through an external program: one process for each partition, lines in and lines out."""

from __future__ import annotations

import os
import shlex
import subprocess
import threading
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame


def pipe(
    df: DataFrame, command: str | list[str], env: dict[str, str] | None = None, separator: str = "\t", before: Iterable[str] = (), line: Callable[[dict], str] | None = None, check: bool = True, null: str = "\\N"
) -> DataFrame:
    """value: the lines that `command` writes for the lines it gets.

    A row goes in as one line, its columns joined by `separator` (or as line(row) gives it), after the lines of `before`.
    env adds to the process's environment, which also names the partition as TIDEMILL_PARTITION. A program that ends
    with another status than 0 fails the task, unless check is false; a null column goes in as `null`. An empty partition
    starts the program as well.
    """
    words, head, names = shlex.split(command) if isinstance(command, str) else list(command), list(before), df.columns

    def run(batches):
        from pyspark import TaskContext

        p = subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, env=os.environ | {"TIDEMILL_PARTITION": str(TaskContext.get().partitionId())} | (env or {}))
        failed: list[BaseException] = []
        said: list[str] = []

        def feed() -> None:
            try:
                for x in head:
                    p.stdin.write(x + "\n")
                for b in batches:
                    for row in b.to_pylist():
                        text = line(row) if line else separator.join(null if row[n] is None else str(row[n]) for n in names)
                        p.stdin.write(text + "\n")
            except BrokenPipeError:
                pass  # the program has read enough
            except BaseException as e:  # noqa: BLE001  raised below, in the task's own thread
                failed.append(e)
            finally:
                try:
                    p.stdin.close()
                except BrokenPipeError:
                    pass

        threads = [threading.Thread(target=feed, daemon=True), threading.Thread(target=lambda: said.append(p.stderr.read()[-2000:]), daemon=True)]
        for t in threads:
            t.start()
        try:
            lines: list[str] = []
            for x in p.stdout:
                lines.append(x.rstrip("\n"))
                if len(lines) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines = []
            status = p.wait()
            for t in threads:
                t.join()
            if failed:
                raise failed[0]
            if check and status:
                raise RuntimeError(f"{words[0]} ended with status {status}: {''.join(said)}")
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        finally:
            if p.poll() is None:
                p.kill()

    return df.mapInArrow(run, "value string")
