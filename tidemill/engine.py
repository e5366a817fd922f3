"""The engine's front door: a catalog of tables and streams, and SQL over both."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.files import read_table
from .streaming.ddl import StreamDef, alike, parse
from .streaming.streams import StreamQuery

_MULTI = re.compile(r"\s*from\s+(.*?)\s+(insert\s+(?:into|overwrite)\b.*)$", re.I | re.S)
_SHELL = re.compile(r"\s*(!|dfs\s)", re.I)
_SOURCE = re.compile(r"\s*source\s+(\S+?)\s*;?\s*$", re.I)


def statements(text: str) -> list[str]:
    """The statements of a script, without comments."""
    out, now = [], ""
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|;|[^;'\"`/-]+|.", text, re.S):
        x = m[0]
        if x == ";":
            out.append(now.strip())
            now = ""
        elif not x.startswith(("--", "/*")):
            now += x
    return [s for s in [*out, now.strip()] if s]


class Engine:
    """Tables are temporary views or catalog tables, streams are definitions in one registry that DDL and code share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.streams: dict[str, StreamDef] = {}

    def load(self, sf_dir: str, *names: str) -> Engine:
        for n in names:
            read_table(self.spark, f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
        return self

    def register_table(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_stream(self, name: str, df: DataFrame) -> None:
        """df: a streaming DataFrame."""
        if not df.isStreaming:
            raise ValueError(f"{name} is not a stream")
        self.streams[name.lower()] = StreamDef(name.lower(), frame=df)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def rows(self, data: list, schema: str) -> DataFrame:
        """A table of given rows: tuples, Row objects or dictionaries."""
        return self.spark.createDataFrame(data, schema)

    def empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def save_as_table(self, name: str, df: DataFrame, by: list[str] | None = None, kind: str = "parquet") -> None:
        """A catalog table from a query's rows; raises if it exists."""
        writer = df.write.format(kind)
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)

    def insert_into(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """Rows into a catalog table by place of column. Overwriting a partitioned table replaces the partitions that df has rows for."""
        from .storage import settings

        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            df.write.insertInto(name, overwrite=overwrite)

    def cache(self, name: str) -> None:
        self.spark.catalog.cacheTable(name)

    def uncache(self, name: str) -> None:
        self.spark.catalog.uncacheTable(name)

    def relations(self, text: str) -> set[str]:
        """Names of the tables and streams that a text reads, by Spark's own parser; empty for texts that it rejects."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception:  # a command of its own; running the text gives the error
            return set()
        return {n.split(",")[-1].strip().strip("`").lower() for n in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan.toString())}

    def streams_in(self, text: str) -> list[str]:
        return sorted(self.relations(text) & set(self.streams))

    def _opened(self, names: list[str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
        """The base streams behind these names, and the derived ones (name, text) in the order they build on each other."""
        base: dict[str, DataFrame] = {}
        derived: list[tuple[str, str]] = []

        def visit(n: str) -> None:
            d = self.streams[n]
            if not d.select:
                base.setdefault(n, d.open(self.spark))
            elif n not in [x for x, _ in derived]:
                for m in self.streams_in(d.select):
                    visit(m)
                derived.append((n, d.select))

        for n in names:
            visit(n)
        return base, derived

    def sql(self, text: str) -> DataFrame | StreamQuery | None:
        """A DataFrame for tables; a StreamQuery, run batch by batch, if the text reads a stream; None for stream DDL.

        FROM t INSERT ... INSERT ... writes every target from one reading of t. SET, ADD JAR and ADD FILE are Spark's own; SOURCE
        runs a file of statements. Shell commands are refused.
        """
        if _SHELL.match(text):
            raise ValueError("commands of a shell are not part of a query text")
        if m := _SOURCE.match(text):
            return self.script("\n".join(r[0] for r in self.spark.read.text(m[1], wholetext=True).collect()))
        ddl = parse(text)
        if ddl:
            return self._ddl(*ddl)
        named = self.streams_in(text)
        if not named:
            return self.spark.sql(text)
        if re.match(r"\s*insert\b", text, re.I) or _MULTI.match(text):
            raise ValueError("write a stream's results with StreamQuery.start or table")
        base, derived = self._opened(named)
        return StreamQuery(self.spark, base, text, derived)

    def script(self, text: str) -> DataFrame | StreamQuery | None:
        """Statements divided by semicolons, outside of quotes and comments; the last one's result."""
        out = None
        for part in statements(text):
            out = self.sql(part)
        return out

    def _ddl(self, action: str, d: StreamDef | None, quiet: bool) -> DataFrame | None:
        if action == "show":
            return self.spark.createDataFrame([(n,) for n in sorted(self.streams)], "name string")
        known = d.name in self.streams
        if action == "create":
            if known and not quiet:
                raise ValueError(f"stream {d.name} exists")
            if not known:
                if d.like:
                    d = alike(d, self._known(d.like))
                elif d.select and not self.streams_in(d.select):
                    raise ValueError("a derived stream must read a stream")
                self.streams[d.name] = d
            return None
        if action == "describe":
            d = self._known(d.name)
            schema = d.frame.schema if d.frame is not None else d.schema()
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment")) for f in schema.fields], "col_name string, data_type string, comment string")
        if not known and not quiet:
            raise ValueError(f"no stream {d.name}")
        self.streams.pop(d.name, None)
        return None

    def _known(self, name: str) -> StreamDef:
        if name not in self.streams:
            raise ValueError(f"no stream {name}")
        return self.streams[name]

    def explain(self, text: str) -> str:
        return self.spark.sql(f"EXPLAIN FORMATTED {text}").first()[0]

    def traced(self, text: str, rows: int = 5) -> list[tuple[str, int, list]]:
        """A query's plan from the leaves up, with how many rows each step gives and the first few; each step is run, so only for looking into a query."""
        plan = self.spark.sql(text)._jdf.queryExecution().analyzed()
        out: list[tuple[str, int, list]] = []

        def walk(node) -> None:
            for i in range(node.children().size()):
                walk(node.children().apply(i))
            j = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, node)
            df = DataFrame(j, self.spark)
            out.append((node.nodeName(), df.count(), [tuple(r) for r in df.limit(rows).collect()]))

        walk(plan)
        return out

    def register_function(self, name: str, fn: Callable, returns: str) -> None:
        """A row function for SQL texts; what functions.udfs makes (vectorised, aggregate or table functions) registers as it is."""
        if hasattr(fn, "evalType") or type(fn).__name__ == "UserDefinedTableFunction":
            (self.spark.udtf if type(fn).__name__ == "UserDefinedTableFunction" else self.spark.udf).register(name, fn)
        else:
            self.spark.udf.register(name, fn, returns)

    def register_java(self, name: str, java_class: str, returns: str | None = None, aggregate: bool = False) -> None:
        """A function or an aggregate from a class on the session's class path."""
        if aggregate:
            self.spark.udf.registerJavaUDAF(name, java_class)
        else:
            self.spark.udf.registerJavaFunction(name, java_class, returns)
