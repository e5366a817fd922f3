"""CREATE STREAM (columns, LIKE, AS SELECT), DROP STREAM, SHOW STREAMS and DESCRIBE STREAM."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEAD = re.compile(r"\s*create\s+stream\s+(if\s+not\s+exists\s+)?(\w+)\s*", re.I)
_DROP = re.compile(r"\s*drop\s+stream\s+(if\s+exists\s+)?(\w+)\s*;?\s*$", re.I)
_SHOW = re.compile(r"\s*show\s+streams\s*;?\s*$", re.I)
_DESCRIBE = re.compile(r"\s*desc(?:ribe)?\s+stream\s+(\w+)\s*;?\s*$", re.I)
NULL = "null"  # in text streams this word stands for no value, as \N does


@dataclass
class StreamDef:
    name: str
    columns: str = ""
    delimiter: str = "\x01"
    items: str = "\x02"
    keys: str = "\x03"
    kind: str = "text"
    location: str = ""
    comment: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    frame: DataFrame | None = None
    select: str = ""  # the text of a derived stream
    like: str = ""

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    def open(self, spark: SparkSession) -> DataFrame:
        """The stream's rows. Text streams split each line; what can't be cast, "null" and \\N are null."""
        if self.frame is not None:
            return self.frame
        files = self.properties.get("files", "1000")
        source = self.properties.get("source", "")
        if source == "socket" or re.match(r"(tcp|socket)://", self.location):
            host, _, port = re.sub(r"^\w+://", "", self.location).rstrip("/").partition(":")
            lines = spark.readStream.format("socket").options(host=self.properties.get("host", host), port=self.properties.get("port", port)).load()
        elif source == "kafka" or self.location.startswith("kafka://"):
            servers, _, topic = self.location.removeprefix("kafka://").partition("/")
            reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.properties.get("servers", servers)).option("subscribe", self.properties.get("topic", topic))
            lines = reader.load().select(F.col("value").cast("string").alias("value"))
        elif source:
            return spark.readStream.format(source).options(**{k: v for k, v in self.properties.items() if k != "source"}).schema(self.schema()).load()
        elif self.kind == "text":
            lines = spark.readStream.option("maxFilesPerTrigger", files).text(self.location)
        else:
            return spark.readStream.format(self.kind).schema(self.schema()).option("maxFilesPerTrigger", files).load(self.location)
        parts = F.split("value", re.escape(self.delimiter), -1)
        return lines.select(*[self._value(F.get(parts, F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(self.schema().fields)])

    def _value(self, text: Column, kind: T.DataType) -> Column:
        text = F.when((text == NULL) | (text == "\\N"), F.lit(None)).otherwise(text)
        if isinstance(kind, T.ArrayType):
            return F.transform(F.split(text, re.escape(self.items), -1), lambda x: self._value(x, kind.elementType))
        if isinstance(kind, T.MapType):
            pairs = F.transform(F.split(text, re.escape(self.items), -1), lambda x: F.split(x, re.escape(self.keys), 2))
            entries = F.transform(pairs, lambda p: F.struct(self._value(p[0], kind.keyType), self._value(F.get(p, F.lit(1)), kind.valueType)))
            return F.map_from_entries(entries)
        if isinstance(kind, T.StructType):
            parts = F.split(text, re.escape(self.items), -1)
            return F.when(text.isNotNull(), F.struct(*[self._value(F.get(parts, F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]))
        return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def _balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; quotes are skipped."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
    raise ValueError("a bracket is not closed")


def _text(pattern: str, rest: str) -> str | None:
    x = re.search(pattern + r"\s+'([^']*)'", rest, re.I)
    return None if x is None else x[1].encode().decode("unicode_escape")


def parse(text: str) -> tuple[str, StreamDef | None, bool] | None:
    """(create, drop, show or describe; definition; whether it may exist or be absent), or None for other text."""
    if _SHOW.match(text):
        return "show", None, False
    if m := _DESCRIBE.match(text):
        return "describe", StreamDef(m[1].lower()), False
    if m := _DROP.match(text):
        return "drop", StreamDef(m[2].lower()), bool(m[1])
    m = _HEAD.match(text)
    if not m:
        if re.match(r"\s*(create|alter)\s+stream\b", text, re.I):
            raise ValueError("this form of stream DDL is not supported")
        return None
    d, quiet, rest = StreamDef(m[2].lower()), bool(m[1]), text[m.end() :].rstrip().rstrip(";")
    if x := re.match(r"like\s+(\w+)\s*(.*)$", rest, re.I | re.S):
        d.like, rest = x[1].lower(), x[2]
    elif rest.startswith("("):
        end = _balanced(rest, 0)
        d.columns, rest = " ".join(rest[1 : end - 1].split()), rest[end:]
        d.schema()  # raises for what is no list of columns
    elif not re.match(r"(comment\s+'[^']*'\s*)?as\s+(select|with)\b", rest, re.I):
        raise ValueError("this form of stream DDL is not supported")
    if x := re.search(r"(?:^|\s)as\s+((?:select|with)\b.*)$", rest, re.I | re.S):
        d.select, rest = x[1], rest[: x.start()]
    d.comment = _text(r"^\s*comment", rest) or ""
    d.delimiter = _text(r"fields\s+terminated\s+by", rest) or d.delimiter
    d.items = _text(r"collection\s+items\s+terminated\s+by", rest) or d.items
    d.keys = _text(r"map\s+keys\s+terminated\s+by", rest) or d.keys
    if x := re.search(r"stored\s+as\s+(\w+)", rest, re.I):
        d.kind = {"textfile": "text"}.get(x[1].lower(), x[1].lower())
    d.location = _text(r"location", rest) or ""
    if x := re.search(r"tblproperties\s*(?=\()", rest, re.I):
        inside = rest[x.end() : _balanced(rest, x.end())]
        d.properties = dict(re.findall(r"['\"]([^'\"]+)['\"]\s*=\s*['\"]([^'\"]*)['\"]", inside))
    return "create", d, quiet


def alike(d: StreamDef, other: StreamDef) -> StreamDef:
    """d with the columns and format of another stream, and its place unless d names one."""
    return replace(other, name=d.name, location=d.location or other.location, comment=d.comment, properties=other.properties | d.properties, frame=other.frame, like="")
