"""User-defined functions in vectorised form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectorised(fn: Callable[..., pd.Series], returns: str):
    """A function of whole columns as a Pandas UDF."""
    return F.pandas_udf(fn, returns)


def where_rows(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which a function of the whole row is true, evaluated on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep(b)]

    return df.mapInPandas(run, df.schema)


def table_function(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """A table-generating function: each batch of input rows gives any number of rows."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def aggregate_function(fn: Callable[..., object], returns: str):
    """An aggregate of whole columns of a group (pandas Series in, one value out). All rows of a group meet in one task."""
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(fn, returns, PandasUDFType.GROUPED_AGG)


def partial_aggregate(df: DataFrame, keys: list[str], columns: list[str], start: Callable, add: Callable, merge: Callable, finish: Callable, returns: str) -> DataFrame:
    """keys, value: an aggregate of one's own in two phases, for groups of any size.

    start() gives an empty state; add(state, pandas rows of one group in a batch) and merge(state, state) give states, which
    must pickle; finish(state) gives the value. States are made on the map side and merged one by one after the shuffle.
    """
    import pickle

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for b in batches:
            for k, rows in b.groupby(keys, dropna=False, sort=False):
                k = tuple(None if x is None or x != x else x for x in k)
                states[k] = add(states[k] if k in states else start(), rows[columns])
            if len(states) > 100_000:
                yield rows_of(states)
                states = {}
        if states:
            yield rows_of(states)

    def rows_of(states: dict) -> pd.DataFrame:
        out = pd.DataFrame([[*k, pickle.dumps(s)] for k, s in states.items()], columns=[*keys, "state"])
        return out

    def after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, done = None, None, []
        for b in batches:
            for row in b.itertuples(index=False):
                k = tuple(None if x is None or x != x else x for x in row[:-1])
                if last is not None and k != last:
                    done.append([*last, finish(state)])
                    state = None
                last = k
                s = pickle.loads(row[-1])
                state = s if state is None else merge(state, s)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=[*keys, "value"])
                done = []
        if last is not None:
            done.append([*last, finish(state)])
        if done:
            yield pd.DataFrame(done, columns=[*keys, "value"])

    partial = df.select(*keys, *columns).mapInPandas(before, f"{kinds}, state binary")
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(after, f"{kinds}, value {returns}")


def table_class(cls: type, returns: str):
    """A table function as a class: eval(row...) gives rows, terminate() the rows after the last one."""
    return F.udtf(cls, returnType=returns)
