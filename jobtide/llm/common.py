"""Shared helpers: table access, words, Arrow column functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtide.session import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUT_ROWS = 256  # values that one call of a chunk function gets at most
CHUNK_SIZE = 1_000_000  # characters (or list items) that such a call gets, unless one value has more


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """``text`` with A-Z in lower case and every other character as it was."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def chunks(values: pa.Array) -> Iterator[list]:
    """The values in lists of at most OUT_ROWS values and, but for a longer single one, CHUNK_SIZE."""
    part, held = [], 0
    for value in values:
        value = value.as_py()
        size = sum(map(len, filter(None, value.values()))) if isinstance(value, dict) else len(value or "")
        if part and (len(part) == OUT_ROWS or held + size > CHUNK_SIZE):
            yield part
            part, held = [], 0
        part.append(value)
        held += size
    if part:
        yield part


_held: dict[str, object] = {}  # of a worker process: the state of the function that ran in it last


def worker_state(key: str, build: Callable[[], object]):
    """What ``build`` gives, kept by a worker process until a task of another function starts in it."""
    if key not in _held:
        _held[key] = build()
    return _held[key]


def release_others(key: str) -> None:
    """Lets go of what earlier functions kept in this worker process."""
    for other in [k for k in _held if k != key]:
        del _held[other]


def per_chunk(spark: SparkSession, make: Callable[[], Callable], returns: str, kind: pa.DataType, key: str = "") -> Callable[..., Column]:
    """An Arrow column function: ``make()`` gives a function from a list of values to their results.

    ``make`` is called once per task, so it can build lookup tables from broadcast variables; what it
    keeps by :func:`worker_state` under ``key`` serves later tasks of the function too. The column counts
    as non-deterministic, so that a filter on it does not run it a second time.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release_others(key)
        f = make()
        for values in batches:
            done = [pa.array(f(part), kind) for part in chunks(values)]
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def per_value(spark: SparkSession, make: Callable[[], Callable], returns: str, kind: pa.DataType, key: str = "") -> Callable[..., Column]:
    """As :func:`per_chunk`, for a function of one value."""
    def each():
        f = make()
        return lambda part: [f(value) for value in part]

    return per_chunk(spark, each, returns, kind, key)


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def struct_of(**types: pa.DataType) -> pa.StructType:
    return pa.struct([pa.field(name, kind) for name, kind in types.items()])


def sha256_of(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
