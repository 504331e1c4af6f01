"""Running the stored handlers of job types over their payloads."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from jobtide.operators.handlers import latest_handler
from jobtide.operators.lookup import lookup_join
from jobtide.schema import CODE_BAD_HANDLER, CODE_INVALID_RESPONSE, EXIT_ERROR
from jobtide.session import ship_package

BATCHES_A_SHARD = 64
RESULT = "id string, type string, exitcode int, code string, duration double, output string"


@dataclass(frozen=True)
class PayloadHandler:
    """``body(payload)`` returns an exit code, or an exit code and output text.

    ``before_each`` and ``after_each`` run once per batch around its jobs.
    """
    body: Callable
    before_each: Callable | None = None
    after_each: Callable | None = None


def _run_one(body: Callable, payload):
    try:
        got = body(payload)
    except Exception as err:  # a failing job must not fail its batch
        return EXIT_ERROR, type(err).__name__, None
    code, output = got if isinstance(got, tuple) else (got, None)
    if isinstance(code, bool) or not isinstance(code, int) or code < 0:
        return EXIT_ERROR, CODE_INVALID_RESPONSE, None
    return code, None, output


def _run_batch(handler: PayloadHandler | None, payloads) -> list[tuple]:
    if handler is None:
        return [(EXIT_ERROR, CODE_BAD_HANDLER, 0.0, None)] * len(payloads)
    try:
        if handler.before_each:
            handler.before_each()
    except Exception as err:
        return [(EXIT_ERROR, type(err).__name__, 0.0, None)] * len(payloads)
    rows = []
    for p in payloads:
        began = time.monotonic()
        code, why, output = _run_one(handler.body, p)
        rows.append((code, why, (time.monotonic() - began) * 1000, output))
    try:
        if handler.after_each:
            handler.after_each()
    except Exception as err:
        rows = [(EXIT_ERROR, type(err).__name__, r[2], None) for r in rows]
    return rows


def _usable(handler: dict | None) -> bool:
    return bool(handler and handler.get("lang") and handler.get("body"))


class Registry:
    """What runs a stored handler: a function for its very version, or else the maker for its language.

    ``versions`` maps (full type, handler id) to a :class:`PayloadHandler`; ``languages`` maps a language to a
    function from the stored handler (a dict of its columns) to one. A stored handler without lang or body runs
    nothing, as does one whose version and language are both unknown.
    """

    def __init__(self, languages: dict[str, Callable[[dict], PayloadHandler]] | None = None,
                 versions: dict[tuple[str, str], PayloadHandler] | None = None):
        self.languages, self.versions = languages or {}, versions or {}

    def bind(self, handler: dict | None) -> PayloadHandler | None:
        if not _usable(handler):
            return None
        exact = self.versions.get((handler["type"], handler["id"]))
        if exact is not None:
            return exact
        make = self.languages.get(handler["lang"])
        return make(handler) if make else None


def _with_handlers(jobs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Batches and, before them, the newest handler of their type, in one layout.

    ``_shard`` is a stretch of a type's batches. A handler's row is copied to each shard of its type, so it travels once
    a shard, not once a job, and in the same shuffle as the jobs.
    """
    newest = latest_handler(handlers)
    stored = F.to_json(F.struct(*newest.columns))
    shard = F.floor(F.col("batch_no") / BATCHES_A_SHARD).cast("bigint")
    last = jobs.groupBy("type").agg(F.max(shard).alias("_last"))
    copies = lookup_join(last, newest.select("type", stored.alias("_handler")), "type", "_last").where(F.col("_handler").isNotNull()).select(
        "type", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_shard"), F.lit(-1).cast("bigint").alias("batch_no"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("data"), "_handler")
    rows = jobs.select("type", shard.alias("_shard"), F.col("batch_no").cast("bigint"), "id", "data",
                       F.lit(None).cast("string").alias("_handler"))
    return rows.unionByName(copies)


def run_payloads(jobs: DataFrame, handlers: DataFrame, registry: Registry) -> DataFrame:
    """Runs each job's payload by the newest stored handler of its full type.

    Jobs need (id, type, data, batch_no); handlers are versions (type, id, lang, body, ...), see :func:`stored_handlers`.
    A missing handler, one without lang or body and one that the registry can't run give BAD_HANDLER.

    Batches are spread over tasks by shards of :data:`BATCHES_A_SHARD`, so a type with most of the jobs is spread too.
    A task streams its batches in order; only one batch is held at a time.
    """
    ship_package(jobs.sparkSession)

    def finish(batch: pd.DataFrame, handler: PayloadHandler | None) -> pd.DataFrame:
        rows = _run_batch(handler, batch["data"].tolist())
        out = pd.DataFrame(rows, columns=["exitcode", "code", "duration", "output"])
        out.insert(0, "id", batch["id"].to_numpy())
        out.insert(1, "type", batch["type"].to_numpy())
        return out

    def run(frames):
        rest = None  # the batch that may go on in the next frame
        bound, of = None, None
        keys = ["type", "_shard", "batch_no"]
        for frame in itertools.chain(frames, [None]):
            if frame is not None and rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            ended = frame is None
            frame = rest if ended else frame
            if frame is None or not len(frame):
                continue
            starts = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            ends = [*starts[1:], len(frame)]
            done = []
            for a, b in zip(starts, ends):
                if b == len(frame) and not ended:
                    break
                if frame["batch_no"].iat[a] < 0:
                    bound, of = registry.bind(json.loads(frame["_handler"].iat[a])), (frame["type"].iat[a], frame["_shard"].iat[a])
                    continue
                here = (frame["type"].iat[a], frame["_shard"].iat[a])
                done.append(finish(frame.iloc[a:b], bound if of == here else None))
            if done:
                yield pd.concat(done, ignore_index=True)
            rest = frame.iloc[starts[-1]:]

    placed = (_with_handlers(jobs, handlers).repartition("type", "_shard")
              .sortWithinPartitions("type", "_shard", "batch_no", "id"))
    return placed.mapInPandas(run, RESULT)
