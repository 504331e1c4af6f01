"""Run outcomes: exit codes from output text, what to do with a stopped job, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.functions import ids, states, text
from jobtide.operators.lookup import lookup_join
from jobtide.operators.ordered import running_sums
from jobtide.schema import (CODE_BATCH_ERROR, CODE_INVALID_RESPONSE, CODE_NO_RESPONSE, EXIT_ERROR,
                            RETRY_WINDOW_MS, STOPPED_BATCH_SIZE)


def scoreboard(runs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Last exit code and number of attempts per job (by stop time, then attempt)."""
    last = F.struct("stopped", "attempt")
    return runs.groupBy("id").agg(
        F.max_by("exitcode", last).alias("exitcode"),
        *[F.max_by(c, last).alias(c) for c in extra],
        F.count(F.lit(1)).alias("attempts"))


def outcome_class(runs: DataFrame) -> DataFrame:
    code = F.col("exitcode")
    return runs.withColumn("class", states.outcome_class(code)).withColumn(
        "action", F.when(states.is_final(code), "archive").otherwise("retry"))


def disposition(exitcode: Column, job_id: Column, now, window_ms: int = RETRY_WINDOW_MS) -> Column:
    """``archive``, ``retry``, or ``abandon`` for jobs created before the retry window."""
    oldest = states.plus_ms(states.instant(now), -window_ms)
    return (F.when(states.is_final(exitcode), "archive")
            .when(ids.created_at(job_id) >= oldest, "retry").otherwise("abandon"))


def retry_or_abandon(runs: DataFrame, now, window_ms: int = RETRY_WINDOW_MS) -> DataFrame:
    return runs.withColumn("action", disposition(F.col("exitcode"), F.col("id"), now, window_ms))


def take_stopped(runs: DataFrame, limit: int = STOPPED_BATCH_SIZE) -> DataFrame:
    """Flags the first ``limit`` runs in the order they stopped; the others are the rest."""
    key = ["id", "attempt"]
    first = (runs.select("stopped", *key).orderBy("stopped", *key).limit(limit)
             .select(*key, F.lit(True).alias("taken")))
    return runs.join(first, key, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


# The output of a call is one text value, so its lines are told apart inside the row.


def _lines(output: Column) -> Column:
    return F.split(text.trim_text(output), "\n")


def _is_comment(line: Column) -> Column:
    return F.startswith(line, F.lit("#"))


def responses(output: Column) -> Column:
    return F.filter(_lines(output), lambda s: (s != "") & ~_is_comment(s))


def comments(output: Column) -> Column:
    return F.filter(_lines(output), _is_comment)


def new_job_lines(output: Column) -> Column:
    return F.filter(_lines(output), lambda s: F.startswith(s, F.lit("#J: ")))


def split_output(outputs: DataFrame) -> DataFrame:
    """Output text (batch, output) to lines (batch, kind, pos, line), pos within the kind."""
    kinds = F.explode(F.array(
        F.struct(F.lit("response").alias("kind"), responses(F.col("output")).alias("lines")),
        F.struct(F.lit("comment").alias("kind"), comments(F.col("output")).alias("lines")),
        F.struct(F.lit("new_job").alias("kind"), new_job_lines(F.col("output")).alias("lines"))))
    return (outputs.select("batch", kinds.alias("k"))
            .select("batch", "k.kind", F.posexplode("k.lines").alias("pos", "line")))


def align_outcomes(batch_jobs: DataFrame, outputs: DataFrame, *extra: str) -> DataFrame:
    """Job ``pos`` of a batch gets the code that response ``pos`` starts with.

    A job without a response fails with NO_RESPONSE. A response without a code fails its job and
    those of all later responses with INVALID_RESPONSE: one bad line makes the rest untrusted.
    """
    codes = F.transform(responses(F.col("output")), text.leading_code)
    read = outputs.select("batch", codes.alias("codes")).select(
        "batch", F.array_position(F.transform("codes", lambda c: c.isNull()), F.lit(True)).alias("bad"),
        F.posexplode("codes").alias("pos", "response"))
    read = read.select("batch", "pos", F.when(
        (F.col("bad") == 0) | (F.col("pos") + 1 < F.col("bad")), F.col("response")).alias("response"),
        F.lit(True).alias("answered"))
    joined = batch_jobs.join(read, ["batch", "pos"], "left")
    code = (F.when(F.col("answered").isNull(), CODE_NO_RESPONSE)
            .when(F.col("response").isNull(), CODE_INVALID_RESPONSE))
    return joined.select(
        "batch", "pos", "id", "type",
        F.coalesce("response", F.lit(EXIT_ERROR)).cast("int").alias("exitcode"),
        code.alias("code"), *extra)


def call_outcomes(batch_jobs: DataFrame, calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Exit code, code and duration of every job of every call.

    A failed call fails all its jobs with its own code, a call for a single job gives that its
    status, and a batch call the lines of its output (see :func:`align_outcomes`). A duration belongs to the call, so
    it comes to the jobs with what else the call has, however often an id is in it.
    """
    kinds = _call_durations(calls, outputs, "is_batch", "failed", "error_code", "status")
    rows = lookup_join(batch_jobs.select("batch", "pos", "id", "type"), kinds, "batch", "id", "inner")
    read = F.coalesce(F.col("is_batch"), F.lit(True)) & ~F.coalesce(F.col("failed"), F.lit(False))
    by_line = align_outcomes(rows.where(read), outputs, "duration")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    whole = rows.where(~read).select(
        "batch", "pos", "id", "type",
        F.when(failed, F.lit(EXIT_ERROR)).otherwise(F.coalesce("status", F.lit(EXIT_ERROR))).cast("int").alias("exitcode"),
        F.when(failed, F.coalesce("error_code", F.lit(CODE_BATCH_ERROR)))
        .when(F.col("status").isNull(), CODE_NO_RESPONSE).alias("code"), "duration")
    return by_line.unionByName(whole)


def request_errors(batch_jobs: DataFrame, failed_calls: DataFrame) -> DataFrame:
    """Every job of a failed call (batch, error_code) fails with the call's code."""
    failed = failed_calls.select("batch", "error_code")
    return lookup_join(batch_jobs, failed, "batch", "id", "inner").select(
        "batch", "id", "type", F.lit(EXIT_ERROR).alias("exitcode"),
        F.coalesce("error_code", F.lit(CODE_BATCH_ERROR)).alias("code"))


def run_durations(batch_jobs: DataFrame, calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Milliseconds per job: the call's time, shared by its responses when it was a batch call.

    A batch call without any response has no duration (NULL).
    """
    return lookup_join(batch_jobs.select("batch", "id"), _call_durations(calls, outputs), "batch", "id")


def _call_durations(calls: DataFrame, outputs: DataFrame, *extra: str) -> DataFrame:
    """One row a call: (batch, duration) and the extra columns."""
    answered = outputs.select("batch", F.size(responses(F.col("output"))).alias("answers"))
    elapsed = F.unix_millis("stopped") - F.unix_millis("started")
    answers = F.when(F.col("answers") > 0, F.col("answers"))
    return calls.join(answered, "batch", "left").select(
        "batch", *extra, F.when(F.col("is_batch"), elapsed / answers).otherwise(elapsed.cast("double")).alias("duration"))


def chain_jobs(outputs: DataFrame, sysid: str, base_ms: int) -> DataFrame:
    """``#J: type|payload`` output lines to journal lines with fresh ids, in (batch, pos) order."""
    found = F.filter(
        F.transform(new_job_lines(F.col("output")), lambda s: F.substr(s, F.lit(5))),
        lambda s: s.rlike(r"^[^|]+\|"))
    wanted = outputs.select("batch", found.alias("found"))
    sizes = wanted.select("batch", F.size("found").cast("long").alias("_n"))
    starts = running_sums(sizes, [], ["batch"], {"_end": F.col("_n")}).select(
        "batch", (F.col("_end") - F.col("_n")).alias("_start"))
    lines = wanted.join(starts, "batch").select(
        "batch", "_start", F.posexplode("found").alias("pos", "body"))
    new_id = ids.numbered_id(F.col("_start") + F.col("pos"), F.lit(sysid), base_ms)
    return lines.select("batch", "pos", F.concat_ws("|", new_id, "body").alias("line"))


def held_job_ids(running: DataFrame, waiting: DataFrame, stopped: DataFrame) -> DataFrame:
    """Ids that runners still control, by where they are."""
    parts = [df.select("id", F.lit(name).alias("held_as"))
             for name, df in (("running", running), ("waiting", waiting), ("stopped", stopped))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
