"""Table-to-table state changes.

Each returns the next jobs table with a flag column (``changed``, ``removed`` or ``accepted``)
from one projection over the table, so :func:`next_table` and :func:`affected` read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtide.functions import ids, states
from jobtide.operators.lookup import lookup_join
from jobtide.operators.ordered import nth_in_order, number_rows
from jobtide.operators.outcomes import disposition
from jobtide.session import cut
from jobtide.schema import (DONE_KEEP_MS, LOCK_DONE, LOCK_EXPIRE_MS, LOCK_NONE,
                            RETRY_DELAY_MS, RETRY_WINDOW_MS, UNRUN_KEEP_MS)

_FLAGS = ("changed", "removed", "accepted")


def _flag(flagged: DataFrame) -> str:
    return next(f for f in _FLAGS if f in flagged.columns)


def next_table(flagged: DataFrame) -> DataFrame:
    """The table after the change."""
    flag = _flag(flagged)
    kept = {"changed": F.lit(True), "removed": ~F.col("removed"), "accepted": F.col("accepted")}
    return flagged.where(kept[flag]).drop(flag)


def affected(flagged: DataFrame) -> DataFrame:
    """The rows the change touched, removed or refused."""
    flag = _flag(flagged)
    hit = ~F.col("accepted") if flag == "accepted" else F.col(flag)
    return flagged.where(hit).drop(flag)


def _update(jobs: DataFrame, hit: Column, props: dict[str, Column], flag: str = "changed"):
    hit = F.coalesce(hit, F.lit(False))
    return jobs.withColumns({
        **{c: F.when(hit, v).otherwise(F.col(c)) for c, v in props.items()}, flag: hit})


def conditional_update(jobs: DataFrame, where: Column, props: dict[str, Column] | None = None,
                       limit: int | None = None, order: str = "id",
                       remove: bool = False) -> DataFrame:
    """Rows that pass ``where`` get new values, each a column of the old row, or are removed.

    ``limit`` takes the first rows in ``order``; of rows equal in it, the first by all columns.
    """
    hit = F.coalesce(where, F.lit(False))
    flag = "removed" if remove else "changed"
    if limit is None:
        return _update(jobs, hit, props or {}, flag)
    return _limited(jobs, hit, order, limit, lambda rows, taken: _update(rows, taken, props or {}, flag), flag)


def _limited(jobs: DataFrame, hit: Column, order: str, limit: int, update, flag: str) -> DataFrame:
    """``update(rows, taken)`` for the first ``limit`` hits, NULLs first; all other rows pass by, unflagged.

    The ``limit``-th value of the order column is found over slices, so no task sorts ``limit`` rows, and
    the table is then changed in one projection. Only if several rows share that value and not all are taken are
    those rows numbered.
    """
    if limit < 1:
        return update(jobs, F.lit(False))
    found = nth_in_order(jobs.where(hit).select(order), order, limit)
    if found is None:  # fewer hits
        return update(jobs, hit)
    value, before, same = found
    at = F.col(order)
    equal = at.eqNullSafe(F.lit(value).cast(jobs.schema[order].dataType))
    earlier = F.lit(False) if value is None else at.isNull() | F.coalesce(at < F.lit(value), F.lit(False))
    if before + same == limit:
        return update(jobs, hit & (earlier | equal))
    ties = number_rows(jobs.where(hit & equal), [], jobs.columns, "_place")
    taken = update(ties, F.col("_place") <= limit - before).drop("_place")
    return taken.unionByName(update(jobs.where(~(hit & equal)), hit & earlier)).select(*jobs.columns, flag)


def add_jobs(rows: DataFrame, now) -> DataFrame:
    """Rows with id and type are accepted, dt defaulting to ``now``; the flag marks the rest."""
    ok = F.coalesce((F.col("id") != "") & (F.col("type") != ""), F.lit(False))
    return rows.withColumns({"dt": F.coalesce("dt", states.instant(now)), "accepted": ok})


def first_per_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per id, the first in ``order``; copies combine before the shuffle."""
    values = [c for c in rows.columns if c != "id"]
    return (rows.groupBy("id").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_row"))
            .select("id", *[F.col(f"_row.{c}").alias(c) for c in values]))


MOST_DAYS = 10_000  # that a scan is told by name


def unknown_rows(jobs: DataFrame, fresh: DataFrame, day: str | None = None) -> DataFrame:
    """The rows of ``fresh``, a written table with one row an id, whose id the table does not hold yet.

    An id tells when it was made, so the table's side is read only between the least and the greatest
    new id, which the scan's statistics use, and where ``day`` names the table's column of that day, only
    in the folders of the days that the new ids have. The two ids and the distinct days, if no more than
    ``MOST_DAYS``, are read when the plan is built.
    """
    least, most = fresh.agg(F.min("id"), F.max("id")).first()
    if least is None:
        return fresh
    known = jobs.where(F.col("id").between(least, most))
    if day is not None:
        days = [r[0] for r in fresh.select(ids.created_day(F.col("id"))).distinct().limit(MOST_DAYS + 1).collect()]
        if len(days) <= MOST_DAYS:
            here = F.col(day).isin([d for d in days if d is not None])
            known = known.where(here | F.col(day).isNull() if None in days else here)
    return fresh.join(known.select("id"), "id", "left_anti")


def add_jobs_unique(jobs: DataFrame, rows: DataFrame, now, order: list[str], day: str | None = None) -> DataFrame:
    """The table with the new rows added whose id it does not hold yet, see :func:`unknown_rows`.

    Of rows with the same id the first in ``order`` is taken.
    """
    fresh = cut(first_per_id(next_table(add_jobs(rows, now)), order), "fresh")
    columns = [c for c in jobs.columns if c != day]
    return jobs.select(*columns).unionByName(unknown_rows(jobs, fresh, day).select(*columns))


def claim_jobs(jobs: DataFrame, now, lock: str, limit: int, expire_ms: int = LOCK_EXPIRE_MS,
               limits: DataFrame | None = None) -> DataFrame:
    """Locks up to ``limit`` ready jobs of every type, in id order.

    ``limits`` (type, batch_size) sets other limits per type, whatever their size; one below 1
    counts as none. The greatest limit, one row that is read when the plan is built, bounds the
    rank before the shuffle, so each task sends at most that many rows of a type. What goes back to
    the table is one id per type, and only rows that are ready meet it.
    """
    ready = F.coalesce(states.is_ready(F.col("dt"), F.col("lock"), now), F.lit(False))
    ranked = claim_ranks(jobs.where(ready), limit, limits)
    last = cut(ranked.groupBy("type").agg(F.max("id").alias("_last")), "claimed")
    claimed = _update(lookup_join(jobs.where(ready), last, "type", "id"), F.col("id") <= F.col("_last"), {
        "lock": F.lit(lock), "dt": states.plus_ms(states.instant(now), expire_ms)}).drop("_last")
    return claimed.unionByName(jobs.where(~ready).withColumn("changed", F.lit(False)))


def claim_ranks(ready: DataFrame, limit: int, limits: DataFrame | None = None) -> DataFrame:
    """The first jobs of every type by id, up to its limit: (type, id, _n)."""
    top = limit
    if limits is not None:
        limits = cut(limits.select("type", states.batch_limit(F.col("batch_size")).alias("batch_size")), "limits")
        top = max(limit, limits.agg(F.max("batch_size")).first()[0] or 0)
    ranked = ready.select("type", "id").withColumn(
        "_n", F.row_number().over(W.partitionBy("type").orderBy("id"))).where(F.col("_n") <= top)
    if limits is None:
        return ranked
    return (lookup_join(ranked, limits, "type", "id")
            .where(F.col("_n") <= F.coalesce("batch_size", F.lit(limit))))


def locked_jobs(jobs: DataFrame, limit: int, type: str | None = None,
                lock: str | None = None) -> DataFrame:
    """Up to ``limit`` jobs of a type (or any) under a lock (or any but none), in id order."""
    held = ~states.is_unlocked(F.col("lock")) if lock is None else F.col("lock") == lock
    if type is not None:
        held = held & (F.col("type") == type)
    return jobs.where(held).orderBy("id").limit(limit)


def _running(jobs: DataFrame) -> Column:
    """Rows under a daemon's lock; only these can match a holder, so only these are shuffled."""
    return F.coalesce(states.is_running_lock(F.col("lock")), F.lit(False))


def _matched(jobs: DataFrame, side: DataFrame, extra: str) -> DataFrame:
    """Adds ``extra`` from a side with one row per (id, lock); rows not under a running lock stay put."""
    running = _running(jobs)
    kind = side.schema[extra].dataType
    met = jobs.where(running).join(side, ["id", "lock"], "left").select(*jobs.columns, extra)
    return met.unionByName(jobs.where(~running).withColumn(extra, F.lit(None).cast(kind)))


def _with_held(jobs: DataFrame, held: DataFrame) -> DataFrame:
    """Adds ``_held``, true for the jobs among the held ids and still under the holder's lock."""
    return _matched(jobs, held.select("id", "lock", F.lit(True).alias("_held")).distinct(), "_held")


def held_jobs(jobs: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of the table among the held ids and still under the holder's lock."""
    return jobs.where(_running(jobs)).join(held.select("id", "lock"), ["id", "lock"], "left_semi")


def renew_locks(jobs: DataFrame, held: DataFrame, now,
                expire_ms: int = LOCK_EXPIRE_MS) -> DataFrame:
    """Held ids (id, lock) under that lock run on until ``now + expire_ms``."""
    return _update(_with_held(jobs, held), F.col("_held"), {
        "dt": states.plus_ms(states.instant(now), expire_ms)}).drop("_held")


def _released(how: Column, now) -> dict[str, Column]:
    now = states.instant(now)
    return {
        "lock": F.when(how == "archive", LOCK_DONE).otherwise(LOCK_NONE),
        "dt": F.when(how == "archive", states.archive_dt(now))
        .when(how == "retry", states.plus_ms(now, RETRY_DELAY_MS)).otherwise(now),
    }


def release_jobs(jobs: DataFrame, releases: DataFrame, now) -> DataFrame:
    """Lets go of jobs (id, lock, how): ``archive``, ``retry`` after a delay, else run again now."""
    wanted = releases.groupBy("id", "lock").agg(F.min("how").alias("_how"))
    joined = _matched(jobs, wanted, "_how")
    return _update(joined, F.col("_how").isNotNull(), _released(F.col("_how"), now)).drop("_how")


def expire_locks(jobs: DataFrame, now) -> DataFrame:
    """Breaks locks whose time has passed."""
    return _update(jobs, states.is_stale(F.col("dt"), F.col("lock"), now), {
        "lock": F.lit(LOCK_NONE), "dt": states.instant(now)})


def purge_jobs(jobs: DataFrame, cutoff=None, type: str | None = None, lock: str | None = None,
               now=None, older_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Removes jobs of a type and/or lock whose dt is before the cutoff; their data is dropped.

    The cutoff is the instant ``cutoff``, or ``older_ms`` before ``now``. ``limit`` removes the
    first jobs by id only.
    """
    if type is None and lock is None:
        raise ValueError("type or lock required")
    if (cutoff is None) == (older_ms is None):
        raise ValueError("either cutoff, or now and older_ms")
    before = states.instant(cutoff) if older_ms is None else states.plus_ms(states.instant(now), -older_ms)
    hit = F.col("dt") < before
    if lock is not None:
        hit = hit & (F.col("lock") == lock)
    if type is not None:
        hit = hit & (F.col("type") == type)
    gone = {"data": F.lit(None).cast("string")}
    if limit is None:
        return _update(jobs, hit, gone, "removed")
    return _limited(jobs, F.coalesce(hit, F.lit(False)), "id", limit,
                    lambda rows, taken: _update(rows, taken, gone, "removed"), "removed")


def _done_too_long(now, keep_ms: int) -> Column:
    return (F.col("lock") == LOCK_DONE) & (
        states.done_at(F.col("dt")) < states.plus_ms(states.instant(now), -keep_ms))


def purge_done(jobs: DataFrame, now, keep_ms: int = DONE_KEEP_MS) -> DataFrame:
    """Removes archived jobs completed more than ``keep_ms`` ago."""
    # Completion is dt less 1000 years; compare dt itself, so the scan can use its statistics.
    limit = states.archive_dt(states.plus_ms(states.instant(now), -keep_ms))
    return purge_jobs(jobs, limit, lock=LOCK_DONE)


def purge_unrun(jobs: DataFrame, now, keep_ms: int = UNRUN_KEEP_MS) -> DataFrame:
    """Removes jobs that were due more than ``keep_ms`` ago and never ran."""
    return purge_jobs(jobs, states.plus_ms(states.instant(now), -keep_ms), lock=LOCK_NONE)


def apply_outcomes(jobs: DataFrame, runs: DataFrame, now, window_ms: int = RETRY_WINDOW_MS,
                   on_abandon: str = "leave") -> DataFrame:
    """Stopped runs (id, runner, exitcode, stopped, attempt) to the next table.

    A job's last run decides. Abandoned jobs keep their lock until it goes stale (``leave``) or are
    archived (``archive``).
    """
    if on_abandon not in ("leave", "archive"):
        raise ValueError("on_abandon is leave or archive")
    last = runs.groupBy("id", "runner").agg(
        F.max_by("exitcode", F.struct("stopped", "attempt")).alias("exitcode"))
    how = disposition(F.col("exitcode"), F.col("id"), now, window_ms)
    releases = last.select("id", F.col("runner").alias("lock"), how.alias("how"))
    releases = (releases.where("how <> 'abandon'") if on_abandon == "leave" else
                releases.withColumn("how", F.regexp_replace("how", "abandon", "archive")))
    return release_jobs(jobs, releases, now)


def upkeep(jobs: DataFrame, held: DataFrame, now, expire_ms: int = LOCK_EXPIRE_MS,
           done_keep_ms: int = DONE_KEEP_MS, unrun_keep_ms: int = UNRUN_KEEP_MS) -> DataFrame:
    """One housekeeping pass in one projection: renew, break stale locks, purge done and unrun.

    Flags: ``action`` names the step that touched the row, NULL for none.
    """
    at = states.instant(now)
    renew = F.coalesce("_held", F.lit(False))
    stale = ~renew & F.coalesce(states.is_stale(F.col("dt"), F.col("lock"), at), F.lit(False))
    unrun = (states.is_unlocked(F.col("lock"))
             & (F.col("dt") < states.plus_ms(at, -unrun_keep_ms)))
    action = (F.when(renew, "renew").when(stale, "expire")
              .when(_done_too_long(at, done_keep_ms), "purge_done").when(unrun, "purge_unrun"))
    out = _with_held(jobs, held).withColumn("action", action)
    return out.withColumns({
        "dt": F.when(F.col("action") == "renew", states.plus_ms(at, expire_ms))
        .when(F.col("action") == "expire", at).otherwise(F.col("dt")),
        "lock": F.when(F.col("action") == "expire", LOCK_NONE).otherwise(F.col("lock")),
        "data": F.when(~F.coalesce(F.startswith("action", F.lit("purge")), F.lit(False)),
                       F.col("data")),
    }).drop("_held")
