"""Job-queue tables derived from the given analytic tables.

Every builder is a chain of projections and joins over whole tables, so a feed grows with its
table. Builders that take ``events`` accept a batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from jobtide.functions import ids, states, text
from jobtide.operators.outcomes import scoreboard
from jobtide.schema import LOCK_DONE, LOCK_NONE, TYPE_LEASE

AS_OF = "2024-01-16 00:00:00"
AS_OF_MS = 1705363200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _instants(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, so that the table may be one file or a folder of files.
    return _instants(spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet"))


def _instants(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def jobs_from(events: DataFrame, *keep: str) -> DataFrame:
    """The jobs table: one job per event, in every state of the model."""
    kind = F.col("event_id") % 10
    owner = F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string"))
    return events.select(
        ids.make_id(F.unix_millis("ts"),
                    F.concat(F.lit("q"), (F.col("user_id") % 4).cast("string")),
                    F.col("event_id") % ids.SEQ_LIMIT).alias("id"),
        F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string"), F.lit("-"),
                 F.col("event_type")).alias("type"),
        F.when(kind == 4, F.col("ts") + F.expr("INTERVAL 10 DAYS"))
        .when(kind.isin(5, 6), F.col("ts") + F.expr("INTERVAL 5 DAYS"))
        .when(kind.isin(7, 8), F.col("ts") + F.expr("INTERVAL 1000 YEARS"))
        .otherwise(F.col("ts")).alias("dt"),
        F.when(kind <= 4, LOCK_NONE).when(kind.isin(7, 8), LOCK_DONE)
        .otherwise(owner).alias("lock"),
        F.col("props").alias("data"),
        *keep)


def jobs(spark, sf_dir, *keep):
    return jobs_from(table(spark, sf_dir, "events"), *keep)


def journal_from(events: DataFrame) -> DataFrame:
    """Journal lines (``line``): blank ones, malformed ones and re-delivered ones included."""
    j = jobs_from(events, "event_id")
    e = F.col("event_id")
    full = F.concat_ws("|", "id", "type", "data")
    line = F.when(e % 101 == 0, "").when(e % 97 == 0, F.col("data")).otherwise(full)
    copies = F.when(e % 50 == 0, F.array(line, full)).otherwise(F.array(line))
    return j.select(F.explode(copies).alias("line"))


def journal(spark, sf_dir):
    return journal_from(table(spark, sf_dir, "events"))


def arrivals_from(events: DataFrame) -> DataFrame:
    """Journal lines as above and, for every seventh event, a line of a job that the table does not hold, some twice."""
    j = jobs_from(events, "event_id").where(F.col("event_id") % 7 == 3)
    line = F.concat_ws("|", F.regexp_replace("id", "-q", "-x"), "type", "data")
    copies = F.when(F.col("event_id") % 2 == 0, F.array(line, line)).otherwise(F.array(line))
    return journal_from(events).unionByName(j.select(F.explode(copies).alias("line")))


def arrivals(spark, sf_dir):
    return arrivals_from(table(spark, sf_dir, "events"))


def runs_from(events: DataFrame) -> DataFrame:
    """Finished runs of claimed jobs, one to three attempts each."""
    e = F.col("event_id")
    return (
        jobs_from(events, "event_id", "user_id", "value", "ts").where(F.col("lock") != LOCK_NONE)
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), (1 + e % 3).cast("int"))))
        .select(
            "id", "type", "event_id", "attempt",
            F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("runner"),
            (100 * (1 + (e + F.col("attempt")) % 5) + F.floor("value") % 20)
            .cast("int").alias("exitcode"),
            (F.col("ts") + F.make_dt_interval(mins=F.col("attempt"))).alias("started"),
            F.floor(F.col("value") * 10).cast("long").alias("run_ms"))
        .withColumn("stopped",
                    F.timestamp_micros(F.unix_micros("started") + F.col("run_ms") * 1000)))


def runs(spark, sf_dir):
    return runs_from(table(spark, sf_dir, "events"))


def handlers(spark, sf_dir):
    """Handler versions, a part each; some lack a body or a size, or have size 0, some types have no handler."""
    p = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), F.lpad(p.cast("string"), 8, "0")).alias("id"),
        F.concat(F.lit("c"), (p % 8).cast("string"), F.lit("-"),
                 F.element_at(kinds, (p % 5 + 1).cast("int"))).alias("type"),
        F.col("p_brand").alias("eid"),
        F.lower(F.substring_index("p_type", " ", 1)).alias("lang"),
        F.when(p % 13 != 0, F.col("p_name")).alias("body"),
        F.when(p % 17 == 0, 0).when(p % 19 != 0, F.col("p_size")).cast("int").alias("batch_size"))


def start_stop_from(runs_df: DataFrame) -> DataFrame:
    """Start (+1) and stop (-1) events; some stops arrive twice."""
    def ev(at, kind, d):
        return F.struct(at.alias("ev_at"), F.lit(kind).alias("kind"), F.lit(d).alias("d"))

    base = F.array(ev(F.col("started"), 1, 1), ev(F.col("stopped"), 0, -1))
    again = F.array(ev(F.col("stopped") + F.expr("INTERVAL 1 SECOND"), 0, -1))
    twice = (F.col("event_id") % 40 == 5) & (F.col("attempt") == 1)
    return runs_df.select(
        "type", "id", "attempt",
        F.explode(F.when(twice, F.concat(base, again)).otherwise(base)).alias("e"),
    ).select("type", "id", "attempt", "e.*")


def start_stop(spark, sf_dir):
    return start_stop_from(runs(spark, sf_dir))


def call_jobs(spark, sf_dir):
    """First attempts as jobs of calls: (batch, pos, id, type, ...); at most 20 jobs per batch."""
    return (runs(spark, sf_dir).where("attempt = 1")
            .withColumn("batch", F.floor(F.col("event_id") / 20).cast("long"))
            .withColumn("pos", F.row_number().over(W.partitionBy("batch").orderBy("id")) - 1))


def call_outputs(spark, sf_dir):
    """Output text of each call (batch, output), built from at most 20 chunks."""
    e = F.col("event_id")
    response = F.when((F.col("batch") % 9 != 0) | (F.col("pos") < 5),
                      F.when(e % 83 == 0, "oops").when(e % 89 == 0, "99999999999999999999 x")
                      .otherwise(F.concat_ws(" ", F.col("exitcode").cast("string"), "id")))
    note = F.when(e % 7 == 0, "# note")
    new_job = F.when(e % 11 == 0, F.concat(F.lit("#J: "), "type", F.lit("|{}")))
    chunks = call_jobs(spark, sf_dir).select(
        "batch", F.struct("pos", F.concat_ws("\n", response, note, new_job).alias("chunk")).alias("c"))
    return (chunks.where("c.chunk <> ''").groupBy("batch")
            .agg(F.array_sort(F.collect_list("c")).alias("cs"))
            .select("batch", F.array_join(F.col("cs.chunk"), "\n").alias("output")))


def calls(spark, sf_dir):
    """One row per call: start, stop, whether it ran its jobs in one request, failure code, status."""
    b = F.col("batch")
    return (call_jobs(spark, sf_dir).groupBy("batch")
            .agg(F.min("started").alias("started"), F.max("stopped").alias("stopped"))
            .withColumn("is_batch", b % 4 != 0)
            .withColumn("failed", b % 13 == 0)
            .withColumn("error_code", F.when(b % 26 == 0, "ECONNRESET"))
            .withColumn("status", F.when(b % 4 == 0, (b % 5 + 1) * 100 + 4).cast("int")))


def bodies(spark, sf_dir):
    """Posted bodies: one job per non-empty line that is no comment."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("-", "lang", "source").alias("jobtype"), F.col("text").alias("body"))


# Level names of the log feed and the number each is printed with.
LOG_LEVELS = {"error": ("ERROR", 3), "signup": ("WARN", 4), "click": ("INFO", 6),
              "view": ("DEBUG", 7), "purchase": ("TRACE", 8)}


def log_lines(spark, sf_dir):
    """JSON log lines (``line``), one per event; ``info`` is the event's properties.

    Some have a level without a rank, some are cut off.
    """
    names = F.create_map(*[F.lit(x) for k, (n, _) in LOG_LEVELS.items() for x in (k, n)])
    nums = F.create_map(*[F.lit(x) for k, (_, v) in LOG_LEVELS.items() for x in (k, v)])
    j = jobs(spark, sf_dir, "event_type", "event_id", "user_id", "ts")
    odd, cut_off = F.col("event_id") % 61 == 0, F.col("event_id") % 67 == 0
    return j.select(F.when(cut_off, F.concat(F.lit('{"time":'), "id")).otherwise(F.concat(
        F.lit('{"time":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit('","type":"'), F.when(odd, "NOTICE").otherwise(names[F.col("event_type")]),
        F.lit('","level":'), nums[F.col("event_type")].cast("string"),
        F.lit(',"id":"user'), F.col("user_id").cast("string"),
        F.lit('","message":"job '), "id", F.lit(' of type '), "type",
        F.lit('","info":'), "data", F.lit("}"))).alias("line"))


def leases(spark, sf_dir):
    """System-id leases: the four daemons and every user's agent, renewed at their last event."""
    ev = table(spark, sf_dir, "events").where(F.col("ts") <= F.to_timestamp(F.lit(AS_OF)))
    owners = F.array(F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return (ev.select(F.explode(owners).alias("id"), "ts").groupBy("id")
            .agg((F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("dt"))
            .select("id", F.lit(TYPE_LEASE).alias("type"), "dt", F.col("id").alias("lock"),
                    F.lit(None).cast("string").alias("data")))


def schedules(spark, sf_dir):
    """One schedule per part, a fifth yet to start; interval texts in all accepted forms, bad and huge ones."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    form = p % 8
    return table(spark, sf_dir, "part").select(
        p.alias("schedule_id"),
        F.when(form == 0, F.concat(size, F.lit("s")))
        .when(form == 1, F.concat(size, F.lit("m")))
        .when(form == 2, F.concat(size, F.lit(" h")))
        .when(form == 3, F.concat(F.lit(" "), size, F.lit("d")))
        .when(form == 4, F.concat(size, F.lit("w ")))
        .when(form == 5, F.concat(size, F.lit("000")))
        .when(form == 6, F.concat(F.lit("."), size, F.lit("m")))
        .when(p % 16 == 7, F.concat(F.lit("every "), size))
        .otherwise(F.concat(F.lit("99999999999999999999"), size, F.lit("w"))).alias("interval"),
        (F.lit(AS_OF_MS) - F.when(p % 5 == 0, -p).otherwise(p) * 997).alias("start_ms"))


def lock_events_from(events: DataFrame) -> DataFrame:
    """Claim, renewals and mostly a stop for each job that some daemon holds; some are claimed again soon."""
    e = F.col("event_id")
    held = jobs_from(events, "event_id", "ts").where(states.is_running_lock(F.col("lock")))
    claimed = F.col("ts") + F.expr("INTERVAL 1 MINUTE")
    renews = (e % 4).cast("int")

    def ev(kind, k):
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"))

    steps = F.transform(F.sequence(F.lit(0), renews), lambda k: F.struct(
        F.when(k == 0, "claim").otherwise("renew").alias("kind"), (k * 200).alias("k")))
    stop = F.array(ev("stop", renews * 200 + 100))
    again = F.array(ev("claim", renews * 200 + 160))
    return held.select(
        "id", "lock", "type",
        F.explode(F.when(e % 9 == 1, F.concat(steps, stop, again)).when(e % 3 != 0, F.concat(steps, stop))
                  .otherwise(steps)).alias("s"),
        claimed.alias("claimed"),
    ).select("id", "lock", "type", F.col("s.kind").alias("kind"),
             (F.col("claimed") + F.make_dt_interval(secs=F.col("s.k"))).alias("ev_at"))


def unfinished(spark, sf_dir):
    """Runs' jobs that the runners still hold: last exit code neither 2xx nor 4xx."""
    board = scoreboard(runs(spark, sf_dir), extra=["runner"])
    return board.where(~states.is_final(F.col("exitcode"))).select("id", F.col("runner").alias("lock"))


def journal_rows(spark, sf_dir):
    """Journal lines as job rows to add; unparsable ones give rows without id and type."""
    ok = text.is_journal_line(F.col("line"))
    return journal(spark, sf_dir).select(
        F.when(ok, text.strip_leading(text.line_id(F.col("line")))).alias("id"),
        F.when(ok, text.line_type(F.col("line"))).alias("type"),
        F.lit(None).cast("timestamp").alias("dt"), F.lit(LOCK_NONE).alias("lock"),
        F.when(ok, text.line_payload(F.col("line"))).otherwise(F.col("line")).alias("data"))
