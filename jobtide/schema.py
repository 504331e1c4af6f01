"""Schemas and reserved values of the job model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the job model.
LOCK_NONE = ""
LOCK_DONE = "__done"
LOCK_HANDLER = "__handler"
TYPE_LEASE = "queue.sysid"
HANDLER_DT = "3000-01-01 00:00:00"
HANDLER_DROP_BEFORE = "3099-01-01 00:00:00"
ARCHIVE_YEARS = 1000

# Fixed intervals, in milliseconds.
LOCK_EXPIRE_MS = 300_000
RETRY_DELAY_MS = 300_000
RETRY_WINDOW_MS = 6 * 3_600_000
DONE_KEEP_MS = 14 * 86_400_000
UNRUN_KEEP_MS = 30 * 86_400_000
LEASE_MS = 30 * 60_000
LEASE_DEGRADED_MS = 60_000

# Fixed codes written for runs that gave no usable exit code.
CODE_BAD_HANDLER = "BAD_HANDLER"
CODE_NO_RESPONSE = "NO_RESPONSE"
CODE_INVALID_RESPONSE = "INVALID_RESPONSE"
CODE_BATCH_ERROR = "BATCH_ERROR"
EXIT_ERROR = 500

# Jobs taken per run when the handler of the type names no batch size.
DEFAULT_BATCH_SIZE = 10
STOPPED_BATCH_SIZE = 200

JOB = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("dt", T.TimestampType()),
    T.StructField("lock", T.StringType()),
    T.StructField("data", T.StringType()),
])

HANDLER_FIELDS = ["eid", "lang", "body", "before", "beforeEach", "afterEach", "options"]

HANDLER = T.StructType([
    T.StructField("eid", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("beforeEach", T.StringType()),
    T.StructField("afterEach", T.StringType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
])

LOG_LINE = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("info", T.StringType()),
])
