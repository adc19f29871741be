"""Explicit schemas of every table the engine stores or exchanges.

Units: file times are nanoseconds since the epoch, ``copied_time`` is
milliseconds. Digests are 32-byte BINARY inside the engine and lower-case hex
only in reports.
"""

from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("path_bytes", T.BinaryType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("error", T.StringType(), True),
])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("path_bytes", T.BinaryType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("ctime_ns", T.LongType()),
    T.StructField("error", T.StringType()),
])

# What travels through shuffles. Display paths and destinations are pure
# functions of these columns and are derived where they are needed.
CORE = ["path_hash", "path_bytes", "size", "mtime_ns", "ctime_ns", "error"]

CACHE = T.StructType([
    T.StructField("path_hash", T.BinaryType()),
    T.StructField("path_bytes", T.BinaryType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("ctime_ns", T.LongType()),
    T.StructField("content_hash", T.BinaryType()),
])

# A layer of the stored cache: entries, and paths whose entry is ``gone``.
CACHE_LAYER = T.StructType([
    *CACHE.fields,
    T.StructField("gone", T.BooleanType()),
    T.StructField("snapshot", T.LongType()),
])

LEDGER = T.StructType([
    T.StructField("content_hash", T.BinaryType()),
    T.StructField("copied_time", T.LongType()),
    T.StructField("writer", T.StringType()),
    T.StructField("run_id", T.LongType()),
])

NEW, MODIFIED, UNCHANGED = "new", "modified", "unchanged"
COPIED, SKIPPED, FAILED = "copied", "skipped", "failed"
