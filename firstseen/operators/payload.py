"""Fetching payloads: read only what is wanted, move it at most once.

The files of the source that hold no wanted row are left out of the scan. In Parquet
files every row has a number, so the wanted rows of a file are a bitmap, a bit for each row.
The bitmaps go to the scan, which passes exactly the wanted rows, before their payload is
digested or moved. Bitmaps of WAVE_BYTES at most are broadcast at once; a table
that needs more is read in waves, each of its own files, by their hash.

A table without row numbers, or a fetch that must be a single scan and needs several
waves, is thinned by the first bits of the wanted keys, of which there are at most
``2 ** PREFIX_BITS``, so that their broadcast is bounded whatever the data. If few rows
are wanted hardly another row passes; if nearly all are, nothing is lost. An exact join
follows where one is needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distinct prefixes of keys that are broadcast: 2 million integers at most.
PREFIX_BITS = 21

# Bytes of a bitmap: a fixed value of Spark's bitmap functions, for 32,768 rows of a file.
BITMAP_BYTES = 4096
# Bytes of bitmaps that a scan is given at once: bits for half a billion rows.
WAVE_BYTES = 64 << 20

# The row key, the file and the row number of a source row, while its payload is fetched.
KEY, FILE, ROW = "_firstseen_key", "source_file", "source_row"
_FILE, _BUCKET, _BIT, _BITS = "_firstseen_file", "_firstseen_bucket", "_firstseen_bit", "_firstseen_bits"
# Names that a source's own columns must not have.
OWN = (KEY, "_prefix", _FILE, _BUCKET, _BIT, _BITS)


def has_metadata(table: DataFrame, field: str) -> bool:
    """Whether the rows of a table know this of where they are stored."""
    if "_metadata" in table.columns:
        return False
    try:
        table.select(f"_metadata.{field}")
    except AnalysisException:
        return False
    return True


def files_with(table: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """``table`` without the files in which no row is wanted.

    ``rows`` is staged and covers the table. Only if it has ``source_file`` can files be
    told apart. The driver gets one flag per file, of files it lists anyway to plan
    the scan.
    """
    if FILE not in rows.columns:
        return table
    flags = rows.filter(F.col(FILE).isNotNull()).groupBy(FILE).agg(F.bool_or(wanted).alias("keep")).collect()
    skipped = [flag[FILE] for flag in flags if not flag["keep"]]
    kept = [flag[FILE] for flag in flags if flag["keep"]]
    if not skipped:
        return table
    name = F.col("_metadata.file_path")
    return table.filter(name.isin(kept) if len(kept) <= len(skipped) else ~name.isin(skipped))


def _bucket(row: Column) -> Column:
    return F.bitmap_bucket_number(row + 1)


def _wave_of(file: Column, waves: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(waves))


def bitmaps(rows: DataFrame, wanted: Column) -> DataFrame:
    """One bitmap per file and 32,768 rows of it, of the ``wanted`` rows that know their place."""
    placed = rows.filter(wanted & F.col(FILE).isNotNull() & F.col(ROW).isNotNull())
    bit = F.bitmap_bit_position(F.col(ROW) + 1)
    return placed.groupBy(F.col(FILE).alias(_FILE), _bucket(F.col(ROW)).alias(_BUCKET)).agg(F.bitmap_construct_agg(bit).alias(_BITS))


def waves_for(rows: DataFrame, wanted: Column) -> int:
    """Into how many waves of files the bitmaps are cut, so that none has more than WAVE_BYTES
    (or than one file's). The driver sees one number per try."""
    buckets = rows.filter(wanted & F.col(FILE).isNotNull()).select(FILE, _bucket(F.col(ROW)).alias(_BUCKET)).distinct()
    of_file = buckets.groupBy(FILE).count()
    waves = 1
    while True:
        sums = of_file.groupBy(_wave_of(F.col(FILE), waves)).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("files"))
        most = sums.filter("files > 1").agg(F.max("n")).first()[0] or 0
        if most * BITMAP_BYTES <= WAVE_BYTES:
            return waves
        waves *= 2


def picked(table: DataFrame, rows: DataFrame, wanted: Column, wave: int = 0, waves: int = 1) -> DataFrame:
    """The wanted rows of ``table`` and no others, of one wave; ``rows`` is staged."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    maps = bitmaps(rows, wanted)
    if waves > 1:  # a filter on the file alone: the files of other waves are not opened
        table = table.filter(_wave_of(file, waves) == wave)
        maps = maps.filter(_wave_of(F.col(_FILE), waves) == wave)
    placed = table.withColumns({_FILE: file, _BUCKET: _bucket(row), _BIT: F.bitmap_bit_position(row + 1)})
    byte = F.substring(F.col(_BITS), (F.shiftright(F.col(_BIT), 3) + 1).cast("int"), F.lit(1))
    there = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), F.col(_BIT).bitwiseAND(F.lit(7)).cast("int")) == 1
    return placed.join(F.broadcast(maps), [_FILE, _BUCKET]).filter(there).drop(_FILE, _BUCKET, _BIT, _BITS)


def _prefix(key: Column) -> Column:
    """The first bits of a digest, as an integer."""
    return F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint"), 32 - PREFIX_BITS)


def thinned(source: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """Rows of ``source`` that may be wanted: all wanted ones, few others if few are."""
    some = rows.filter(wanted & F.col("path_hash").isNotNull()).select(_prefix(F.col("path_hash")).alias("_prefix"))
    return (
        source.withColumn("_prefix", _prefix(F.col(KEY)))
        .join(F.broadcast(some.distinct()), "_prefix", "left_semi")
        .drop("_prefix")
    )


def exactly(source: DataFrame, rows: DataFrame, wanted: Column, *also: str) -> DataFrame:
    """The wanted rows of ``source``; the keys form a hash table, no payload is sorted.

    Keys are unique, so an inner join gives every row once. Unlike a semi join it is
    not moved below a repartitioning of the rows.
    """
    keys = rows.filter(wanted).select(F.col("path_hash").alias(KEY), *also)
    if also:
        keys = keys.repartition(*also)
    return source.join(keys.hint("shuffle_hash"), [*also, KEY])
