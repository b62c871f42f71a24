"""Plain file reading: lines, whole files, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path) -> DataFrame:
    """path, block_start, ordinal, line. Lines end at \\n; one \\r before it goes. A lone \\r does not end a line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("ordinal"),
        F.regexp_replace("value", r"\r\z", "").alias("line"),
    )


def read_all(spark: SparkSession, path) -> DataFrame:
    """path, length, content: a row for each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_chunk(content: Column, position, n) -> Column:
    """n bytes from a position, fewer at the end."""
    return F.substring(content, F.lit(position) + 1, F.lit(n))


def file_chunks(size, chunk) -> Column:
    """array of struct(start, end): byte ranges of at most `chunk` bytes. Not aligned to records."""
    size, chunk = (x if isinstance(x, Column) else F.lit(x) for x in (size, chunk))
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), chunk), lambda a: F.struct(a.alias("start"), F.least(a + chunk, size).alias("end")))
    return F.when(size > 0, ranges).otherwise(F.slice(ranges, 1, 0))


def with_io_stats(df: DataFrame, column: str, name: str = "io") -> tuple[DataFrame, Observation]:
    """df, and an observation that has its rows and the column's bytes after the first action on it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")), seen
