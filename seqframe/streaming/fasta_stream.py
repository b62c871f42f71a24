"""Sequence columns on streams. Every column function works unchanged on a stream; this adds a source and a windowed summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import count_bases
from ..sources.fasta import parse_fasta


def stream_fasta(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """id, description, seq of FASTA files as they arrive; a file is read whole, as one batch's row."""
    files = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    return files.select(F.inline(parse_fasta("value")))


def windowed_bases(stream: DataFrame, ts_col: str, seq_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Base counts by event-time window; rows later than `late` are dropped, so state stays bounded."""
    counts = count_bases(seq_col)
    parts = stream.withWatermark(ts_col, late).select(ts_col, counts.alias("n"))
    return parts.groupBy(F.window(ts_col, window)).agg(*(F.sum(f"n.{c}").alias(c) for c in ("a", "c", "g", "t", "other")))
