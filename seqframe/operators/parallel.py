"""Mapping closures over rows, chunks and files; Spark's tasks are the threads.

Results keep their input order by an ordinal column, never by the order of completion. The first exception fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import by_place

MIN_CHUNK, CHUNKS_PER_THREAD = 1024, 4


def calculate_chunk_size(total: int, min_size: int = 0, threads: int = 8) -> int:
    """A share of total for CHUNKS_PER_THREAD chunks a thread, at least min_size or 1024, in whole multiples of 1024."""
    size = max(total // max(1, threads * CHUNKS_PER_THREAD), min_size or MIN_CHUNK)
    return -(-size // MIN_CHUNK) * MIN_CHUNK


def map_items(df: DataFrame, fn: Callable, in_col: str, out_col: str, out_type: str) -> DataFrame:
    """fn over each value, in Arrow batches; other columns stay, and so does the order of an ordinal column."""

    @F.pandas_udf(out_type)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fn(x) for x in values])

    return df.withColumn(out_col, run(in_col))


adaptive_map = map_items


def map_chunks(df: DataFrame, fn: Callable[[list], object], chunk_col: str, value_col: str, order_col: str, out_type: str) -> DataFrame:
    """fn over each chunk's values in order: chunk_col, result. A chunk is one task's memory, so chunks are to be bounded."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({chunk_col: [key[0]], "result": [fn(pdf.sort_values(order_col)[value_col].tolist())]})

    kind = df.schema[chunk_col].dataType.simpleString()
    return df.groupBy(chunk_col).applyInPandas(run, f"{chunk_col} {kind}, result {out_type}")


def for_each(df: DataFrame, fn: Callable, column: str) -> float:
    """Side effects on every value; the share that is done (1.0 on return, also for an empty table)."""

    def run(rows: Iterator) -> None:
        for row in rows:
            fn(row[column])

    df.select(column).foreachPartition(run)
    return 1.0


def progress(spark: SparkSession) -> float:
    """The share of the tasks of active stages that is done; 1.0 when nothing runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    total = sum(s.numTasks for s in stages)
    return sum(s.numCompletedTasks for s in stages) / total if total else 1.0


def chunk_slice(s: Column, size: int) -> Column:
    """Consecutive pieces of `size` characters, the last one shorter; none of an empty string."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(by_place(s, lambda pick: F.transform(starts, lambda i: pick(i, F.lit(size)))))


def split_join(df: DataFrame, id_col: str, split: Column, process: Callable[[Column], Column], join: Callable[[Column], Column]) -> DataFrame:
    """Each row's array of parts is exploded, processed in parallel and joined again in order: id_col, result."""
    parts = df.select(id_col, F.posexplode(split).alias("pos", "part")).withColumn("part", process(F.col("part")))
    joined = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return joined.select(id_col, join(F.transform("parts", lambda p: p["part"])).alias("result"))


def process_file(spark: SparkSession, path, fn: Callable[[bytes], object], out_type: str, min_chunk: int = 1 << 20, threads: int = 8) -> DataFrame:
    """fn over byte ranges of files (not aligned to records): path, start, result. A file is cut once; it is one row, of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    share = F.greatest(F.ceil(F.col("length") / (threads * CHUNKS_PER_THREAD)), F.lit(min_chunk))
    size = (F.ceil(share / MIN_CHUNK) * MIN_CHUNK).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.col("length").cast("int") - 1, F.lit(0)), F.col("size"))
    cut = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.substring("content", i + 1, F.col("size")).alias("chunk")))
    chunks = files.select("path", "content", "length", size.alias("size")).select("path", F.inline(cut))

    @F.pandas_udf(out_type)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fn(bytes(x)) for x in values])

    return chunks.select("path", "start", run("chunk").alias("result"))
