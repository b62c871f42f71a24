"""Pattern search in very long sequences: pieces with an overlap, so that one row is never one task's whole work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import find_all
from ..schema import by_place


def find_all_long(df: DataFrame, id_col: str, seq_col: str, pattern: str, piece: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """id_col, position: every occurrence. Pieces overlap by len(pattern) - 1, and a hit belongs to the piece it starts in."""
    if not pattern:
        return df.select(id_col, F.lit(0).alias("position")).limit(0)
    s = F.col(seq_col)
    size = F.lit(piece + len(pattern) - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(piece))
    cut = by_place(s, lambda pick: F.transform(starts, lambda i: F.struct(i.alias("start"), pick(i, size).alias("piece"))))
    pieces = df.filter(F.length(s) > 0).select(id_col, F.inline(cut))
    if partitions:
        pieces = pieces.repartition(partitions)
    return pieces.select(id_col, "start", F.explode(find_all("piece", pattern)).alias("at")).select(id_col, (F.col("start") + F.col("at")).alias("position"))
