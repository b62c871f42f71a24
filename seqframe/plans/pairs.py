"""Pairs for alignment, found by an equi-join on shared k-mers instead of a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import by_place


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order (an extension)."""
    n = F.length(s)
    found = by_place(s, lambda pick: F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: pick(i, F.lit(k))))
    return F.when(n >= k, found).when(n.isNotNull(), F.array().cast("array<string>"))


def kmer_counts(df: DataFrame, seq_col: str, k: int) -> DataFrame:
    """kmer, n over a table (an extension); combined before the shuffle."""
    return df.select(F.explode(kmers(F.col(seq_col), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def candidate_pairs(left: DataFrame, right: DataFrame, id_col: str, seq_col: str, k: int = 11, least: int = 2) -> DataFrame:
    """left_id, right_id, shared: pairs that share at least `least` distinct k-mers. AQE splits frequent k-mers."""
    side = lambda df, name: df.select(F.col(id_col).alias(f"{name}_id"), F.explode(F.array_distinct(kmers(F.col(seq_col), k))).alias("kmer"))
    met = side(left, "left").join(side(right, "right"), "kmer")
    return met.groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
