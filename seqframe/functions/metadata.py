"""What each unary operator does to a row's id, description and alphabet.

An id is kept. A description, only where there is one, gets a suffix (concat is NULL for a NULL description).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence as S

# The suffixes.
SUFFIXES = {"reverse": " (reversed)", "complement": " (complement)", "reverse_complement": " (reverse complement)", "transcribe": " (transcribed)", "mask": " (masked)"}


def suffixed(suffix: str | Column) -> Column:
    return F.concat("description", suffix if isinstance(suffix, Column) else F.lit(suffix))


def with_id(df: DataFrame, value) -> DataFrame:
    return df.withColumn("id", value if isinstance(value, Column) else F.lit(value))


def with_description(df: DataFrame, value) -> DataFrame:
    return df.withColumn("description", value if isinstance(value, Column) else F.lit(value))


def _apply(df: DataFrame, seq: Column, suffix, **more: Column) -> DataFrame:
    return df.withColumns({"seq": seq, "description": suffixed(suffix)} | more)


def subsequence(df: DataFrame, start: int, end: int, mode: str = "strict") -> DataFrame:
    return _apply(df, S.subsequence("seq", start, end, mode), f" (subsequence {start}..{end})")


def view(df: DataFrame, start: int, end: int, mode: str = "strict") -> DataFrame:
    return _apply(df, S.subsequence("seq", start, end, mode), f" (view {start}..{end})")


def reverse(df: DataFrame) -> DataFrame:
    return _apply(df, S.reverse("seq"), SUFFIXES["reverse"])


def complement(df: DataFrame, mode: str = "strict") -> DataFrame:
    return _apply(df, S.complement("seq", "alphabet", mode), SUFFIXES["complement"])


def reverse_complement(df: DataFrame, mode: str = "strict") -> DataFrame:
    return _apply(df, S.reverse_complement("seq", "alphabet", mode), SUFFIXES["reverse_complement"])


def transcribe(df: DataFrame, mode: str = "strict") -> DataFrame:
    return _apply(df, S.transcribe("seq", "alphabet", mode), SUFFIXES["transcribe"], alphabet=F.lit(S.RNA))


def mask(df: DataFrame, positions, mask_char: str = "N", mode: str = "strict") -> DataFrame:
    return _apply(df, S.mask("seq", positions, mask_char, mode), SUFFIXES["mask"])


def to_packed_storage(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Checks that sequences are DNA; text and metadata stay."""
    return df.withColumn("seq", S.as_dna("seq", mode))


def concatenated(id1: Column, id2: Column, d1: Column, d2: Column) -> tuple[Column, Column]:
    """id and description of two sequences put together."""
    named = lambda d: F.coalesce(d, F.lit("[unnamed]"))
    return F.coalesce(id1, id2), F.when(d1.isNotNull() | d2.isNotNull(), F.concat(named(d1), F.lit(" + "), named(d2)))


def sequences(df: DataFrame, text: Column, id_: Column | None = None, description: Column | None = None, mode: str = "strict") -> DataFrame:
    """A table of sequences from any table: id, description, seq, alphabet."""
    none = F.lit(None).cast("string")
    out = df.select((none if id_ is None else id_.cast("string")).alias("id"), (none if description is None else description).alias("description"), text.alias("seq"))
    return out.withColumn("seq", S.as_sequence("seq", mode)).withColumn("alphabet", S.detect_alphabet("seq"))
