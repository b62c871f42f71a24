"""Schemas of sequence tables, the error type and the two error modes.

mode "strict": an invalid value raises when the row is computed; the check is part of the value's own expression, so it cannot be
pruned away. mode "null": an invalid value is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQ_SCHEMA = "id string, description string, seq string, alphabet string"
RECORD_SCHEMA = "path string, block_start bigint, ordinal bigint, id string, description string, seq string, quality string, metadata map<string,string>"
ALIGN_STRUCT = "seq1_aligned string, seq2_aligned string, score int, seq1_start int, seq1_end int, seq2_start int, seq2_end int, identity double"
BASES_STRUCT = "a int, c int, g int, t int, other int"
PACKED_STRUCT = "data binary, len int"
MODES = ("strict", "null")


class SequenceError(Exception):
    """Any failure of a sequence operation, as the object interface reports it."""


def col(value: Column | str) -> Column:
    """A name is a column; a Column is itself."""
    return F.col(value) if isinstance(value, str) else value


def by_place(s: Column, body) -> Column:
    """body(pick), where pick(i, m) is the text of m characters from place i on.

    In ASCII text, which all sequences are, a place is found at once: the bytes are bound to one variable and sliced. In
    other text each pick walks the string from its start.
    """
    fast = F.transform(F.array(s.cast("binary")), lambda b: body(lambda i, m: F.substring(b, i + 1, m).cast("string")))[0]
    return F.when(F.octet_length(s) == F.length(s), fast).otherwise(body(lambda i, m: F.substring(s, i + 1, m)))


def guarded(valid: Column, value: Column, message: str, mode: str) -> Column:
    """value where valid; elsewhere an error or NULL. A NULL input gives NULL in both modes."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "null":
        return F.when(valid, value)
    return F.when(valid, value).when(valid.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(message)))
