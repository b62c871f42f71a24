"""Packed encodings: two bits a base, four bits a residue. Both lose what they have no code for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import by_place, col

# Code order; all other residues share the last code, which reads as X.
BASES, RESIDUES = "ACGT", "ARNDCQEGHILKMFP"
_CODES = np.zeros(256, np.uint8)
for _i, _c in enumerate(BASES):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i
_CODES[ord("U")] = _CODES[ord("u")] = 3
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)


def pack_dna_bytes(seq: str) -> bytes:
    """First base in the two high bits; unknown characters are A; the last byte is filled with zeros."""
    codes = _CODES[np.frombuffer(seq.encode(), np.uint8)]
    codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (codes << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def unpack_dna_bytes(data: bytes, n: int) -> str:
    raw = np.frombuffer(data, np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return _LETTERS[raw.ravel()[:n]].tobytes().decode()


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("len", T.IntegerType())]))
def _pack_dna(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"data": [None if x is None else pack_dna_bytes(x) for x in s], "len": [0 if x is None else len(x) for x in s]})


@F.pandas_udf(T.StringType())
def _unpack_dna(packed: pd.DataFrame) -> pd.Series:
    return pd.Series([None if d is None else unpack_dna_bytes(bytes(d), int(n)) for d, n in zip(packed["data"], packed["len"], strict=True)])


def pack_dna(s: Column | str) -> Column:
    """struct(data, len); for long sequences, in Arrow batches."""
    return F.when(col(s).isNotNull(), _pack_dna(col(s)))


def unpack_dna(packed: Column | str) -> Column:
    return _unpack_dna(col(packed))


def pack_dna_expr(s: Column | str) -> Column:
    """The same without a Python worker: best for short sequences."""
    s = col(s)
    digits = F.translate(F.upper(s), "ACGTU", "01233")
    digits = F.regexp_replace(digits, "[^0-3]", "0")
    n = F.ceil(F.length(s) / 4).cast("int")
    padded = F.rpad(digits, 4 * n, "0")
    one = lambda pick: lambda b: F.lpad(F.conv(pick(4 * b, F.lit(4)), 4, 16), 2, "0")  # noqa: E731  # four bases are a number in base 4
    hexed = by_place(padded, lambda pick: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one(pick)), ""))
    data = F.when(n == 0, F.unhex(F.lit(""))).otherwise(F.unhex(hexed))
    return F.struct(data.alias("data"), F.length(s).alias("len"))


def pack_protein(s: Column | str) -> Column:
    """First residue in the high half; an odd last byte is filled with zero."""
    s = col(s)
    digits = F.translate(F.upper(s), RESIDUES + "STWYVX*", "0123456789ABCDE" + "F" * 7)
    n = F.length(s)
    return F.struct(F.unhex(F.when(n % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)).alias("data"), n.alias("len"))


def unpack_protein(packed: Column | str) -> Column:
    p = col(packed)
    return F.translate(F.substring(F.hex(p["data"]), F.lit(1), p["len"]), "0123456789ABCDEF", RESIDUES + "X")


def memory_usage(packed: Column | str) -> Column:
    return F.octet_length(col(packed)["data"])
