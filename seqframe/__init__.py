"""seqframe: sequence analytics on Spark DataFrames."""

from .schema import SequenceError

__all__ = ["SequenceError"]
