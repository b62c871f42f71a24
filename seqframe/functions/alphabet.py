"""Alphabets: detection, validation, sanitising and complements, as column expressions.

Detection tries DNA, RNA, protein in this order, so an empty sequence and one of A, C, G, N only is DNA. Case is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import col, guarded

DNA, RNA, PROTEIN = "DNA", "RNA", "Protein"
# The characters of each alphabet, both cases.
CHARS = {DNA: "ACGTNacgtn", RNA: "ACGUNacgun", PROTEIN: "ACDEFGHIKLMNPQRSTVWYXacdefghiklmnpqrstvwyx*"}
# Complements, case kept; N is its own.
COMPLEMENTS = {DNA: ("ACGTacgt", "TGCAtgca"), RNA: ("ACGUacgu", "UGCAugca")}


def valid_chars(alphabet: str) -> str:
    return CHARS[alphabet]


def size(alphabet: str) -> int:
    return len(CHARS[alphabet])


def count_of(s: Column, chars: str) -> Column:
    """How many characters of s are among chars."""
    return F.length(s) - F.length(F.translate(s, chars, ""))


def is_valid(s: Column | str, alphabet: str) -> Column:
    """A predicate: every character is of the alphabet. The empty sequence is valid."""
    return F.translate(col(s), CHARS[alphabet], "") == ""


def is_valid_char(c: Column | str, alphabet: str) -> Column:
    return (F.length(col(c)) == 1) & is_valid(c, alphabet)


def detect_alphabet(s: Column | str) -> Column:
    """DNA, RNA, Protein, or NULL where none fits."""
    s = col(s)
    return F.when(is_valid(s, DNA), DNA).when(is_valid(s, RNA), RNA).when(is_valid(s, PROTEIN), PROTEIN)


def sanitize(s: Column | str, alphabet: str = DNA, replacement: str = "N") -> Column:
    """Each invalid character is replaced; the length stays."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(s), f"[^{CHARS[alphabet]}]", safe)


def complement_sequence(s: Column | str, alphabet: str = DNA) -> Column:
    """NULL for any invalid character, and always for protein (but for the empty sequence)."""
    s = col(s)
    if alphabet not in COMPLEMENTS:
        return F.when(s == "", "")
    return F.when(is_valid(s, alphabet), F.translate(s, *COMPLEMENTS[alphabet]))


def dna_to_rna(s: Column | str) -> Column:
    return F.translate(col(s), "Tt", "Uu")


def rna_to_dna(s: Column | str) -> Column:
    return F.translate(col(s), "Uu", "Tt")


def require_alphabet(s: Column | str, alphabet: str, mode: str = "strict") -> Column:
    s = col(s)
    return guarded(is_valid(s, alphabet), s, f"invalid {alphabet} sequence", mode)
