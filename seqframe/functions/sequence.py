"""Operators on one sequence, as column expressions: no Python worker, no shuffle.

Positions are 0-based and half-open. An `alphabet` argument is a column with DNA, RNA or Protein, or None to detect it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import by_place, col, guarded
from .alphabet import COMPLEMENTS, DNA, PROTEIN, RNA, count_of, detect_alphabet, is_valid, require_alphabet


def _alphabet(s: Column, alphabet: Column | str | None) -> Column:
    if alphabet is None:
        return detect_alphabet(s)
    return F.lit(alphabet) if isinstance(alphabet, str) and alphabet in (DNA, RNA, PROTEIN) else col(alphabet)


# Constructors

def as_sequence(s: Column | str, mode: str = "strict") -> Column:
    """The text if an alphabet fits it."""
    s = col(s)
    return guarded(detect_alphabet(s).isNotNull() | s.isNull(), s, "invalid sequence: no alphabet fits", mode)


def as_dna(s: Column | str, mode: str = "strict") -> Column:
    return require_alphabet(s, DNA, mode)


def as_rna(s: Column | str, mode: str = "strict") -> Column:
    return require_alphabet(s, RNA, mode)


def as_protein(s: Column | str, mode: str = "strict") -> Column:
    return require_alphabet(s, PROTEIN, mode)


def alphabet_or_dna(s: Column | str) -> Column:
    """The alphabet of unchecked text: DNA where none fits."""
    return F.coalesce(detect_alphabet(s), F.lit(DNA))


# Length, slices, views

def length(s: Column | str) -> Column:
    return F.length(col(s))


def is_empty(s: Column | str) -> Column:
    return col(s) == ""


def to_bytes(s: Column | str) -> Column:
    return col(s).cast("binary")


def subsequence(s: Column | str, start, end, mode: str = "strict") -> Column:
    s, start, end = col(s), _int(start), _int(end)
    return guarded((start >= 0) & (start <= end) & (end <= F.length(s)), F.substring(s, start + 1, end - start), "index out of bounds", mode)


def subsequence_clamped(s: Column | str, start, end) -> Column:
    """As records do it: both ends are cut to the length."""
    s = col(s)
    end = F.least(_int(end), F.length(s))
    start = F.least(_int(start), end)
    return F.substring(s, start + 1, end - start)


def char_at(s: Column | str, i, mode: str = "strict") -> Column:
    """One character; a negative index counts from the end."""
    s, i, n = col(s), _int(i), F.length(col(s))
    return guarded((i >= -n) & (i < n), F.substring(s, F.when(i < 0, n + i).otherwise(i) + 1, F.lit(1)), "index out of range", mode)


def seq_slice(s: Column | str, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """s[start:stop:step] with Python's rules; an empty range gives the empty sequence."""
    s, n, step = col(s), F.length(col(s)), 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def bound(value: int | None, default: Column) -> Column:
        if value is None:
            return default
        return F.greatest(n + value, low) if value < 0 else F.least(F.lit(value), high)

    a, b = bound(start, low if step > 0 else high), bound(stop, high if step > 0 else low)
    if step == 1:
        return F.when(a < b, F.substring(s, a + 1, b - a)).when(s.isNotNull(), "")
    some = a < b if step > 0 else a > b
    places = F.sequence(a, F.when(some, b - (1 if step > 0 else -1)).otherwise(a), F.when(some, F.lit(step)).otherwise(F.lit(1)))
    return F.when(some, by_place(s, lambda pick: F.array_join(F.transform(places, lambda i: pick(i, F.lit(1))), ""))).when(s.isNotNull(), "")


def view_slide(start, end, size, offset, mode: str = "strict") -> Column:
    """struct(start, end) of a window moved by offset: the length stays, a start under 0 becomes 0."""
    start, end, size, offset = (_int(x) for x in (start, end, size, offset))
    new = F.greatest(start + offset, F.lit(0))
    moved = F.struct(new.alias("start"), (new + end - start).alias("end"))
    return guarded(new + end - start <= size, moved, "index out of bounds", mode)


def view_resize(start, size, new_length, mode: str = "strict") -> Column:
    start, size, new_length = (_int(x) for x in (start, size, new_length))
    return guarded(start + new_length <= size, F.struct(start.alias("start"), (start + new_length).alias("end")), "index out of bounds", mode)


def view_find_all(s: Column | str, start, end, pattern) -> Column:
    """Positions within the view."""
    return find_all(subsequence(s, start, end), pattern)


# Composition

def base_composition(s: Column | str) -> Column:
    """map of each character that occurs to its count; case matters."""
    s = col(s)
    one = lambda c: F.struct(c, (F.length(s) - F.length(F.replace(s, c, F.lit("")))).alias("n"))
    return F.map_from_entries(F.transform(F.filter(F.array_distinct(F.split(s, "")), lambda c: c != ""), one))


def gc_content(s: Column | str, alphabet=None, mode: str = "strict") -> Column:
    """Percent of G and C among all characters, N too; 0.0 for the empty sequence. DNA and RNA only."""
    s = col(s)
    value = F.when(F.length(s) == 0, F.lit(0.0)).otherwise(count_of(s, "GCgc") / F.when(F.length(s) == 0, 1).otherwise(F.length(s)) * F.lit(100.0))
    return guarded(s.isNull() | F.coalesce(_alphabet(s, alphabet).isin(DNA, RNA), F.lit(False)), value, "GC content is defined for DNA and RNA", mode)


def gc_content_called(s: Column | str) -> Column:
    """Percent of G and C among A, C, G, T and U; 0.0 if there are none. Any alphabet."""
    s = col(s)
    called = count_of(s, "ACGTUacgtu")
    return F.when(called == 0, F.lit(0.0)).otherwise(count_of(s, "GCgc") / F.when(called == 0, 1).otherwise(called) * F.lit(100.0))


def count_bases(s: Column | str) -> Column:
    """struct(a, c, g, t, other); case does not matter, U counts as T."""
    s = col(s)
    counts = [count_of(s, x) for x in ("Aa", "Cc", "Gg", "TtUu")]
    return F.struct(*(c.alias(n) for c, n in zip(counts, "acgt", strict=True)), (F.length(s) - sum(counts[1:], counts[0])).alias("other"))


def count_byte(s: Column | str, c: str) -> Column:
    return count_of(col(s), c)


def find_byte(s: Column | str, c: str) -> Column:
    """The first position, or NULL."""
    at = F.instr(col(s), c)
    return F.when(at > 0, at - 1)


def equal(a: Column | str, b: Column | str) -> Column:
    return col(a) == col(b)


#: Average residue masses in daltons; X counts as an average residue.
RESIDUE_MASSES = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326, "X": 110.0,
}
WATER = 18.015


def molecular_weight(s: Column | str, mode: str = "strict") -> Column:
    """Sum of residue masses and one water; * weighs nothing; the empty protein 0.0. Defined here."""
    s = col(s)
    mass = F.lit(WATER)
    for residue, weight in RESIDUE_MASSES.items():
        mass = mass + count_of(s, residue + residue.lower()) * F.lit(weight)
    return guarded(is_valid(s, PROTEIN), F.when(F.length(s) == 0, F.lit(0.0)).otherwise(mass), "invalid Protein sequence", mode)


# Transforms

def reverse(s: Column | str) -> Column:
    return F.reverse(col(s))


def complement(s: Column | str, alphabet=None, mode: str = "strict") -> Column:
    """Case is kept. DNA and RNA only."""
    s = col(s)
    kind = _alphabet(s, alphabet)
    dna, rna = kind == DNA, kind == RNA
    value = F.when(dna & is_valid(s, DNA), F.translate(s, *COMPLEMENTS[DNA])).when(rna & is_valid(s, RNA), F.translate(s, *COMPLEMENTS[RNA]))
    return guarded(s.isNull() | value.isNotNull(), value, "complement is defined for DNA and RNA", mode)


def reverse_complement(s: Column | str, alphabet=None, mode: str = "strict") -> Column:
    """As complement, but the empty protein is allowed."""
    s = col(s)
    return F.when(s == "", "").otherwise(F.reverse(complement(s, alphabet, mode)))


def complement_dna(s: Column | str) -> Column:
    """Upper case; U gives A; other characters stay."""
    return F.translate(col(s), "ACGTUNacgtun", "TGCAANTGCAAN")


def reverse_complement_dna(s: Column | str) -> Column:
    return F.reverse(complement_dna(s))


def transcribe(s: Column | str, alphabet=None, mode: str = "strict") -> Column:
    """T to U, case kept. DNA only; the result is RNA."""
    s = col(s)
    return guarded(s.isNull() | F.coalesce(_alphabet(s, alphabet) == DNA, F.lit(False)), F.translate(s, "Tt", "Uu"), "only DNA can be transcribed", mode)


def transcribe_text(s: Column | str) -> Column:
    return F.translate(col(s), "Tt", "Uu")


def reverse_transcribe(s: Column | str) -> Column:
    return F.translate(col(s), "Uu", "Tt")


def mask(s: Column | str, positions, mask_char: str = "N", mode: str = "strict") -> Column:
    """Characters at the positions (a column of int arrays, or a list) become mask_char, which is not checked."""
    s, n = col(s), F.length(col(s))
    if isinstance(positions, (list, tuple)):
        value = s
        for p in sorted(set(positions)):
            value = F.overlay(value, F.lit(mask_char), F.lit(p + 1), F.lit(1))
        return guarded(n > max(positions, default=-1), value, "index out of bounds", mode)
    at = col(positions)
    # The text between two masked places, joined by the mask.
    edges = F.concat(F.array(F.lit(-1)), F.array_sort(F.array_distinct(F.filter(at, lambda i: i.isNotNull() & (i >= 0)))), F.array(n))
    parts = lambda pick, e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: pick(F.get(e, k) + 1, F.get(e, k + 1) - F.get(e, k) - 1))
    value = F.when(n == 0, s).otherwise(F.transform(F.array(edges), lambda e: by_place(s, lambda pick: F.array_join(parts(pick, e), mask_char)))[0])
    return guarded(F.coalesce(F.array_max(at), F.lit(-1)) < n, value, "index out of bounds", mode)


def concatenate(s1, s2, alphabet1=None, alphabet2=None, mode: str = "strict") -> Column:
    s1, s2 = col(s1), col(s2)
    same = _alphabet(s1, alphabet1) == _alphabet(s2, alphabet2)
    return guarded(s1.isNull() | s2.isNull() | F.coalesce(same, F.lit(False)), F.concat(s1, s2), "alphabets differ", mode)


def random_dna(length, key, seed: int = 0) -> Column:
    """ACGT from SHA-256 of seed, key and block, 64 bases a block: the same again when a task is run again."""
    n = _int(length)
    block = lambda i: F.translate(F.sha2(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string"), i.cast("string")), 256), "0123456789abcdef", "ACGTACGTACGTACGT")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 64).cast("int"), F.lit(0))), block)
    return F.when(n > 0, F.substring(F.array_join(blocks, ""), F.lit(1), n)).otherwise("")


# Search

def find_all(s: Column | str, pattern) -> Column:
    """0-based positions of all occurrences, overlapping ones too; an empty pattern is nowhere."""
    s, p = col(s), _text(pattern)
    n, m = F.length(s), F.length(p)
    none = F.array().cast("array<int>")
    found = by_place(s, lambda pick: F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: pick(i, m) == p))
    return F.when(s.isNull() | p.isNull(), F.lit(None)).when((m == 0) | (m > n), none).otherwise(found)


def count(s: Column | str, pattern) -> Column:
    """The number of occurrences, overlapping ones too."""
    s = col(s)
    if isinstance(pattern, Column):
        return F.size(find_all(s, pattern))
    if pattern == "":
        return F.when(s.isNotNull(), 0)
    if len(pattern) == 1:
        return count_of(s, pattern)
    quoted = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in pattern)
    return F.regexp_count(s, F.lit(f"(?={quoted})"))


def search(s: Column | str, pattern, mode: str = "strict") -> Column:
    """find_all, but an empty pattern is an error: what the Knuth-Morris-Pratt and Boyer-Moore searches give."""
    p = _text(pattern)
    return guarded(F.length(p) > 0, find_all(s, p), "the pattern is empty", mode)


kmp_search = boyer_moore_search = search


def _int(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
