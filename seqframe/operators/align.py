"""Pairwise alignment: global, local and semi-global, in Arrow batches; edit distance as a built-in expression.

A cell has a score and a move (0 diagonal, 1 left: a gap in seq1, 2 up: a gap in seq2, 3 stop). A gap costs `extend`
where the neighbour it comes from was itself such a gap, else `open`; so which of equal moves is chosen matters. Global and semi-global prefer diagonal, left,
up; local prefers up, left, diagonal, stop. Cells of one anti-diagonal depend on the two before only, and are computed together, and so
are those of many pairs of like length: shorter ones are filled up at their ends, where no cell of theirs looks. Scores take the
least type that holds any score of the group, 16 bits up to some 16,000 characters with the default scheme.

Pairs of any length are aligned. Every K-th anti-diagonal is kept, and the traceback computes the moves between two of them again, for the K rows it can
reach: with K as in `_spacing`, memory grows as (m + n) ** (2/3) * min(m, n) ** (2/3) and the moves computed again are (m + n) * K. The score alone takes linear memory.

Semi-global alignment frees the end gaps of both sequences; the overhang after the best cell is written once, in order. Comparison
is by character, case matters. Empty input is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ALIGN_STRUCT, SequenceError, by_place, col

GLOBAL, LOCAL, SEMI_GLOBAL = "global", "local", "semiglobal"
#: Pairs of at most so many cells keep the moves of the only pass, two bits each.
WHOLE_CELLS = 160_000_000
#: Cells, pairs and rows of all pairs that are computed together: their diagonals stay in a core's cache.
GROUP_CELLS, GROUP_PAIRS, GROUP_ROWS = 160_000_000, 1_024, 80_000
WIDTH = 60


@dataclass(frozen=True)
class ScoringScheme:
    """Penalties are added, so they are negative."""

    match: int = 2
    mismatch: int = -1
    gap_open: int = -2
    gap_extend: int = -1


@dataclass(frozen=True)
class Alignment:
    seq1_aligned: str
    seq2_aligned: str
    score: int
    seq1_start: int
    seq1_end: int
    seq2_start: int
    seq2_end: int

    @property
    def identity(self) -> float:
        return identity(self.seq1_aligned, self.seq2_aligned)

    def row(self) -> tuple:
        return (self.seq1_aligned, self.seq2_aligned, self.score, self.seq1_start, self.seq1_end, self.seq2_start, self.seq2_end, self.identity)

    def format(self) -> str:
        """Score, identity, ranges, then blocks of 60 columns."""
        out = [f"Score: {self.score}", f"Identity: {self.identity:.2f}%", f"Seq1: {self.seq1_start}..{self.seq1_end}", f"Seq2: {self.seq2_start}..{self.seq2_end}", ""]
        for at in range(0, len(self.seq1_aligned), WIDTH):
            a, b = self.seq1_aligned[at : at + WIDTH], self.seq2_aligned[at : at + WIDTH]
            out += [f"Seq1: {a}", "      " + "".join("|" if x == y and x != "-" else " " for x, y in zip(a, b, strict=True)), f"Seq2: {b}", ""]
        return "\n".join(out) + "\n"


def identity(a: str, b: str) -> float:
    """Percent of columns with equal characters, gaps counted in the length; 0.0 for an empty alignment."""
    if not a:
        return 0.0
    x, y = _points(a), _points(b)
    return 100.0 * int(np.count_nonzero((x == y) & (x != ord("-")))) / len(x)


def _codes(seqs1: list[str], seqs2: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each place and a column for each text, filled up at the end; codes that differ do so above the lowest bits."""
    lengths = [len(x) for x in seqs1 + seqs2]
    chars = np.frombuffer("".join(seqs1 + seqs2).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    top = int(chars.max()) + 1
    if top > 256:
        there, chars = np.unique(chars, return_inverse=True)
        top = len(there)
    ends, out = np.cumsum(lengths), []
    for first, seqs in ((0, seqs1), (len(seqs1), seqs2)):
        codes = np.full((len(seqs), max(map(len, seqs))), top + bool(first), np.int64)
        for row, end, n in zip(codes, ends[first:].tolist(), lengths[first:], strict=False):
            row[:n] = chars[end - n : end]
        out.append(codes.T << bits)
    return out[0], out[1]


class _Sweep:
    """Anti-diagonals in turn, of all pairs at once: of diagonal d, cell (i, d - i) of pair p stands in row i, column p, and so
    a run of rows is one run of memory, which is computed in place. Memory is linear."""

    def __init__(self, seqs1: list[str], seqs2: list[str], mode: str, s: ScoringScheme):
        if not all(seqs1) or not all(seqs2):
            raise SequenceError("alignment of an empty sequence")
        if mode not in (GLOBAL, LOCAL, SEMI_GLOBAL):
            raise SequenceError(f"unknown alignment type: {mode}")
        self.ms, self.ns = (np.array([len(x) for x in seqs]) for seqs in (seqs1, seqs2))
        self.m, self.n, self.pairs, self.mode, self.d = int(self.ms.max()), int(self.ns.max()), len(seqs1), mode, 0
        self.less = s.match - s.mismatch  # what a mismatch scores less
        a, b = _codes(seqs1, seqs2, max(0, self.less - 1).bit_length())
        largest, short, long = max(abs(s.match), abs(s.mismatch), abs(s.gap_open), abs(s.gap_extend)), min(self.m, self.n), max(self.m, self.n)
        if max(s.gap_open, s.gap_extend) <= 0:
            # No path scores more than its diagonal steps, no cell less than a border's and the diagonal steps from there.
            most = max(short * max(s.match, s.mismatch, 0), -short * min(s.match, s.mismatch, 0) - long * s.gap_extend) + 16 * largest
        else:
            most = (self.m + self.n + 8) * largest
        # Any score is in the type, so the difference of a greater and a smaller one is in its unsigned form.
        self.kind, self.size = next(k for k in ((np.int16, np.uint16), (np.int32, np.uint32), (np.int64, np.uint64)) if max(most, 2 * int(max(a.max(), b.max()))) < np.iinfo(k[0]).max)
        self.a, self.b = a.astype(self.kind).ravel(), b[::-1].astype(self.kind).ravel()
        self.match, self.open, self.more = (self.kind(x) for x in (s.match, s.gap_open, s.gap_extend - s.gap_open))
        # Scores of the diagonal before this one and of this one; what the cells right of and below this one's score by a gap.
        size = (self.m + 1) * self.pairs
        self.old, self.score, self.left, self.up = (np.zeros(size, self.kind) for _ in range(4))
        self.x, self.y, self.z, self.w = (np.empty(size, self.kind) for _ in range(4))
        self.over_x, self.over_y = self.x.view(self.size), self.y.view(self.size)
        # As arrays, since numpy has no vector instructions for the least of an array and a scalar.
        self.zero, self.one, self.worse = (np.full(size, x, k) for x, k in ((0, self.kind), (1, self.size), (max(1, self.less), self.kind)))

    def state(self, first: int, last: int) -> tuple:
        """What step() goes on from, for the rows first..last."""
        return self.d, first, *(x[first * self.pairs : (last + 1) * self.pairs].copy() for x in (self.old, self.score, self.left, self.up))

    def resume(self, state: tuple) -> None:
        self.d, first, *kept = state
        for x, part in zip((self.old, self.score, self.left, self.up), kept, strict=True):
            x[first * self.pairs : first * self.pairs + len(part)] = part

    def step(self, first: int, last: int, moves: bool) -> tuple[int, int, np.ndarray] | None:
        """Compute rows first..last of the next diagonal; the inner rows among them and their moves (of LOCAL: 3 less the move), until the next step."""
        self.d = d = self.d + 1
        p, new, kept = self.pairs, self.old, None  # a cell needs old[i - 1] only, which is read before it is written
        lo, hi = max(1, d - self.n, first), min(self.m, d - 1, last)
        if lo <= hi:
            here, above = slice(lo * p, (hi + 1) * p), slice((lo - 1) * p, hi * p)
            size = (hi - lo + 1) * p
            x, y, diagonal = self.x[:size], self.y[:size], self.z[:size]
            left, up = self.left[here], self.up[above]
            np.bitwise_xor(self.a[above], self.b[(self.n - d + lo) * p : (self.n - d + hi + 1) * p], out=x)
            np.minimum(x, self.worse[:size], out=x)
            if self.less < 1:
                x *= self.kind(self.less)
            np.subtract(self.old[above], x, out=diagonal)
            diagonal += self.match
            best, one = new[here], self.one[:size]
            over_x, over_y = self.over_x[:size], self.over_y[:size]
            if self.mode == LOCAL:
                np.maximum(diagonal, left, out=best)
                np.maximum(best, up, out=best)
                np.maximum(best, self.zero[:size], out=best)
                np.subtract(best, up, out=x)
                np.minimum(over_x, one, out=over_x)  # 0: up
                np.subtract(best, left, out=y)
                np.minimum(over_y, one, out=over_y)
                y &= x  # 0: up or left
                if moves:
                    kept = diagonal
                    np.add(x, y, out=kept)
                    kept += self.kind(1)
                    kept *= np.minimum(best, self.one.view(self.kind)[:size], out=self.w[:size])
                left, up = self.left[here], self.up[here]
                x *= self.more
                y *= self.more
                np.add(best, self.open, out=left)
                np.add(left, self.more, out=up)
                up -= x
                left += x
                left -= y
            else:
                np.maximum(diagonal, left, out=x)
                np.maximum(x, up, out=best)
                np.subtract(best, x, out=x)
                np.minimum(over_x, one, out=over_x)  # 1: up
                np.subtract(best, diagonal, out=y)
                np.minimum(over_y, one, out=over_y)  # 1: up or left
                if moves:
                    kept = diagonal
                    np.add(x, y, out=kept)
                if self.more != 1:
                    x *= self.more
                    y *= self.more
                left, up = self.left[here], self.up[here]
                np.add(best, self.open, out=up)
                np.add(up, y, out=left)
                left -= x
                up += x
        edge = int(self.open) * d + int(self.more) * (d - 1) if self.mode == GLOBAL else 0  # open + (d - 1) * extend
        gap, longer = edge + int(self.open), edge + int(self.open) + int(self.more)
        if first == 0 and d <= self.n:  # in the first row, by gaps in seq1
            new[:p], self.left[:p], self.up[:p] = edge, gap if self.mode == LOCAL else longer, gap
        if d <= min(self.m, last) and d >= first:  # in the first column, by gaps in seq2
            at = slice(d * p, (d + 1) * p)
            new[at], self.left[at], self.up[at] = edge, gap, gap if self.mode == LOCAL else longer
        self.old, self.score = self.score, new
        return None if kept is None else (lo, hi, kept)


class _Moves:
    """The moves of many diagonals, two bits each: eight diagonals of a row in one number."""

    def __init__(self, sweep: _Sweep):
        self.sweep, self.start, self.blocks = sweep, sweep.d, []

    def take(self, step: tuple[int, int, np.ndarray] | None) -> None:
        """The moves of the diagonal that was just computed."""
        at = self.sweep.d - self.start - 1
        if at % 8 == 0:
            # Rows that are in any of these diagonals.
            first = 0 if step is None else step[0]
            self.blocks.append((first, np.zeros((min(self.sweep.m, self.sweep.d + 7) - first + 1) * self.sweep.pairs, np.uint16)))
        if step is not None:
            lo, hi, moves = step
            moves *= self.sweep.kind(1).dtype.type(np.int64(1 << 2 * (at % 8)))
            first, block = self.blocks[-1]
            part = block[(lo - first) * self.sweep.pairs : (hi - first + 1) * self.sweep.pairs]
            if moves.dtype == np.int16:
                part |= moves.view(np.uint16)
            else:
                np.bitwise_or(part, moves, out=part, casting="unsafe")

    def reader(self, pair: int):
        """A function from (row, diagonal) to the move."""
        views, pairs, start, flip = [(first, memoryview(block)) for first, block in self.blocks], self.sweep.pairs, self.start + 1, 3 if self.sweep.mode == LOCAL else 0

        def move(i: int, d: int) -> int:
            at = d - start
            first, block = views[at >> 3]
            got = block[(i - first) * pairs + pair] >> ((at & 7) << 1) & 3
            return flip - got if flip else got

        return move


def _spacing(m: int, n: int) -> int:
    """Between the diagonals kept, so that they and the moves between two of them take the least memory together."""
    return max(64, int((8 * (m + n) * min(m, n)) ** (1 / 3)))


def _forward(sweep: _Sweep, kept: list | None, moves: _Moves | None) -> list[tuple[int, int, int]]:
    """(score, i, j) of the last cell of each pair's best alignment; fills in the states of every K-th diagonal, and all moves."""
    m, n, mode, pairs = sweep.m, sweep.n, sweep.mode, sweep.pairs
    ms, ns, every = sweep.ms.tolist(), sweep.ns.tolist(), _spacing(m, n)
    best, ends = [0] * pairs, list(zip([0] * pairs, ms, ns, strict=True))
    corners: dict[int, list[int]] = {}
    for p in range(pairs):
        corners.setdefault(ms[p] + ns[p], []).append(p)
    if mode == LOCAL:
        # The score that a cell must have to matter, cell by cell; where there is none yet, 1.
        need = np.ones((m + 1) * pairs, sweep.kind)
        need_of, found = need.reshape(m + 1, pairs), np.empty((m + 1) * pairs, bool)
    elif mode == SEMI_GLOBAL:
        row, column, every_pair = np.zeros((pairs, n + 1), sweep.kind), np.zeros((pairs, m + 1), sweep.kind), np.arange(pairs)
        equal, first_end = (sweep.ms == m).all() and (sweep.ns == n).all(), min(min(ms), min(ns))
    for d in range(m + n + 1):
        lo, hi = max(0, d - n), min(m, d)
        if d:
            step = sweep.step(0, m, moves is not None)
            if moves is not None:
                moves.take(step)
        if mode == LOCAL:
            part, hit = slice(lo * pairs, (hi + 1) * pairs), found[: (hi - lo + 1) * pairs]
            np.greater_equal(sweep.score[part], need[part], out=hit)
            if hit.any():
                for at in np.flatnonzero(hit).tolist():
                    i, p = lo + at // pairs, at % pairs
                    top = int(sweep.score[lo * pairs + at])
                    # Not beyond a shorter pair's end; the first in row-major order.
                    if i <= ms[p] and d - i <= ns[p] and (top > best[p] or i < ends[p][1]):
                        best[p], ends[p] = top, (top, i, d - i)
                        # Of the same score, an earlier row only.
                        need_of[lo:i, p], need_of[i:, p] = top, top + 1
        elif mode == SEMI_GLOBAL and d >= first_end:
            score = sweep.score.reshape(m + 1, pairs)
            if equal:
                if d >= m:
                    row[:, d - m] = score[m]
                if d >= n:
                    column[:, d - n] = score[d - n]
            else:
                at = every_pair[(sweep.ms <= d) & (d <= sweep.ms + sweep.ns)]
                row[at, d - sweep.ms[at]] = score[sweep.ms[at], at]
                at = every_pair[(sweep.ns <= d) & (d <= sweep.ms + sweep.ns)]
                column[at, d - sweep.ns[at]] = score[d - sweep.ns[at], at]
        if mode != LOCAL:
            for p in corners.get(d, ()):
                ends[p] = (int(sweep.score[ms[p] * pairs + p]), ms[p], ns[p])
        if kept is not None and d % every == 0:
            kept.append(sweep.state(max(0, lo - 1), hi))
    if mode == LOCAL:
        return [end if end[0] > 0 else (0, 0, 0) for end in ends]
    if mode == SEMI_GLOBAL:
        for p in range(pairs):
            across, down = row[p, : ns[p] + 1], column[p, : ms[p] + 1]
            if across.max() > ends[p][0]:
                ends[p] = (int(across.max()), ms[p], int(across.argmax()))
            if down.max() > ends[p][0]:
                ends[p] = (int(down.max()), int(down.argmax()), ns[p])
    return ends


def _traced(seq1: str, seq2: str, mode: str, end: tuple[int, int, int], move) -> Alignment:
    """The alignment that ends at a cell; move(i, d) is the move of row i on diagonal d."""
    best, i, j = end
    if mode == LOCAL and best <= 0:
        return Alignment("", "", 0, 0, 0, 0, 0)
    steps, d = bytearray(), i + j
    add = steps.append
    while i > 0 and d > i:
        step = move(i, d)
        if step == 3:
            break
        add(step)
        if step == 0:
            i -= 1
            d -= 2
        elif step == 1:
            d -= 1
        else:
            i -= 1
            d -= 1
    j = d - i
    taken = np.frombuffer(steps, np.uint8)[::-1]
    middle1, middle2 = _gapped(seq1[i : end[1]], taken != 1), _gapped(seq2[j : end[2]], taken != 2)
    if mode == LOCAL:
        return Alignment(middle1, middle2, best, i, end[1], j, end[2])
    over1, over2 = len(seq1) - end[1], len(seq2) - end[2]  # none but in SEMI_GLOBAL
    return Alignment(f"{seq1[:i]}{'-' * j}{middle1}{seq1[end[1] :]}{'-' * over2}", f"{'-' * i}{seq2[:j]}{middle2}{'-' * over1}{seq2[end[2] :]}", best, 0, end[1], 0, end[2])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gapped(text: str, there: np.ndarray) -> str:
    """The text's characters at the places that are there, gaps at the others."""
    out = np.full(len(there), ord("-"), np.uint32)
    out[there] = _points(text)
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def _groups(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Places of pairs of like length, as many as are computed together; a large pair alone."""
    order = sorted(range(len(pairs)), key=lambda p: (len(pairs[p][0]), len(pairs[p][1])))
    group, m, n = [], 0, 0
    for p in order:
        m_new, n_new = max(m, len(pairs[p][0])), max(n, len(pairs[p][1]))
        own = len(pairs[p][0]) * len(pairs[p][1])
        # Not so many that their diagonals leave the cache or their moves take too much memory, nor with one that would be padding for the most part.
        if group and ((len(group) + 1) * m_new > GROUP_ROWS or (len(group) + 1) * m_new * n_new > GROUP_CELLS or len(group) == GROUP_PAIRS or m_new * n_new > 1.2 * max(own, 4096) or own > WHOLE_CELLS):
            yield group
            group, m_new, n_new = [], len(pairs[p][0]), len(pairs[p][1])
        group, m, n = [*group, p], m_new, n_new
    if group:
        yield group


def align_pairs(pairs: list[tuple[str, str]], mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> list[Alignment]:
    """The alignment of each pair, those of like length computed together."""
    out: list[Alignment | None] = [None] * len(pairs)
    for group in _groups(pairs):
        seqs1, seqs2 = [pairs[p][0] for p in group], [pairs[p][1] for p in group]
        sweep = _Sweep(seqs1, seqs2, mode, scoring)
        if len(group) == 1 and sweep.m * sweep.n > WHOLE_CELLS:
            out[group[0]] = _align_long(sweep, seqs1[0], seqs2[0])
            continue
        moves = _Moves(sweep)
        ends = _forward(sweep, None, moves)
        for k, p in enumerate(group):
            out[p] = _traced(seqs1[k], seqs2[k], mode, ends[k], moves.reader(k))
    return out


def _align_long(sweep: _Sweep, seq1: str, seq2: str) -> Alignment:
    """One pair whose moves would take too much memory: they are computed again between two of the kept diagonals."""
    kept: list = []
    (end,) = _forward(sweep, kept, None)
    every, start, found = _spacing(sweep.m, sweep.n), sweep.m + sweep.n + 1, None

    def move(i: int, d: int) -> int:
        nonlocal start, found
        if d <= start:
            # Diagonals after the kept one before this cell, in the rows that a path from here can reach.
            state = kept[(d - 1) // every]
            sweep.resume(state)
            start, moves = state[0], _Moves(sweep)
            while sweep.d < d:
                moves.take(sweep.step(max(0, i - (d - sweep.d - 1)), i, True))
            found = moves.reader(0)
        return found(i, d)

    return _traced(seq1, seq2, sweep.mode, end, move)


def align_pair(seq1: str, seq2: str, mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> Alignment:
    return align_pairs([(seq1, seq2)], mode, scoring)[0]


def score_pairs(pairs: list[tuple[str, str]], mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> list[int]:
    """The scores alone, in memory linear in the lengths."""
    out = [0] * len(pairs)
    for group in _groups(pairs):
        for p, end in zip(group, _forward(_Sweep([pairs[p][0] for p in group], [pairs[p][1] for p in group], mode, scoring), None, None), strict=True):
            out[p] = end[0]
    return out


def score_pair(seq1: str, seq2: str, mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> int:
    return score_pairs([(seq1, seq2)], mode, scoring)[0]


def align(seq1: Column | str, seq2: Column | str, mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> Column:
    """ALIGN_STRUCT of each pair; NULL if either is NULL."""

    @F.pandas_udf(ALIGN_STRUCT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in ALIGN_STRUCT.split(", ")]
        there = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        made = iter(align_pairs([(x, y) for x, y, t in zip(a, b, there, strict=True) if t], mode, scoring))
        rows = [next(made).row() if t else ("", "", 0, 0, 0, 0, 0, 0.0) for t in there]
        return pd.DataFrame(rows, columns=names)

    return F.when(col(seq1).isNotNull() & col(seq2).isNotNull(), run(col(seq1), col(seq2)))


def needleman_wunsch(seq1, seq2, scoring: ScoringScheme = ScoringScheme()) -> Column:
    return align(seq1, seq2, GLOBAL, scoring)


def smith_waterman(seq1, seq2, scoring: ScoringScheme = ScoringScheme()) -> Column:
    return align(seq1, seq2, LOCAL, scoring)


def semi_global_align(seq1, seq2, scoring: ScoringScheme = ScoringScheme()) -> Column:
    return align(seq1, seq2, SEMI_GLOBAL, scoring)


def align_score(seq1: Column | str, seq2: Column | str, mode: str = GLOBAL, scoring: ScoringScheme = ScoringScheme()) -> Column:
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        there = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        made = iter(score_pairs([(x, y) for x, y, t in zip(a, b, there, strict=True) if t], mode, scoring))
        return pd.Series([next(made) if t else 0 for t in there], dtype="int32")

    return F.when(col(seq1).isNotNull() & col(seq2).isNotNull(), run(col(seq1), col(seq2)))


def edit_distance(seq1: Column | str, seq2: Column | str) -> Column:
    return F.levenshtein(col(seq1), col(seq2))


def alignment_identity(aligned1: Column, aligned2: Column) -> Column:
    """Percent identity of two gapped strings, without a Python worker."""
    n = F.length(aligned1)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    one = lambda pick1, pick2: lambda i: (pick1(i, F.lit(1)) == pick2(i, F.lit(1))) & (pick1(i, F.lit(1)) != "-")
    same = by_place(aligned1, lambda pick1: by_place(aligned2, lambda pick2: F.size(F.filter(places, one(pick1, pick2)))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(100.0) * same / F.when(n == 0, 1).otherwise(n))


@F.pandas_udf(T.StringType())
def format_alignment(a: pd.DataFrame) -> pd.Series:
    """The printed form of an ALIGN_STRUCT column."""
    fields = ["seq1_aligned", "seq2_aligned", "score", "seq1_start", "seq1_end", "seq2_start", "seq2_end"]
    return pd.Series([None if r[0] is None else Alignment(*r).format() for r in a[fields].itertuples(index=False, name=None)])
