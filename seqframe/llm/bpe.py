"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. In a BPE encoding each prefix of a piece has exactly one possible last token: the token t for which the prefix
without t ends in a token p such that p, t is how BPE encodes the two together. The transducer reads bytes and holds, for
each place where a later token may still start, the last token there; such a place lies no further back than the
longest suffix that begins some token. A state is that record since the last boundary which all open readings share, without
what no later step reads; what lies before is settled and emitted. States and transitions are made when first met and kept in
a hash table of arrays, so that many pieces are read at once, a byte of each in a step. At MAX_STATES the states that were
not met for the longest time are dropped, and made again when met again: reading goes on in the same way, memory is bounded
and results never depend on it. A piece of any length takes linear time. A worker that has had no task for IDLE seconds lets go of
what it remembers, since other stages run in the same workers.

Texts are first cut into pieces by the pattern; results of space-led chunks are remembered in a bounded
table. A chunk is looked up on its own only in texts where each space is followed by something that isn't white
space, for then the pattern's matches never cross from one chunk into the next; other texts are matched whole.

Decoding maps ids to bytes in blocks. StreamDecoder feeds them to an incremental UTF-8 state machine that holds back an
incomplete character (3 bytes at most) until its rest arrives.

Defined cases: a null text is an empty text: no ids. Repeated rows are all returned, null ids too. Empty tables give
empty results. Other columns are left out unless in `keep`. An id outside the vocabulary raises KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import threading
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, mix, trim

MAX_STATES, MAX_CHUNKS, MAX_PAIRS = 160_000, 80_000, 80_000  # about 300 bytes a state, 170 a chunk, 100 a pair
IDLE = 5.0  # seconds after its last task until a worker lets go of all of these
GROUP_CHARS = 1 << 19  # texts that are encoded at once
FEW, SEEN = 24, 50_000  # pieces that are read one by one; transitions at hand then
NONE = 1 << 60
SPACE_THEN_SPACE = regex.compile(r" (?=\s)| \z")


class Node:
    """The longest suffix read that begins a token; by byte: which tokens may end there, the longest first, and the next node."""

    __slots__ = ("text", "number", "open", "go")

    def __init__(self, text: bytes, number: int, open_: tuple[int, ...]):
        self.text, self.number, self.open = text, number, open_  # open: where in it a suffix starts that begins a token, its end included
        self.go: dict[int, tuple[tuple[int, ...], Node]] = {}


class Transitions:
    """(state, byte) to (state, emission), in open addressing."""

    def __init__(self, size: int = 1 << 12):
        self.keys, self.values, self.n = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at, out, open_ = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Of distinct keys that are not held."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self.__init__(1 << (2 * (self.n + len(keys))).bit_length())
            self.put(*old)
        self.n += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            lost = self.keys[at] != keys
            self.values[at[~lost]] = values[~lost]
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & (len(self.keys) - 1)


class Transducer:
    """A state has a number; it holds its node's number and the last token at each place since the settled boundary (-1: not read later), as 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max(8, max_states)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.size = [len(b) for b in self.bytes]
        self.ordered = sorted(ranks)
        self.nodes = [Node(b"", 0, (0,))]
        self.node_of = {b"": self.nodes[0]}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.turn, self.round, self.drops = 0, 0, 0
        self._reset([array("i", (0, -1)).tobytes()])

    def _reset(self, states: list[bytes]) -> None:
        self.states = states
        self.number = {state: i for i, state in enumerate(states)}
        self.final = np.full(self.max_states, -1, np.int64)
        self.met = np.full(self.max_states, self.round, np.int64)  # the round in which a state was last met
        self.transitions = Transitions()
        self.seen: dict[int, int] = {}  # transitions that stream() met
        self.tokens, self.bounds = array("I"), array("q", [0, 0])  # of emissions end to end; emission 0 is empty

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """BPE by its definition, down to `until` parts at least: for the short strings that decide a transition."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > until:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the last to make this one; none for a single byte or one that merges never make."""
        if token not in self.halves:
            parts = self.merge(self.bytes[token], 2)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _made(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self._halves(token) is not None

    def _fits(self, before: int, token: int) -> bool:
        """Can `token` follow `before` (-1: the start of the piece) in an encoding?

        Undo merges of the two, latest first. At each moment the parts that face each other must not have a merge that
        comes before the next one to be undone, for it would have been made.
        """
        if before < 0:
            return True
        pair = before << 24 | token
        known = self.pairs.get(pair)
        if known is not None:
            return known
        left, right, limit, fits, names, ranks = before, token, NONE, True, self.bytes, self.ranks
        while True:
            # A merge to the left of another is made first where ranks are equal.
            if ranks.get(names[left] + names[right], NONE) < limit:
                fits = False
                break
            ends = len(names[left]) == 1, len(names[right]) == 1
            if ends[0] and ends[1]:
                break
            if not ends[0] and (ends[1] or left > right):
                limit, left = left, self._halves(left)[1]
            else:
                limit, right = right + 1, self._halves(right)[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = fits
        return fits

    def _begins(self, text: bytes) -> bool:
        """Whether a longer token begins with the text: the next one in order does."""
        at = bisect_right(self.ordered, text)
        return at < len(self.ordered) and self.ordered[at].startswith(text)

    def _go(self, node: Node, byte: int) -> tuple[tuple[int, ...], Node]:
        text = node.text + bytes((byte,))
        tokens = [t for i in range(len(text)) if (t := self.ranks.get(text[i:])) is not None and self._made(t)]
        rest = next(text[i:] for i in range(len(text) + 1) if i == len(text) or self._begins(text[i:]))
        if rest not in self.node_of:
            self.node_of[rest] = Node(rest, len(self.nodes), tuple(i for i in range(len(rest) + 1) if i == len(rest) or self._begins(rest[i:])))
            self.nodes.append(self.node_of[rest])
        node.go[byte] = tuple(tokens), self.node_of[rest]
        return node.go[byte]

    def _last(self, last, tokens) -> int:
        """The one of the possible tokens that the encoding ends in; exactly one fits, so the last needs no proof."""
        for token in tokens[:-1]:
            if self._fits(last[-self.size[token]], token):
                return token
        return tokens[-1]

    def _held(self, state: int) -> tuple[Node, list[int]]:
        node, *last = array("i", self.states[state])
        return self.nodes[node], last

    def _step(self, state: int, byte: int) -> tuple[bytes, tuple[int, ...]]:
        node, last = self._held(state)
        tokens, node = node.go.get(byte) or self._go(node, byte)
        last.append(self._last(last, tokens))
        size, n = self.size, len(last) - 1
        edge = n - len(node.text)
        # Go back from every open place, the furthest first, until all readings meet: there the text is settled.
        needed = {edge + p for p in node.open}
        ways, settled = len(needed), n
        while ways > 1 or settled not in needed:
            if settled in needed:
                back = settled - size[last[settled]]
                if back in needed:
                    ways -= 1
                else:
                    needed.add(back)
            settled -= 1
        emitted = self._back(last, settled) if settled else ()
        for p in range(settled, n):
            if p not in needed or (p == settled and p - edge not in node.open):
                last[p] = -1  # no later token starts here, and no open reading ends here
        return array("i", (node.number, *last[settled:])).tobytes(), emitted

    def _back(self, last, p: int) -> tuple[int, ...]:
        """The tokens of the reading that ends at p."""
        out = []
        while p > 0:
            out.append(token := last[p])
            p -= self.size[token]
        return tuple(out[::-1])

    def _emission(self, tokens: tuple[int, ...]) -> int:
        if not tokens:
            return 0
        self.tokens.extend(tokens)
        self.bounds.append(len(self.tokens))
        return len(self.bounds) - 2

    def _drop(self, active: np.ndarray) -> np.ndarray:
        """Keep the states that are active and those met last, three quarters of max_states in all; their new numbers, -1 for the others."""
        n = len(self.states)
        age = self.met[:n].copy()
        age[active] = self.round + 1
        age[0] = self.round + 2  # the start
        keep = np.sort(np.argsort(-age, kind="stable")[: self.max_states * 3 // 4])
        number = np.full(n, -1, np.int64)
        number[keep] = np.arange(len(keep))
        old, tokens, bounds, met = self.transitions, np.array(self.tokens, np.uint32), np.array(self.bounds, np.int64), self.met[keep]
        self._reset([self.states[i] for i in keep.tolist()])
        self.met[: len(keep)] = met
        held = old.keys >= 0
        keys, values = old.keys[held], old.values[held]
        a, b = number[keys >> 8], number[values >> 32]
        stay = (a >= 0) & (b >= 0)
        given = values[stay] & 0xFFFFFFFF
        some = np.flatnonzero(given)
        first, sizes = bounds[given[some]], bounds[given[some] + 1] - bounds[given[some]]
        ends = np.cumsum(sizes)
        self.tokens.frombytes(tokens[np.repeat(first - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes())
        self.bounds.frombytes(ends.tobytes())
        emissions = np.zeros(len(given), np.int64)
        emissions[some] = 1 + np.arange(len(some))
        self.transitions.put(a[stay] << 8 | keys[stay] & 255, b[stay] << 32 | emissions)
        self.drops += 1
        self.turn = 0
        return number

    def _make(self, keys: np.ndarray) -> None:
        """The transitions of these (state, byte), which are not known yet."""
        values = []
        for key in keys.tolist():
            held, emitted = self._step(key >> 8, key & 255)
            state = self.number.get(held)
            if state is None:
                state = self.number[held] = len(self.states)
                self.states.append(held)
                self.turn += 1
            values.append(state << 32 | self._emission(emitted))
        self.transitions.put(keys, np.array(values, np.int64))
        if self.turn >= self.max_states // 8:
            self.round, self.turn = self.round + 1, 0

    def _finals(self, states: np.ndarray) -> np.ndarray:
        """What is emitted where a piece ends."""
        for state in np.unique(states[self.final[states] < 0]).tolist():
            last = self._held(state)[1]
            self.final[state] = self._emission(self._back(last, len(last) - 1))
        return self.final[states]

    def _resolve(self, owners: list[np.ndarray], emissions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece and token of emissions, in order."""
        owner, emission = np.concatenate(owners), np.concatenate(emissions)
        bounds = np.frombuffer(self.bounds, np.int64)
        first, sizes = bounds[emission], bounds[emission + 1] - bounds[emission]
        ends = np.cumsum(sizes)
        at = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(owner, sizes), np.frombuffer(self.tokens, np.uint32)[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)

    def stream(self, piece: Iterable[int], state: int = 0) -> Iterator[tuple[int, ...]]:
        """For each byte the tokens that it settles, and at the end what was open. One stream at a time."""
        for byte in piece:
            value = self.seen.get(state << 8 | byte)
            if value is None:
                key = np.array([state << 8 | byte])
                value = int(self.transitions.find(key)[0])
                if value < 0:
                    if len(self.states) >= self.max_states:
                        state = int(self._drop(np.array([state]))[state])
                        key[0] = state << 8 | byte
                    if self.transitions.find(key)[0] < 0:
                        self._make(key)
                    value = int(self.transitions.find(key)[0])
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen[state << 8 | byte] = value
            state, emitted = value >> 32, value & 0xFFFFFFFF
            self.met[state] = self.round
            yield tuple(self.tokens[self.bounds[emitted] : self.bounds[emitted + 1]]) if emitted else ()
        last = self._held(state)[1]
        yield self._back(last, len(last) - 1)

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_many([piece])[0].tolist()

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Their tokens end to end, and how many each has."""
        out, sizes, most = [], [], max(1, self.max_states // 4 - 1)
        for at in range(0, len(pieces), most):
            owner, tokens = self._read(pieces[at : at + most])
            order = np.argsort(owner, kind="stable")
            out.append(tokens[order])
            sizes.append(np.bincount(owner, minlength=min(most, len(pieces) - at)))
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def _read(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece and token, each piece's in order: all pieces are read at once, then those few that are much longer one by one."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8)
        first = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.zeros(int((lengths > 0).sum()), np.int64)
        owners, emissions, done, step = [order[:0]], [order[:0]], [], 0
        while (n := len(state)) > FEW:
            key = state << 8 | data[first[:n] + step]
            value = self.transitions.find(key)
            missing = np.unique(key[value < 0])
            if len(missing):
                if len(self.states) + len(missing) > self.max_states:
                    done.append(self._resolve(owners, emissions))
                    owners, emissions = [order[:0]], [order[:0]]
                    state = self._drop(np.unique(state))[state]
                    key = state << 8 | key & 255
                    missing = np.unique(key[self.transitions.find(key) < 0])
                self._make(missing)
                value = self.transitions.find(key)
            state, emission, step = value >> 32, value & 0xFFFFFFFF, step + 1
            self.met[state] = self.round
            some = np.flatnonzero(emission)
            owners.append(order[some])
            emissions.append(emission[some])
            left = int(np.searchsorted(-lengths[:n], -step))  # longer ones come first
            if left < n:
                owners.append(order[left:n])
                emissions.append(self._finals(state[left:]))
                state = state[:left]
        done.append(self._resolve(owners, emissions))
        rest = [(self.states[x], int(i), int(a)) for x, i, a in zip(state.tolist(), order, first, strict=False)]
        for held, i, a in rest:
            x = self.number.get(held)
            if x is None:  # dropped since
                if len(self.states) >= self.max_states:
                    self._drop(np.zeros(1, np.int64))
                x = self.number[held] = len(self.states)
                self.states.append(held)
                self.met[x] = self.round
            end = a + len(pieces[i])
            tokens = [t for emitted in self.stream(data[a + step : end].tolist(), x) for t in emitted]
            done.append((np.full(len(tokens), i), np.array(tokens, np.uint32)))
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])


class Utf8Machine:
    """Incremental UTF-8: takes bytes as they come, gives text as soon as its characters are complete.

    The state is the incomplete character: its bytes so far, 3 at most. A byte sequence that is no UTF-8 raises
    UnicodeDecodeError when strict, and becomes U+FFFD if not.
    """

    #: Lead byte to the number of bytes that follow it; -1: no lead byte.
    FOLLOW = np.full(256, -1, np.int8)
    FOLLOW[:0x80], FOLLOW[0xC2:0xE0], FOLLOW[0xE0:0xF0], FOLLOW[0xF0:0xF5] = 0, 1, 2, 3

    def __init__(self, strict: bool = True):
        self.held, self.errors = b"", "strict" if strict else "replace"

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            follow = int(self.FOLLOW[data[-back]])
            if follow >= 0 or data[-back] & 0xC0 != 0x80:
                cut -= back if follow >= back else 0
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", self.errors)


class Tokenizer:
    _open: dict[tuple[str, str], Tokenizer] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        top = max(ranks.values()) + 1
        self.sizes, self.offsets, held = np.zeros(top, np.int64), np.zeros(top, np.int64), []
        at = 0
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.sizes[i], self.offsets[i] = len(token), at
            held.append(token)
            at += len(token)
        self.held = np.frombuffer(b"".join(held), np.uint8)
        self.names = [str(i) for i in range(top)]
        self.lock, self.tasks, self.turn = threading.Lock(), 0, 0
        self.forget()

    def forget(self) -> None:
        """Let go of what was remembered: it is made again when met again."""
        self.machine = Transducer(self.ranks)
        self.chunks: dict[str, bytes] = {}  # ids as 32-bit numbers, of chunks without their space
        self.older: dict[str, bytes] = {}

    @contextmanager
    def task(self, idle: float = IDLE) -> Iterator[Tokenizer]:
        """Around a task; when none has begun for `idle` seconds since the last one's end, forget()."""
        with self.lock:
            self.tasks += 1
            self.turn += 1
        try:
            yield self
        finally:
            with self.lock:
                self.tasks -= 1
                turn = self.turn
            trim()
            timer = threading.Timer(idle, self._forget_if, (turn,))
            timer.daemon = True
            timer.start()

    def _forget_if(self, turn: int) -> None:
        with self.lock:
            if not self.tasks and turn == self.turn:
                self.forget()
                trim()

    @classmethod
    def open(cls, path: str, pattern: str) -> Tokenizer:
        """One for each Python worker; path is a file of base64 tokens and ranks that each machine has."""
        if (path, pattern) not in cls._open:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            cls._open[path, pattern] = cls(ranks, pattern)
        return cls._open[path, pattern]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has; equal pieces are encoded once."""
        number: dict[str, int] = {}
        turn = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        raw = [p.encode() for p in number]
        rank = np.array([self.machine.ranks.get(p, -1) for p in raw], np.int64)
        whole = np.flatnonzero(rank >= 0)
        made, sizes = self.machine.encode_many([raw[i] for i in np.flatnonzero(rank < 0).tolist()])
        first, size = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64)
        first[whole] = np.arange(len(whole))
        size[rank < 0] = sizes
        first[rank < 0] = len(whole) + np.cumsum(sizes) - sizes
        ids = np.concatenate([rank[whole].astype(np.uint32), made])
        sizes = size[turn]
        ends = np.cumsum(sizes)
        return ids[np.repeat(first[turn] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts or chunks, as 32-bit numbers."""
        pieces = [self.pattern.findall(t) for t in texts]
        ids, sizes = self._pieces([p for found in pieces for p in found])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, pieces)])] * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, each led by a space: they are matched in one text, where no match may cross a chunk's end."""
        if not chunks:
            return []
        pieces = self.pattern.findall(" " + " ".join(chunks))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        want = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        last = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or (ends[last] != want).any():
            return self._texts([" " + c for c in chunks])
        ids, sizes = self._pieces(pieces)
        ends = (np.cumsum(sizes)[last] * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _known(self, chunks: dict[str, None]) -> dict[str, bytes]:
        """The ids of chunks that are not in the younger half of what is remembered."""
        out = {c: f for c in chunks if (f := self.older.get(c)) is not None}
        new = [c for c in chunks if c not in out]
        out.update(zip(new, self._spaced(new), strict=True))
        if len(self.chunks) + len(out) > MAX_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        self.chunks.update((c, f) for c, f in zip(out, out.values(), strict=True) if len(c) <= 64 and len(self.chunks) < MAX_CHUNKS)
        return out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[t] if SPACE_THEN_SPACE.search(t) else t.split(" ") for t in texts]
        first = self._texts([c[0] for c in cut])
        get, rows, holes, missing = self.chunks.get, [], [], {}
        for chunks in cut:
            rows.append(row := list(map(get, chunks[1:])))
            holes.append(at := [i for i, f in enumerate(row) if f is None] if None in row else [])
            missing.update((chunks[i + 1], None) for i in at)
        made = self._known(missing)
        out = []
        for head, chunks, row, at in zip(first, cut, rows, holes, strict=True):
            for i in at:
                row[i] = made[chunks[i + 1]]
            out.append(np.frombuffer(b"".join([head, *row]), np.uint32))
        return out

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in turn."""
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= GROUP_CHARS):
                n, to = n + len(texts[to]), to + 1
            yield from self._group(texts[at:to])
            at = to

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decimal(self, ids: np.ndarray) -> str:
        """Ids as decimal numbers joined by commas."""
        return ",".join(map(self.names.__getitem__, ids.tolist()))

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] == 0).any()):
            raise KeyError("an id that is not in the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.held[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()

    def decode_stream(self, ids: Iterable[int], block: int = 1 << 16, strict: bool = True) -> Iterator[str]:
        machine, ids = Utf8Machine(strict), np.asarray(ids, np.int64)
        for at in range(0, len(ids), block):
            yield machine.feed(self.decode(ids[at : at + block]))
        yield machine.close()


def _rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _source(docs: DataFrame, text_col: str, keep) -> DataFrame:
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns in `keep` and ids, an array of ints."""
    source = _source(docs, text_col, keep)
    out = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        with Tokenizer.open(path, pattern).task() as tokenizer:
            yield from encoded(tokenizer, batches)

    def encoded(tokenizer, batches):
        for batch in _rows(batches):
            ids = [x.astype(np.int32) for x in tokenizer.encode_many([t or "" for t in column(batch, "__text").to_pylist()])]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))], schema=arrow)

    return source.mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, pattern: str, keep=("doc_id",)) -> DataFrame:
    """The columns in `keep` and text, from the column ids; bytes that are no UTF-8 become U+FFFD."""
    source = encoded.select(*keep, "ids")
    out = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        tokenizer = Tokenizer.open(path, pattern)
        for batch in _rows(batches):
            texts = ["".join(tokenizer.decode_stream(ids or [], strict=False)) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(texts, pa.string())], schema=arrow)

    return source.mapInArrow(run, out)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep=("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode, then decode as a stream: the columns in `keep`, n_tokens, ids_sha256, decoded_sha256, and ids if wanted."""
    source = _source(docs, text_col, keep)
    out = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)])
    arrow = to_arrow_schema(out)

    def run(batches):
        with Tokenizer.open(path, pattern).task() as tokenizer:
            yield from trip(tokenizer, batches)

    def trip(tokenizer, batches):
        for batch in _rows(batches):
            sizes, names, texts, held = [], [], [], [np.zeros(0, np.int32)]
            for ids in tokenizer.encode_many([t or "" for t in column(batch, "__text").to_pylist()]):
                sizes.append(len(ids))
                if with_ids:
                    held.append(ids.view(np.int32))
                names.append(hashlib.sha256(tokenizer.decimal(ids).encode()).hexdigest())
                seen = hashlib.sha256()
                for part in tokenizer.decode_stream(ids):
                    seen.update(part.encode())
                texts.append(seen.hexdigest())
            made = [pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(held))))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *made], schema=arrow)

    return source.mapInArrow(run, out)
