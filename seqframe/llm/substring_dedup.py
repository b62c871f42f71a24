"""Exact removal of repeated substrings with sharded suffix arrays.

Texts are strings of UTF-8 bytes. A window is LENGTH consecutive bytes of one text; each byte of a window that also starts
earlier (in a smaller doc_id, or earlier in the same document) is removed. Windows are judged on the input.

Sharding. Each window is filed under the hash of its smallest SEED-byte string (the leftmost of equal ones), which depends
on the window's bytes only: equal windows always meet, and with the seed at the same place. Consecutive windows filed under
one place form a segment, so a shard's text is about 30 + LENGTH bytes for 30 windows. Segments that repeat as a whole (by a
128-bit digest of their bytes) are settled while they are sorted by (seed, digest): the earliest keeps its windows, the
others lose them. What can still repeat in part are different segments of one seed. Their bytes, one copy of each, are the
strings of the shards: seeds are packed into shards of about SHARD_BYTES, each shard's suffix array is made by induced
sorting, and its permuted common prefixes show which windows are equal.

A seed whose different segments take more than HOT_BYTES is no shard: its windows are filed anew under a longer seed. That
is the old one and half of the window's other bytes, on the side where the window has that many (the right one, if both), so equal windows
meet again; a segment becomes at most two. Parts that repeat as a whole are settled, parts whose seed has no other are
done, and the rest goes to the shards or round again. After six rounds at most a seed is a window, and all of its parts
are equal. Every size takes this path; HOT_BYTES bounds a task's memory, not results.

Repeats within one batch of rows are settled before any shuffle, so a line that fills a document or a text that fills a
source costs one row for each batch. Segments are streamed in sorted order, never gathered; a document's own spans are
gathered, which are fewer than its bytes.

Defined cases: a null text is empty; texts under LENGTH bytes are kept whole, but for none. Rows that repeat a doc_id are
separate texts, in the order of a 64-bit hash of their texts; equal rows in no set order (one stays whole). A null doc_id
comes after all others. Empty tables give empty results. Other columns are left out unless in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, column, mix, slices
from .sais import permuted_lcp, suffix_array
from .words import powers

LENGTH, SEED = 100, 40
SHARD_BYTES, HOT_BYTES = 1 << 19, 1 << 20
BROADCAST_ROWS = 200_000
PIECE = 1 << 23  # longer texts are read in pieces that overlap by LENGTH - 1; positions take 24 bits
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240612).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: n + 1 entries."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def least(h: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each `window` consecutive values."""
    size = 1
    while 2 * size <= window:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (window - size)], h[window - size :]) if window > size else h


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the seed at each place, and in its low bits the place: the least is the smallest seed, the leftmost of equal ones."""
    total, n = sums(data), len(data) - seed + 1
    return mix((total[seed:] - total[:n]) * powers(_INVERSE, n))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Of texts end to end: seed hash, text, first window's start in the text, number of windows."""
    if len(data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h = seed_hashes(data, seed)
    place = least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - seed + 1) & _PLACE
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    whole = np.arange(len(place)) + length <= offsets[text + 1]
    start = np.ones(len(place), bool)
    start[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    change = np.flatnonzero(start | np.concatenate([[False], whole[1:] != whole[:-1]]))
    runs = np.diff(np.append(change, len(place)))
    good = whole[change]
    a, runs = change[good], runs[good]
    return h[place[a].astype(np.int64)], text[a], a - offsets[text[a]], runs


def digests(parts) -> np.ndarray:
    """Two 64-bit numbers for each of some bytes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """Texts end to end with their ids and the place of each piece in its text."""
    for batch, data, offsets in slices(batches, "__text"):
        ids = np.asarray(column(batch, "__id"), np.int64)
        if len(data) <= PIECE:
            yield ids, np.zeros(len(ids), np.int64), data, offsets
        else:  # a single text
            for at in range(0, len(data) - length + 1, PIECE - length + 1):
                part = data[at : at + PIECE]
                yield ids, np.array([at]), part, np.array([0, len(part)])


SEEN = "f long, h1 long, h2 long, id long, start long, run int"


def _segment_rows(length: int, seed: int):
    """Segments for the shuffle; those that an earlier one in the same run of texts equals come out settled (run < 0)."""

    def settle(held):
        f, h1, h2, ids, start, run = (np.concatenate(x) for x in zip(*held, strict=True))
        # Equal ones lie together in the order of one half of the digest; only those are put in the order of their places.
        at = np.argsort(h1)
        same = h1[at[1:]] == h1[at[:-1]]
        at = at[np.append(same, False) | np.append(False, same)]
        at = at[np.lexsort((start[at], ids[at], h2[at], h1[at]))]
        same = (h1[at[1:]] == h1[at[:-1]]) & (h2[at[1:]] == h2[at[:-1]])
        at = at[1:][same]
        again = np.zeros(len(f), bool)
        again[at] = True
        run = np.where(again, -run, run)
        # Settled ones need no partner: deal them out by document. Settled neighbours in a document are one.
        f[at], h1[at], h2[at] = mix(ids[at].astype(np.uint64)).view(np.int64), 0, 0
        at = at[np.lexsort((start[at], ids[at]))]
        if len(at):
            a, b = start[at], start[at] - run[at]
            new = np.ones(len(at), bool)
            new[1:] = (ids[at][1:] != ids[at][:-1]) | (a[1:] > b[:-1])
            first = np.flatnonzero(new)
            run[at[first]] = a[first] - b[np.append(first[1:] - 1, len(at) - 1)]
            keep = ~again
            keep[at[first]] = True
            f, h1, h2, ids, start, run = (x[keep] for x in (f, h1, h2, ids, start, run))
        for i in range(0, len(f), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (f, h1, h2, ids, start)), pa.array(run[part].astype(np.int32))], ["f", "h1", "h2", "id", "start", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, places, data, offsets in _pieces(batches, length):
            f, text, start, runs = segments(data, offsets, length, seed)
            if len(f):
                raw, first = data.tobytes(), offsets[text] + start
                h = digests(raw[a:b] for a, b in zip(first.tolist(), (first + runs + (length - 1)).tolist(), strict=True))
                held.append((f.view(np.int64), h[:, 0], h[:, 1], ids[text], start + places[text], runs))
                n += len(f)
            if n > 500_000:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (f, h1, h2, id, start): repeats settled (kind 0); the first of each segment whose seed has others (1)."""
    last = None  # the last segment's first row, and whether that was given out
    for batch in batches:
        f, h1, h2, ids, start, run = (np.asarray(column(batch, c)) for c in ("f", "h1", "h2", "id", "start", "run"))
        settled = run < 0
        out = [(f[settled], ids[settled], start[settled], -run[settled].astype(np.int64), np.zeros(int(settled.sum()), np.int8))]
        f, h1, h2, ids, start, run = (x[~settled] for x in (f, h1, h2, ids, start, run.astype(np.int64)))
        if len(f):
            same_f, same = np.zeros(len(f), bool), np.zeros(len(f), bool)
            same_f[1:] = f[1:] == f[:-1]
            same[1:] = same_f[1:] & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            if last:
                same_f[0] = f[0] == last[0]
                same[0] = same_f[0] and (h1[0], h2[0]) == last[1]
            out.append((f[same], ids[same], start[same], run[same], np.zeros(int(same.sum()), np.int8)))
            first = np.flatnonzero(~same)
            more = same_f[first]  # not the seed's first segment
            next_more = np.append(more[1:], False)
            if last and len(first) and more[0] and not last[5]:  # the segment carried over turns out to have company
                out.append((np.array([last[0]]), np.array([last[2]]), np.array([last[3]]), np.array([last[4]]), np.ones(1, np.int8)))
            shown = more | next_more
            at = first[shown]
            out.append((f[at], ids[at], start[at], run[at], np.ones(len(at), np.int8)))
            if len(first):
                i = first[-1]
                last = (f[i], (h1[i], h2[i]), ids[i], start[i], run[i], bool(shown[-1]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["f", "id", "start", "run", "kind"])


def _cut(length: int):
    """The bytes of a document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                rows = []
                for doc, text, parts in zip(*(column(batch, c).to_pylist() for c in ("__id", "__text", "parts")), strict=True):
                    raw = (text or "").encode()
                    rows += [(p["f"], doc, p["start"], raw[p["start"] : p["start"] + p["run"] + length - 1]) for p in parts]
                f, ids, start, raw = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(raw, pa.binary())], ["f", "id", "start", "raw"])

    return run


def shard_windows(parts: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Windows of a shard's strings: string and offset of each that an earlier one equals."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8).astype(np.int64) + 2  # 0xFF is in no UTF-8 text
    text[np.cumsum(sizes + 1) - 1] = 1
    text = np.append(text, 0)
    order = suffix_array(text, 258)
    common = permuted_lcp(text, order, 1)
    owner = np.append(np.repeat(np.arange(len(parts)), sizes + 1), len(parts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    group = np.cumsum(common[order] < length)
    ok = order < len(text) - 1
    ok[ok] = order[ok] + length <= begin[owner[order[ok]]] + sizes[owner[order[ok]]]
    p, group = order[ok], group[ok]
    own = owner[p]
    offset = p - begin[own]
    rank = np.lexsort((starts[own] + offset, ids[own], group))
    group, own, offset = group[rank], own[rank], offset[rank]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    return own[~first], offset[~first]


def spans_of(positions: np.ndarray, owners: np.ndarray, length: int):
    """Windows' starts, joined where they follow each other: owner, first byte, byte after the last."""
    order = np.lexsort((positions, owners))
    positions, owners = positions[order], owners[order]
    new = np.ones(len(positions), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (positions[1:] > positions[:-1] + length)
    first = np.flatnonzero(new)
    return owners[first], positions[first], positions[np.append(first[1:] - 1, len(positions) - 1)] + length if len(first) else positions


def _shard(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, ids, starts = list(pdf["raw"]), pdf["id"].to_numpy(), pdf["start"].to_numpy()
        own, offset = shard_windows(parts, ids, starts, length)
        doc, a, b = spans_of(starts[own] + offset, ids[own], length)
        return pd.DataFrame({"id": doc, "a": a, "b": b}).astype("int64")

    return run


def refiled(raw: bytes, place: int, length: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows of a segment by their longer seed: first byte, byte after the last, place in `raw` and bytes added on the left.

    The seed of `size` bytes at `place` grows by half of a window's other bytes: on the right where the window reaches as
    far, else on the left, where it then does.
    """
    grow = (length - size + 1) // 2
    runs = len(raw) - length + 1
    cut = min(max(place + size + grow - length, 0), runs)
    if cut:
        yield 0, cut + length - 1, place - grow, grow
    if cut < runs:
        yield cut, len(raw), place, 0


def _refile(length: int, size: int, first: bool):
    """Strings under longer seeds; the place of a seed is known but in the first round, where it is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = (length - size + 1) // 2
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                rows = []
                for f, doc, start, place, raw in zip(*(column(batch, c).to_pylist() for c in ("f", "id", "start", "place", "raw")), strict=True):
                    if first:
                        h = seed_hashes(np.frombuffer(raw, np.uint8), size) & ~_PLACE
                        place = int(h.argmin())
                    for a, b, seed, left in refiled(raw, place, length, size):
                        name = xxhash.xxh3_64_intdigest(f.to_bytes(8, "little", signed=True) + bytes([left > 0]) + raw[seed : seed + size + grow]) - (1 << 63)
                        rows.append((name, doc, start + a, seed - a, raw[a:b]))
                f, ids, starts, places, raws = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                h = digests(raws)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(x, pa.int64()) for x in (ids, starts, places)), pa.array(raws, pa.binary())], ["f", "h1", "h2", "id", "start", "place", "raw"])

    return run


def find_spans(texts: DataFrame, length: int = LENGTH, seed: int = SEED, scratch: Scratch | None = None, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, a, b: byte spans to remove, in no order and overlapping; texts has __id (unique, not null) and __text."""
    scratch = scratch or Scratch(texts.sparkSession)
    rows = texts.filter(F.octet_length("__text") >= length).mapInArrow(_segment_rows(length, seed), SEEN)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "f").sortWithinPartitions("f", "h1", "h2", "id", "start")
    found = scratch.table(rows.mapInArrow(_sorted_rows, "f long, id long, start long, run long, kind byte"))
    spans = found.filter("kind = 0").select("id", F.col("start").alias("a"), (F.col("start") + F.col("run") + (length - 1)).alias("b"))

    open_ = found.filter("kind = 1")
    size = open_.agg(F.count("*")).first()[0]
    if not size:
        return spans
    by_doc = open_.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("f", "start", "run")).alias("parts"))
    joined = texts.join(F.broadcast(by_doc) if size <= broadcast_rows else by_doc, "__id")
    strings = scratch.table(joined.select("__id", "__text", "parts").mapInArrow(_cut(length), "f long, id long, start long, raw binary"))
    strings, known, total, ready = strings.withColumn("place", F.lit(0).cast("long")), seed, 0, []
    while True:
        seeds = scratch.table(strings.groupBy("f").agg(F.sum(F.octet_length("raw")).alias("size")))
        small, hot = seeds.agg(F.sum(F.when(F.col("size") <= hot_bytes, F.col("size"))), F.count(F.when(F.col("size") > hot_bytes, 1))).first()
        total += small or 0
        if not hot:
            ready.append(strings.select("f", "id", "start", "raw"))
            break
        large = seeds.filter(F.col("size") > hot_bytes).select("f")  # at most the strings' bytes / hot_bytes rows
        ready.append(strings.join(large, "f", "left_anti").select("f", "id", "start", "raw"))
        parts = strings.join(large, "f", "left_semi").mapInArrow(_refile(length, known, known == seed), "f long, h1 long, h2 long, id long, start long, place long, raw binary")
        parts = scratch.table(parts)
        known += (length - known + 1) // 2
        # One of each kind of part stays, the earliest; rows are found again by their place, which no other part has.
        once = parts.groupBy("f", "h1", "h2").agg(F.min(F.struct("id", "start", "place", "raw")).alias("p"))
        once = scratch.table(once.select("f", "p.*"))
        again = parts.select("id", "start", F.octet_length("raw").alias("size")).join(once.select("id", "start"), ["id", "start"], "left_anti")
        spans = spans.union(again.select("id", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
        shared = once.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
        strings = scratch.table(once.join(shared, "f", "left_semi"))
    strings = ready[0]
    for more in ready[1:]:
        strings = strings.union(more)
    shards = max(1, int(total) // shard_bytes)
    found = strings.groupBy(F.pmod(F.xxhash64("f"), F.lit(shards)).alias("shard")).applyInPandas(_shard(length), "id long, a long, b long")
    return spans.union(scratch.table(found))


def joined_spans(parts) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((p["a"], p["b"]) for p in parts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """id_col, the columns in `keep`, n_bytes, n_removed, n_spans, kept (binary): a row for each row of docs."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    plain = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    count = docs.agg(F.count("*").alias("n"), F.count(id_col).alias("ids"), F.approx_count_distinct(id_col)).first()
    unique = plain and count["n"] == count["ids"] and not docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if unique:
        texts = texts.withColumn("__id", F.col(id_col).cast("long"))
    else:  # number the rows in their order: consecutive ranges in consecutive partitions
        texts = scratch.table(texts.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64("__text")).withColumn("__id", F.monotonically_increasing_id()))
    spans = find_spans(texts.select("__id", "__text"), scratch=scratch, **options)
    spans = spans.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    source = texts.join(spans, "__id", "left").select(id_col, *keep, "__text", "parts")
    out = T.StructType([*source.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for text, parts in zip(column(batch, "__text").to_pylist(), column(batch, "parts").to_pylist(), strict=True):
                    raw, gone, last, held = text.encode(), joined_spans(parts), 0, []
                    for a, b in gone:
                        held.append(raw[last:a])
                        last = b
                    rows.append((len(raw), sum(b - a for a, b in gone), len(gone), b"".join([*held, raw[last:]])))
                made = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in [id_col, *keep]), *(pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], schema=arrow)

    return source.mapInArrow(run, out)
