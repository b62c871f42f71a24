"""Benchmark decontamination by winnowing.

An item's window is SPAN consecutive words (an item of fewer words is one window). Texts and items are cut into hashed
GRAM-word grams; in every run of SPAN - GRAM + 1 grams the smallest hash is kept (the last of equal ones), so that any
shared span of SPAN words leaves one common fingerprint in both. Fingerprints of texts and items are joined; each hit is
extended to the windows of the text that hold it, which are looked up among the items' windows and compared word by word.
Equal fingerprints and equal windows of an item are one entry, so that text which repeats itself costs no more than other
text: time is linear in the text and in what is found. Items of fewer words have a fingerprint of their own length (a
winnowing window of one), looked up among all grams of that length.

The items' fingerprints are broadcast while they number at most BROADCAST_GRAMS, whose memory is then bounded (about
60 bytes each and the items' words). Beyond it items are cut by a hash of their id into parts of about that many (one
item's fingerprints are never split), each part goes over the texts in turn, and hits are summed by text: the same
result, with bounded memory in the workers, in as many passes.

Defined cases: a null or empty text or item has no words, so neither hits nor is hit. Repeated item ids are listed once;
their windows all count. A null item id is listed as an empty string. Repeated documents each return a row; a null
doc_id is kept. Empty tables give an empty result, or no hits. Other columns are left out unless in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, mix, slices, trimmed
from .words import Words, grams, owner, words

SPAN, GRAM = 10, 5
BROADCAST_GRAMS = 2_000_000


def winnow(h: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: in each run of `window` hashes of one group, the smallest (the last of equal ones)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[window - 1 :].copy(), np.arange(window - 1, len(h))
    for back in range(1, window):
        other = h[window - 1 - back : len(h) - back]
        less = other < best
        best[less] = other[less]
        at[less] -= at[less] - (np.flatnonzero(less) + window - 1 - back)
    return np.unique(at[group[:n] == group[window - 1 :]])


class Items:
    """The windows of some items, for lookups."""

    def __init__(self, ids: list, texts: list[str | None], span: int = SPAN, gram: int = GRAM):
        self.ids, self.span, self.gram = ["" if x is None else str(x) for x in ids], span, gram
        raw = [(t or "").encode() for t in texts]
        self.words = w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        own, sizes = owner(w.first), np.diff(w.first)
        g = grams(w.hashes, gram)
        whole = own[: len(g)] == own[gram - 1 :] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(whole & (sizes[own[: len(g)]] >= span))
        self.prints = np.unique(g[at[winnow(g[at], own[at], span - gram + 1)]])
        #: By length: hash, item and first word of each distinct window of an item, in order.
        self.windows = {}
        at = np.flatnonzero(own[: max(0, len(own) - span + 1)] == own[span - 1 :])
        self._file(span, at, own)
        first = w.first[:-1][(sizes > 0) & (sizes < span)]
        for n in np.unique(sizes[own[first]]).tolist():
            self._file(n, first[sizes[own[first]] == n], own)

    def _file(self, n: int, at: np.ndarray, own: np.ndarray) -> None:
        h = hashes_at(self.words.hashes, at, n)
        order = np.lexsort((own[at], h))
        at, h = at[order], h[order]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[at[1:]] != own[at[:-1]])
        self.windows[n] = h[new], own[at[new]], at[new]

    def hits(self, w: Words, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, item) of each window that an item holds."""
        for n, (table, items, places) in self.windows.items():
            if n == self.span:
                g = grams(w.hashes, self.gram)
                at = np.flatnonzero(own[: len(g)] == own[self.gram - 1 :]) if len(g) else np.zeros(0, np.int64)
                at = at[winnow(g[at], own[at], n - self.gram + 1)] if len(at) else at
                hit = at[np.isin(g[at], self.prints)]
                at = np.unique((hit[:, None] - np.arange(n - self.gram + 1)).ravel())
                at = at[(at >= 0) & (at + n <= len(own))]
            else:
                at = np.arange(max(0, len(own) - n + 1))
            at = at[own[at] == own[at + n - 1]]
            h = hashes_at(w.hashes, at, n)
            lo, hi = np.searchsorted(table, h), np.searchsorted(table, h, "right")
            for p, i, j in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                text = w.text(p, p + n)
                for k in range(i, j):
                    q = int(places[k])
                    if text == self.words.text(q, q + n):
                        yield p, p + n, int(items[k])


def hashes_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, as grams() makes them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i]
    return mix(out)


def _search(items, keep: list[str], fields: list[pa.Field]):
    schema = pa.schema([*fields, ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = items.value
        for batch, data, offsets in slices(batches, "__text"):
            w = words(data, offsets)
            own = owner(w.first)
            spans: dict[int, list] = {}
            names: dict[int, set] = {}
            for a, b, item in found.hits(w, own):
                doc = int(own[a])
                spans.setdefault(doc, []).append((a - int(w.first[doc]), b - int(w.first[doc])))
                names.setdefault(doc, set()).add(found.ids[item])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(np.diff(w.first)), pa.array([union(spans.get(i, [])) for i in range(n)], pa.list_(pa.int64())), pa.array([sorted(names.get(i, ())) for i in range(n)], pa.list_(pa.string()))], schema=schema)

    return run


def union(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching [a, b) spans joined, as a flat list a, b, a, b."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def joined(spans: str) -> Column:
    """A flat list a, b, a, b of spans in any order, those that overlap or touch joined."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), (F.size(spans) / 2).cast("int")), lambda i: F.struct(F.element_at(spans, 2 * i - 1).alias("a"), F.element_at(spans, 2 * i).alias("b"))))
    pair = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), pair(last["a"], F.greatest(last["b"], x["b"])))
        return F.when(F.size(out) == 0, pair(x["a"], x["b"])).when(x["a"] <= last["b"], grown).otherwise(F.concat(out, pair(x["a"], x["b"])))

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    flat = F.flatten(F.transform(F.aggregate(pairs, none, step), lambda x: F.array(x["a"], x["b"])))
    return F.when(F.size(spans) == 0, F.array().cast("array<bigint>")).otherwise(flat)


def find_spans(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The columns in `keep`, n_words, spans (word positions a, b, a, b of what is hit, joined), items (sorted ids)."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    # An item has at most as many fingerprints as half its bytes.
    most = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 2).first()[0]
    parts = max(1, int(-(-most // broadcast_grams)))
    fields = T.StructType([*source.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    from pyspark.sql.pandas.types import to_arrow_type

    own_fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields.fields[: len(keep)]]

    def one(part: int, over: DataFrame, names: list[str], own: list[pa.Field], schema: T.StructType) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # bounded by broadcast_grams
        shared = sc.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], span, gram))
        return over.mapInArrow(trimmed(_search(shared, names, own)), schema)

    if parts == 1:
        return one(0, source, list(keep), own_fields, fields)
    scratch = Scratch(spark)
    numbered = scratch.table(source.withColumn("__row", F.monotonically_increasing_id()))
    schema = T.StructType([T.StructField("__row", T.LongType()), *fields.fields[len(keep) :]])
    over = numbered.select("__row", "__text")
    found = [one(i, over, ["__row"], [pa.field("__row", pa.int64())], schema) for i in range(parts)]
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    every = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = every.withColumn("spans", joined("spans"))
    return numbered.drop("__text").join(every, "__row", "left").select(*keep, "n_words", "spans", "items")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of docs, all their columns, that share no window with an item."""
    text = options.get("text_col", "text")
    hidden = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text))
    found = find_spans(hidden, items, keep=("__row",), **options)
    return found.filter(F.size("items") == 0).select("__row.*")


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """find_spans()'s result as counts: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("spans")), F.lit(0).cast("long"), lambda t, i: t + F.element_at("spans", i) * F.when(i % 2 == 0, 1).otherwise(-1))
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(n_hit)
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
