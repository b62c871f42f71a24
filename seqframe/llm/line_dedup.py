"""Line dedup with sharded cuckoo filters over exact reference counts; reversible.

A line's key is the line without [\\x20\\x09-\\x0D] at either end, A-Z lower-cased. A key of at least MIN_CHARS code
points that is found in at least MIN_DOCS documents loses all its lines, except in the largest doc_id that holds it.

The state of an index is a log of postings (key, doc_id) and of deleted ids, which are the exact reference counts, the keys
that are held often enough with their counts, and shards (shard, blob), cuckoo filters over those keys. A shard is a range of
hash values, with about SHARD_KEYS keys; no key is in it twice, so a frequent line weighs no more than any other. Inserting
documents adds their postings to the log, deleting documents their ids; only keys of these documents are counted again, and
those whose count passes MIN_DOCS either way are inserted into or deleted from the filter of their shard. An index after
a deletion equals one that never saw the documents.

Lines are first probed in the filters, which rejects nearly all that are not repeated; what passes is confirmed in an
exact join with the counts. While the filters take at most BROADCAST_BYTES they are sent to the workers; beyond it lines
and filters are dealt by shard and salt (each filter to SALTS places) and a worker holds the one filter whose lines it
streams. Counting combines before the shuffle.

Defined cases: a null or empty text is one empty line, and comes back as an empty text. Rows with the same doc_id are
one document when counting; each is returned. Rows with a null doc_id are counted as no document and are never the
largest. A key twice in the kept document keeps both lines. Empty tables give empty results. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACES, Scratch, column, trimmed
from .cuckoo import CuckooFilter, Full

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, SALTS = 100_000, 8
BROADCAST_BYTES = 32 << 20
_STRIP = SPACES.encode()


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line's 16-byte key, or None if it is too short to be judged."""
    line = line.strip(_STRIP)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())  # bytes.lower() touches A-Z only


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key, doc_id: each key once for each row that holds it."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, ids = [], []
                for doc, text in zip(column(part, "doc_id").to_pylist(), _texts(part, "__text"), strict=True):
                    if len(text) >= min_chars:
                        held = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := key_of(line, min_chars))}
                        keys += held
                        ids += [doc] * len(held)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return rows.mapInArrow(trimmed(run), "key binary, doc_id long")


def counts(held: DataFrame) -> DataFrame:
    """key, n (documents), last (largest doc_id). A row repeated by id counts once."""
    once = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def shard_of(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _hash64(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 0] if keys else np.zeros(0, np.uint64)


def build_shards(hot: DataFrame, shards: int) -> DataFrame:
    """shard, blob: a filter for the keys of each shard."""

    def build(pdf):
        import pandas as pd

        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [CuckooFilter.of(_hash64(list(pdf["key"]))).to_bytes()]})

    return hot.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, blob binary")


def change_shards(blobs: DataFrame, gone: DataFrame, come: DataFrame, every: DataFrame, shards: int) -> DataFrame:
    """The filters after keys have gone and come; a filter that fills up is built anew from all its keys (`every`)."""
    moved = gone.select("key", F.lit(-1).alias("step")).union(come.select("key", F.lit(1).alias("step"))).union(every.select("key", F.lit(0).alias("step")))

    def change(k, left, right):
        import pandas as pd

        keys = {s: _hash64(list(right["key"][right["step"] == s])) for s in (-1, 0, 1)}
        if not len(keys[0]):
            return pd.DataFrame({"shard": [], "blob": []})
        try:
            if not len(left):
                raise Full
            (held := CuckooFilter.from_bytes(left["blob"].iloc[0])).delete(keys[-1])
            held.insert(keys[1])
        except Full:
            held = CuckooFilter.of(keys[0])
        return pd.DataFrame({"shard": [int(k[0])], "blob": [held.to_bytes()]})

    return blobs.groupBy("shard").cogroup(moved.select(shard_of("key", shards).alias("shard"), "key", "step").groupBy("shard")).applyInPandas(change, "shard int, blob binary")


def _probe_by_shard(held: DataFrame, blobs: DataFrame, shards: int) -> DataFrame:
    """key, doc_id of the lines that their shard's filter lets pass; a task streams lines and holds one filter."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    lines = held.select(shard_of("key", shards).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("blob"), "key", "doc_id")
    filters = blobs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "blob", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    both = filters.union(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            names = list(zip(column(batch, "shard").to_pylist(), column(batch, "salt").to_pylist(), strict=True))
            blobs, cut = column(batch, "blob"), [*np.flatnonzero(np.asarray(column(batch, "blob").is_valid())).tolist(), batch.num_rows]
            at = 0
            for to in cut:  # the lines before the next filter
                if to > at and name == names[at]:  # else they are lines of a shard that has no filter
                    part = batch.slice(at, to - at)
                    mine = np.array([x == name for x in names[at:to]])
                    mine[mine] = held.contains(_hash64(column(part, "key").filter(pa.array(mine)).to_pylist()))
                    yield part.filter(pa.array(mine)).select(["key", "doc_id"])
                if to < batch.num_rows:
                    name, held = names[to], CuckooFilter.from_bytes(blobs[to].as_py())
                at = to + 1

    return both.mapInArrow(trimmed(probe), "key binary, doc_id long")


class LineIndex:
    """The log of postings, the keys held often (key, n, last) and their sharded filters, all in tables of the shared folder."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS):
        self.scratch, self.min_chars, self.min_docs, self.shard_keys = Scratch(spark), min_chars, min_docs, shard_keys
        self.log: list[tuple[bool, DataFrame]] = []  # (True, postings) or (False, ids), in the order in which they came
        self.hot = self.blobs = None
        self.shards = 0

    @property
    def held(self) -> DataFrame:
        """The postings of all documents that are not deleted; one that was inserted twice may be there twice."""
        out = self.log[0][1]
        for added, change in self.log[1:]:
            out = out.union(change) if added else out.join(change, "doc_id", "left_anti").select("key", "doc_id")
        return out

    def _recount(self, held: DataFrame, keys: DataFrame | None = None) -> None:
        """Count anew: all keys, or those given."""
        old = self.hot
        if old is None or keys is None:
            hot = counts(held).filter(F.col("n") >= self.min_docs)
        else:
            hot = counts(held.join(keys, "key", "left_semi")).filter(F.col("n") >= self.min_docs).union(old.join(keys, "key", "left_anti"))
        self.hot = self.scratch.table(hot)
        shards = max(1, -(-self.hot.count() // self.shard_keys))
        if old is None or not 0.5 * self.shards <= shards <= 2 * self.shards:
            self.shards = shards
            self.blobs = self.scratch.table(build_shards(self.hot, shards))
        else:
            gone, come = old.join(self.hot, "key", "left_anti"), self.hot.join(old, "key", "left_anti")
            self.blobs = self.scratch.table(change_shards(self.blobs, gone, come, self.hot, self.shards))

    @classmethod
    def count_only(cls, docs: DataFrame, **options) -> LineIndex:
        """An index for one pass over docs: counts and filters, without postings to be kept for later changes."""
        made = cls(docs.sparkSession, **options)
        made._recount(postings(docs, min_chars=made.min_chars))
        return made

    def insert(self, docs: DataFrame) -> None:
        more = self.scratch.table(postings(docs, min_chars=self.min_chars).distinct())
        self.log.append((True, more))
        self._recount(self.held, more.select("key").distinct())

    def delete(self, ids: DataFrame) -> None:
        """Forget the documents with the ids in the column doc_id; an index that holds none stays as it is."""
        if not self.log:
            return
        ids = self.scratch.table(ids.select("doc_id").distinct())
        keys = self.scratch.table(self.held.join(ids, "doc_id", "left_semi").select("key").distinct())
        self.log.append((False, ids))
        self._recount(self.held, keys)

    def _candidates(self, docs: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
        """key, doc_id of the lines that the filters let pass."""
        spark = docs.sparkSession
        held = postings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_chars=self.min_chars)
        size = self.blobs.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
        if size > broadcast_bytes:
            return _probe_by_shard(held, self.blobs, self.shards)
        shared, shards = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in self.blobs.collect()}), self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.from_bytes(b) for k, b in shared.value.items()}
            for batch in batches:
                found = np.zeros(batch.num_rows, bool)
                hashes, shard = _hash64(column(batch, "key").to_pylist()), np.asarray(column(batch, "shard"))
                for k, f in filters.items():
                    at = np.flatnonzero(shard == k) if shards > 1 else np.arange(len(shard))
                    found[at] = f.contains(hashes[at])
                yield batch.filter(pa.array(found)).select(["key", "doc_id"])

        return held.withColumn("shard", shard_of("key", shards)).mapInArrow(trimmed(probe), "key binary, doc_id long")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """docs with the lines gone from text_col, and the columns n_lines and n_dropped (in place of any of these names)."""
        docs = docs.drop("n_lines", "n_dropped")
        lost = self._candidates(docs, id_col, text_col, broadcast_bytes).join(self.hot, "key").filter(F.col("doc_id") != F.col("last"))
        lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("__keys")).withColumnRenamed("doc_id", "__id")
        joined = docs.filter(F.col(id_col).isNotNull()).join(lost, F.col(id_col).cast("long") == F.col("__id"), "left").select(*docs.columns, "__keys")
        # Rows without an id lose every line of a frequent key; their keys have to be found in the text again.
        nameless = docs.filter(F.col(id_col).isNull())
        if nameless.limit(1).count():
            own = postings(nameless.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text")), min_chars=self.min_chars)
            own = own.distinct().join(self.hot.select("key"), "key", "left_semi").groupBy(F.col("doc_id").alias("__own")).agg(F.collect_set("key").alias("__keys"))
            joined = joined.union(nameless.join(own, F.xxhash64(text_col) == F.col("__own"), "left").select(*docs.columns, "__keys"))
        return _strip(joined, docs.schema, text_col, self.min_chars)


def _strip(joined: DataFrame, schema: T.StructType, text_col: str, min_chars: int) -> DataFrame:
    out = T.StructType([*schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(out)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(_texts(batch, text_col), column(batch, "__keys").to_pylist(), strict=True):
                    n = text.count(b"\n") + 1
                    n_lines.append(n)
                    if keys:
                        keys = set(keys)
                        kept = [line for line in text.split(b"\n") if len(line) < min_chars or key_of(line, min_chars) not in keys]
                        n_dropped.append(n - len(kept))
                        texts.append(b"\n".join(kept).decode())
                    else:
                        n_dropped.append(0)
                        texts.append(text.decode())
                made = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else column(batch, f.name) for f in arrow], schema=arrow)

    return joined.select(*names, "__keys").mapInArrow(trimmed(run), out)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that repeat among them, their columns and n_lines, n_dropped."""
    return LineIndex.count_only(docs, **options).apply(docs)
