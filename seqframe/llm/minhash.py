"""Near-duplicate classes by DartMinHash, banded joins and exact confirmation.

A document is the multiset of its runs of five words (fewer words: one run). Its signature follows DartMinHash: each
element owns a strip as wide as its weight; darts are thrown by hash into the strip's regions, dyadic in weight and in
rank, a Poisson number in each; each dart has a coordinate, and each coordinate keeps the dart of the least rank. Darts are
the same for the same element in any document, so two signatures agree in a coordinate with the probability of their
weighted Jaccard similarity. Regions of higher rank are opened only for documents with coordinates still empty.

Signatures are cut into BANDS bands of ROWS coordinates; documents that agree in a band are candidates. At similarity 0.8
a pair is missed with probability (1 - 0.8**5)**25 = 5e-5; at less it would not count. Candidates are confirmed by exact
weighted Jaccard similarity of at least THRESHOLD, and classes are the connected components of confirmed pairs.

Texts with the same words are one node from the start. In each band's bucket the pairs of all are never made. Before all else
each text is compared with two leaders of the largest bucket that it is in, and of that one only: which makes one component of most
of a large group at a few pairs a text, not at as many for each band. Then rounds choose leaders (those alone in their component first, then those with most company in their bands; up to two in the first round, sixteen times
as many each time), compare those with the members that have not led and are in other components, and go on only with buckets whose
members that have not led are of two components or more. A bucket is finished when each of its pairs is in one component or was
compared, so no link is lost between two components. Left out are only pairs that cannot reach the threshold: of a text's weight,
the elements that no other candidate has are shared with none, which bounds each pair's similarity; and in crowded buckets a pair must share
one of its rarest elements (a prefix filter, exact). Leaders are chosen by salted aggregation.

Defined cases: texts without words are a class with exactly equal texts only; null is the empty text. Rows with the same
doc_id count as they are, each with the class of its text. class_id is the least doc_id of the class; null ids are ignored
there, and a class of null ids only has a null class_id. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, mix, slices, trimmed
from .components import components
from .words import Words, grams, owner, words

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
FIRST_LEADERS, MORE_LEADERS = 2, 16
CARRIED = ("share", "main", "weight", "alone", "rare")
CROWD, MAX_RARE, MAX_COMMON, MAX_MANY = 64, 128, 200_000, 10_000
KNOWN = 64  # texts of which a worker keeps the elements
_FIRST = -6  # the first region of ranks is [0, 2**_FIRST), the following ones double
_LAST = 40
_cdfs: dict[float, np.ndarray] = {}


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """The Poisson quantile of each u in [0, 1)."""
    if mean not in _cdfs:
        top = int(mean + 12 * mean**0.5 + 24)
        steps = np.log(mean) - np.log(np.arange(1, top + 1))
        _cdfs[mean] = np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(steps)]) - mean))
    return np.searchsorted(_cdfs[mean], u, "right")


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element hash and weight, in order of the two first."""
    own, counts = owner(w.first), np.diff(w.first)
    g = grams(w.hashes, n)
    whole = own[: len(g)] == own[n - 1 :] if len(g) else np.zeros(0, bool)
    texts, hashes = own[: len(g)][whole], g[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        few = [int(grams(w.hashes[w.first[i] : w.first[i + 1]], int(counts[i]))[0]) for i in short]
        texts, hashes = np.concatenate([texts, short]), np.concatenate([hashes, np.array(few, np.uint64)])
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return texts[at], hashes[at], np.diff(np.append(at, len(texts)))


def signatures(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """n_texts x k; a text without elements keeps zeros."""
    rank = np.full(n_texts * k, np.inf)
    mark = np.zeros(n_texts * k, np.uint64)
    lo = 0.0
    for step in range(_FIRST, _LAST):
        if not len(texts):
            break
        hi = 2.0**step
        left, width, part = 0, 1, np.arange(len(texts))
        level = 0
        while len(part):
            cell = mix(hashes[part] + np.uint64(((step - _FIRST + 1) * 0x9E3779B97F4A7C15 + (level + 1) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
            n = poisson(_unit(cell), width * (hi - lo))
            some = np.flatnonzero(n)
            n = n[some]
            where = np.repeat(some, n)
            turn = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(cell[where] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            if level:  # a region wider than the strip: darts beyond the weight miss
                inside = left + width * _unit(mix(dart ^ np.uint64(0xA5A5A5A55A5A5A5A))) < weights[part[where]]
                where, dart = where[inside], dart[inside]
            ranks = lo + (hi - lo) * _unit(dart)
            dart = mix(dart + np.uint64(0x632BE59BD9B4E019))
            at = texts[part[where]] * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(rank, at, ranks)
            won = ranks == rank[at]
            mark[at[won]] = dart[won]
            left, width, level = (1, 1, 1) if level == 0 else (left + width, 2 * width, level + 1)
            part = part[weights[part] > left]
        lo = hi
        open_texts = np.isinf(rank.reshape(n_texts, k)).any(axis=1)
        go = open_texts[texts]
        texts, hashes, weights = texts[go], hashes[go], weights[go]
    return mark.reshape(n_texts, k)


def bands(marks: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(marks), n_bands), np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + marks[:, r::rows][:, :n_bands])
    return out.view(np.int64)


def nodes_of(w: Words, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 16-byte name for each text's sequence of words, or for its bytes if it has none."""
    out = []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            out.append(xxhash.xxh3_128_digest(w.hashes[a:b].tobytes()))
        else:
            out.append(xxhash.xxh3_128_digest(b"\0" + data[offsets[i] : offsets[i + 1]].tobytes()))
    return out


def _sketch(n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            w = words(data, offsets)
            keys = bands(signatures(*elements(w), batch.num_rows, n_bands * rows), n_bands, rows)
            has = np.diff(w.first) > 0
            bounds = np.concatenate([[0], np.cumsum(has * n_bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(nodes_of(w, data, offsets), pa.binary()), lists], ["doc_id", "node", "bands"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        w = words(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(nodes_of(w, data, offsets), pa.binary()), column(batch, "text")], ["node", "text"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        texts, hashes, weights = elements(words(data, offsets))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), column(batch, "node").take(pa.array(texts)), pa.array(weights)], ["element", "node", "weight"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        texts, _, weights = elements(words(data, offsets))
        total = np.bincount(texts, weights, batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(total)], ["node", "weight"])


def _rarest(share: DataFrame, texts: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """node, rare: of nodes in buckets of CROWD or more, the elements in order of rarity, as far as the prefix filter needs them.

    Two multisets of similarity t share an element among the first |x| - a + 1 of x and the first |y| - a + 1 of y, where
    a = t / (1 + t) (|x| + |y|), in any one order of elements; here those that few texts have come first. So in a crowd, pairs without
    one in common are not compared. Any order is exact, so that it is enough to put last the MAX_COMMON elements that most texts have
    (they are sent to the workers, some MB at any size), and the others in order of their hashes. Elements are kept as 32-bit hashes,
    which can only let a pair through. Texts that need more than MAX_RARE are left to be compared.
    """
    crowd = share.filter(F.col("most") >= CROWD).select("node")
    common = parts.groupBy("element").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD // 2).orderBy(F.desc("n"), "element").limit(MAX_COMMON).select("element").collect()
    shared = share.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in common], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            owners, hashes, times = elements(words(data, offsets))
            late = np.isin(hashes.view(np.int64), shared.value)
            order = np.lexsort((hashes, late, owners))
            hashes, times, owners = hashes[order], times[order], owners[order]
            bounds = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            out = []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                keep = int((1 - threshold) * int(times[i:j].sum()) + 1e-9) + 1
                if keep > MAX_RARE:
                    out.append(None)
                    continue
                n = times[i:j]
                copies = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out.append((mix(np.repeat(hashes[i:j], n) + copies.astype(np.uint64)) >> np.uint64(33)).astype(np.int32)[:keep].tolist())
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(out, pa.list_(pa.int32()))], ["node", "rare"])

    return texts.join(crowd, "node", "left_semi").mapInArrow(trimmed(run), "node binary, rare array<int>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ordered distinct hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _confirm(threshold: float):
    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return elements(words(raw, np.array([0, len(raw)])))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}

        def held(node: bytes, text: str) -> tuple:
            if node not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[node] = of(text)
            return known[node]

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows = [column(batch, c).to_pylist() for c in ("u", "v", "text_u", "text_v")]
                good = pa.array([similarity(held(u, text_u), held(v, text_v)) >= threshold for u, v, text_u, text_v in zip(*rows, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(good) for c in ("cu", "cv")], ["u", "v"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sketched = scratch.table(source.mapInArrow(trimmed(_sketch(n_bands, rows)), f"doc_id {kind}, node binary, bands array<bigint>"))
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes)
    at = nodes.select("node", F.explode("bands").alias("band"))
    shared = at.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    members = scratch.table(at.join(shared, "band"))
    share = scratch.table(members.groupBy("node").agg(F.sum("n").alias("share"), F.max("n").alias("most"), F.max(F.struct("n", "band"))["band"].alias("main")))
    # Texts of the candidates, once for each node; shuffled at every size.
    texts = source.mapInArrow(trimmed(_named), "node binary, text string").join(share.select("node").hint("merge"), "node", "left_semi")
    texts = scratch.table(texts.groupBy("node").agg(F.min("text").alias("text")))
    # What of a node no other candidate has bounds its similarity to any of them: the weight alone, from counts of elements.
    parts = texts.mapInArrow(trimmed(_exploded), "element bigint, node binary, weight bigint")
    own = parts.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.sum("weight").alias("weight")).filter("n = 1")
    own = own.groupBy("node").agg(F.sum("weight").alias("alone"))
    weights = texts.mapInArrow(trimmed(_weighed), "node binary, weight bigint").join(own, "node", "left").select("node", "weight", F.coalesce("alone", F.lit(0)).alias("alone"))
    # Nodes whose own part is too large have no link at all.
    share = share.join(weights, "node").filter(F.col("weight") - F.col("alone") >= threshold * F.col("weight") - 1e-9)
    share = share.join(_rarest(share, texts, parts, threshold), "node", "left")
    members = members.select("band", "node").join(share, "node").select("band", "node", *CARRIED, F.col("node").alias("comp"), F.lit(False).alias("led"))
    members = scratch.table(members)
    labels, lead, opening = None, FIRST_LEADERS, True
    while members.limit(1).count():
        slot = F.pmod(F.xxhash64("node"), F.lit(lead)).alias("slot")
        free = members.filter(~F.col("led"))
        leaders = free.groupBy("band", slot).agg(F.max(F.struct((F.col("comp") == F.col("node")).alias("single"), "share", "node", "comp", "weight", "alone", "rare")).alias("l"))
        leaders = leaders.select(F.col("band").alias("band_u"), F.col("l.node").alias("u"), F.col("l.comp").alias("comp_u"), F.col("l.weight").alias("weight_u"), F.col("l.alone").alias("alone_u"), F.col("l.rare").alias("rare_u"))
        most = F.least(F.col("weight") - F.col("alone"), F.col("weight_u") - F.col("alone_u"))  # they share no more
        able = most >= threshold * (F.col("weight") + F.col("weight_u") - most) - 1e-9
        need = F.ceil(threshold / (1 + threshold) * (F.col("weight") + F.col("weight_u")) - 1e-9).cast("int")
        first = lambda rare, weight: F.slice(rare, 1, F.greatest(weight.cast("int") - need + 1, F.lit(0)))
        able &= F.coalesce(F.arrays_overlap(first(F.col("rare"), F.col("weight")), first(F.col("rare_u"), F.col("weight_u"))), F.lit(True))
        met = free.filter(F.col("band") == F.col("main")) if opening else free
        pairs = met.join(leaders, (F.col("band") == F.col("band_u")) & (F.col("node") != F.col("u")) & (F.col("comp") != F.col("comp_u")) & able)
        ends = F.array_sort(F.array(F.struct(F.col("node").alias("n"), F.col("comp").alias("c")), F.struct(F.col("u").alias("n"), F.col("comp_u").alias("c"))))
        pairs = pairs.select(ends.alias("e")).distinct().select(F.col("e")[0]["n"].alias("u"), F.col("e")[1]["n"].alias("v"), F.col("e")[0]["c"].alias("cu"), F.col("e")[1]["c"].alias("cv"))
        found = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        found = found.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
        edges = scratch.table(found.select("u", "v", "cu", "cv", "text_u", "text_v").mapInArrow(trimmed(_confirm(threshold)), "u binary, v binary").distinct())
        if edges.limit(1).count():
            merged = components(edges, scratch)
            step = merged.select(F.col("u").alias("comp"), "root")
            new = merged.select(F.col("u").alias("node"), F.col("root").alias("comp"))
            if labels is not None:
                new = labels.join(step, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")).union(new.join(labels, "node", "left_anti"))
            labels = scratch.table(new)
            members = members.join(step, "comp", "left").withColumn("comp", F.coalesce("root", "comp"))
        if not opening:  # leaders have met all members of their buckets
            members = members.join(leaders.select(F.col("band_u").alias("band"), F.col("u").alias("node"), F.lit(True).alias("now")), ["band", "node"], "left")
            members = members.select("band", "node", *CARRIED, "comp", (F.col("led") | F.coalesce("now", F.lit(False))).alias("led"))
            lead *= MORE_LEADERS
        members, opening = scratch.table(members.select("band", "node", *CARRIED, "comp", "led")), False
        alive = members.filter(~F.col("led")).groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
        alive = alive.filter(F.col("a") != F.col("b")).select("band")
        members = scratch.table(members.join(alive, "band", "left_semi"))
    if labels is None:
        named = nodes.select("node", F.col("id").alias("class_id"))
    else:
        own = nodes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
        own = scratch.table(own)
        named = own.join(own.groupBy("comp").agg(F.min("id").alias("class_id")), "comp").select("node", "class_id")
    # Texts with most copies are joined by broadcast, so that copies of one text are no task of their own.
    many = F.broadcast(nodes.filter(F.col("copies") >= CROWD).orderBy(F.desc("copies"), "node").limit(MAX_MANY).select("node"))
    rows = sketched.select("doc_id", "node")
    of_many = rows.join(F.broadcast(named.join(many, "node", "left_semi")), "node")
    of_few = rows.join(many, "node", "left_anti").join(named, "node")
    return of_many.select(F.col("doc_id").alias(id_col), "class_id").union(of_few.select("doc_id", "class_id"))


def keep_one(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """One row of docs of each class: that with the least doc_id, nulls last, and of several such the first as they are numbered here."""
    numbered = Scratch(docs.sparkSession).table(docs.withColumn("__row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    found = classes(numbered.select(place.alias("__place"), text_col), id_col="__place", text_col=text_col, **options)
    gone = found.filter(F.col("__place.row") != F.col("class_id.row")).select(F.col("__place.row").alias("__row"))
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
