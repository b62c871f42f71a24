"""What the driver runs: each query and the pipeline over the smallest tables, against SQL or a brute-force version."""

import hashlib
import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_classes, brute_hits, brute_lines, brute_substrings, key

import __spark_entry__ as entry
import corpus_pipeline
from seqframe.llm import license_scan, quality_cnn, queries
from seqframe.llm.common import read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, name, *columns):
    return [tuple(r) for r in read(spark, SF, name).select(*columns).collect()]


def result(query, *columns):
    return sorted((tuple(r) for r in query.select(*columns).collect()), key=key)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert result(got, *want.columns) == sorted(want.fetchall(), key=key)


def test_entry_registers_all():
    names = {n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert {int(re.match(r"op(\d+)", n)[1]) for n in names} == set(range(1, 11)) and "pipeline" in entry.queries()
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def plain_score(net, text):
    """The network's score of one text, window by window."""
    raw = text.encode()
    n = max(1, -(-(len(raw) - quality_cnn.WIDTH + quality_cnn.STEP) // quality_cnn.STEP))
    peaks = []
    for a in range(0, n, quality_cnn.WINDOWS):
        found = []
        for k in range(a, min(n, a + quality_cnn.WINDOWS)):
            part = raw[k * quality_cnn.STEP : k * quality_cnn.STEP + quality_cnn.WIDTH].ljust(quality_cnn.WIDTH, b"\0")
            found.append(sum(net.tables[j][c].astype(float) for j, c in enumerate(part)) + net.bias)
        peaks.append(np.maximum(np.max(found, axis=0), 0))
    both = np.concatenate([np.max(peaks, axis=0), np.mean(peaks, axis=0)])
    return 1 / (1 + np.exp(-(both @ net.weights + net.offset)))


def test_op1(spark):
    net = quality_cnn.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in queries.op1_quality_cnn(spark, SF).collect()}
    texts = table(spark, "documents", "doc_id", "text")
    assert len(got) == len(texts)
    for i, text in sorted(texts, key=lambda r: len(r[1] or ""))[:150]:
        assert abs(got[i]["score"] - plain_score(net, text or "")) < 1e-4
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_op1_edges(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "x" * 100_000), (None, "y")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (3, 1), (1, 1), (None, 0)], "doc_id long, quality int")):
        got = quality_cnn.classify(rows, labels).collect()
        assert len(got) == 5 and len({r["score"] for r in got}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("good words here")).otherwise(F.lit("#### $$$$ ####")).alias("text"))
    labels = many.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    few = quality_cnn.fit(many, labels, sample=20)  # more rows than are learned from
    got = quality_cnn.score(many, few).join(labels, "doc_id").filter("predicted <> quality").count()
    assert got == 0
    assert not quality_cnn.fit(many, labels, sample_bytes=1).tables.any()  # one text, one label: a constant


def test_op2(spark):
    """What the query gives is what the scan finds in each whole text on its own; planted lines are all found."""
    texts = table(spark, "documents", "doc_id", "text")
    got = {r["doc_id"]: r for r in queries.op2_license_scan(spark, SF).collect()}
    assert set(got) == {i for i, _ in texts}
    for i, text in texts:
        if re.search(r"(?i)licensed under the (mit|apache) license|GNU General Public License", text or ""):
            assert got[i]["n_found"] > 0
    one = license_scan.scan(spark.createDataFrame([(i, t) for i, t in texts[:20]], "doc_id long, text string")).collect()
    assert {r["doc_id"]: len(r["found"]) for r in one} == {i: got[i]["n_found"] for i, _ in texts[:20]}


def test_op4(spark):
    rows = table(spark, "documents", "doc_id", "text")
    assert result(queries.op4_minhash(spark, SF), "doc_id", "class_id") == sorted(brute_classes(rows), key=key)


def tokens(texts):
    import base64

    import tiktoken

    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for text in texts:
        ids = encode(text or "")
        yield len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op5(spark):
    rows = table(spark, "documents", "doc_id", "text")
    want = sorted(((i, *t) for (i, _), t in zip(rows, tokens(t for _, t in rows), strict=True)), key=key)
    assert result(queries.op5_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op7(spark):
    got = queries.op7_quality_rules(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got.count() == len(table(spark, "documents", "doc_id")) and got.filter("base_failed AND kept").count() == 0


def test_op8(spark):
    """Against a reading of <article> by rule, which these pages all have."""
    want = []
    for i, url, page in table(spark, "pages", "page_id", "url", "html"):
        article = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"<(?!/?(?:b|i|em|a|span|strong|br)\b)[^>]*>", article[1]) if article else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        text = "\n".join(t for t in texts if t)
        want.append((i, url, text, len(text)))
    assert result(queries.op8_html_extract(spark, SF), "page_id", "url", "text", "n_chars") == sorted(want, key=key)


def test_op10(spark):
    rows = table(spark, "documents", "doc_id", "text")
    want = sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_substrings(rows)), key=key)
    assert result(queries.op10_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def brute_pipeline(spark, docs, sf_dir):
    """The stages after the classifier, one after the other, in plain Python."""
    rows = {r["doc_id"]: r for r in corpus_pipeline.quality_classifier(spark, docs, sf_dir).collect()}
    texts = [(i, text) for i, text, _, _ in brute_lines([(i, r["text"]) for i, r in rows.items()])]
    texts = [(i, t) for (i, t), (_, c) in zip(texts, brute_classes(texts), strict=True) if c == i]
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    texts = [(i, t) for (i, t), hit in zip(texts, brute_hits(texts, items), strict=True) if not hit[-1]]
    return sorted(((i, rows[i]["lang"], rows[i]["source"], *t) for (i, _), t in zip(texts, tokens(t for _, t in texts), strict=True)), key=key)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    want = brute_pipeline(spark, read(spark, SF, "documents"), SF)
    assert 0 < len(want) and result(got, "doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows; then nothing at all."""
    text = " ".join(f"word{i} of this" for i in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, __lang2 string"
    rows = [(1, text, "en", "s", 1, 1.0, "k", "x"), (1, text, "en", "s", 1, 1.0, "k", "x"), (None, text + " more", None, None, None, None, None, None), (2, None, "en", None, None, None, None, None), (3, "", "en", "s", 0, 0.0, "", "")]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in got if r["doc_id"] is not None) in ([(1, True), (2, False)], [(1, True), (3, False)])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    stage = read(spark, f"{tmp_path}/full", "documents")
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, f"{tmp_path}/full")
        assert stage.columns == schema.replace(",", "").split()[::2]
