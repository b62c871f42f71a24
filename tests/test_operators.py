
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe import queries as Q
from seqframe.operators import align as L
from seqframe.operators import parallel as X
from seqframe.operators.search import find_all_long
from seqframe.plans.pairs import candidate_pairs, kmer_counts
from seqframe.schema import SequenceError
from seqframe.streaming.fasta_stream import stream_fasta, windowed_bases

DNA = st.text("ACGT", min_size=1, max_size=14)


def test_known_alignments():
    a = L.align_pair("ACGTACGT", "ACGTCGT")
    assert (a.seq1_aligned, a.seq2_aligned, a.score, a.identity) == ("ACGTACGT", "ACGT-CGT", 12, 87.5)
    a = L.align_pair("ACGTACGTACGT", "TACGTAC", L.LOCAL)
    assert a.row() == ("TACGTAC", "TACGTAC", 14, 3, 10, 0, 7, 100.0)
    a = L.align_pair("ACGTACGTACGT", "TACGTAC", L.SEMI_GLOBAL)
    assert a.row()[:7] == ("ACGTACGTACGT", "---TACGTAC--", 14, 0, 10, 0, 7)
    assert L.align_pair("A", "C", L.LOCAL).row() == ("", "", 0, 0, 0, 0, 0, 0.0)
    with pytest.raises(SequenceError):
        L.align_pair("", "A")


def plain(x, y, mode, s):
    """The recurrence, cell by cell: the best score."""
    m, n = len(x), len(y)
    score, move = [[0] * (n + 1) for _ in range(m + 1)], [[3] * (n + 1) for _ in range(m + 1)]
    if mode != L.LOCAL:
        for i in range(m + 1):
            move[i][0], score[i][0] = 2, s.gap_open + (i - 1) * s.gap_extend if mode == L.GLOBAL and i else 0
        for j in range(1, n + 1):
            move[0][j], score[0][j] = 1, s.gap_open + (j - 1) * s.gap_extend if mode == L.GLOBAL else 0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d = score[i - 1][j - 1] + (s.match if x[i - 1] == y[j - 1] else s.mismatch)
            left = score[i][j - 1] + (s.gap_extend if move[i][j - 1] == 1 else s.gap_open)
            up = score[i - 1][j] + (s.gap_extend if move[i - 1][j] == 2 else s.gap_open)
            order = [(up, 2), (left, 1), (d, 0), (0, 3)] if mode == L.LOCAL else [(d, 0), (left, 1), (up, 2)]
            score[i][j], move[i][j] = max(order, key=lambda c: c[0])
    if mode == L.GLOBAL:
        return score[m][n]
    return max(map(max, score)) if mode == L.LOCAL else max(max(score[m]), max(r[n] for r in score))


@given(DNA, DNA, st.sampled_from([L.GLOBAL, L.LOCAL, L.SEMI_GLOBAL]), st.sampled_from([L.ScoringScheme(), L.ScoringScheme(1, -1, -1, -1), L.ScoringScheme(3, -2, -4, -1)]))
@settings(max_examples=150, deadline=None)
def test_alignment_properties(x, y, mode, scoring):
    a = L.align_pair(x, y, mode, scoring)
    assert a.score == plain(x, y, mode, scoring) == L.score_pair(x, y, mode, scoring)
    whole = (x, y) if mode != L.LOCAL else (x[a.seq1_start : a.seq1_end], y[a.seq2_start : a.seq2_end])
    assert (a.seq1_aligned.replace("-", ""), a.seq2_aligned.replace("-", "")) == whole and len(a.seq1_aligned) == len(a.seq2_aligned)


@given(DNA, DNA, st.sampled_from([L.GLOBAL, L.LOCAL, L.SEMI_GLOBAL]), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_alignment_from_kept_diagonals(x, y, mode, every):
    want = L.align_pair(x, y, mode).row()
    with pytest.MonkeyPatch.context() as p:
        p.setattr(L, "WHOLE_CELLS", 0)
        p.setattr(L, "_spacing", lambda m, n: every)
        assert L.align_pair(x, y, mode).row() == want


@given(st.lists(st.tuples(DNA, DNA), max_size=12), st.sampled_from([L.GLOBAL, L.LOCAL, L.SEMI_GLOBAL]))
@settings(max_examples=100, deadline=None)
def test_alignment_of_many_pairs(pairs, mode):
    """Pairs that are filled up to one length give what each gives alone."""
    alone = [L.align_pair(x, y, mode) for x, y in pairs]
    with pytest.MonkeyPatch.context() as p:
        p.setattr(L, "_groups", lambda pairs: [list(range(len(pairs)))] if pairs else [])
        assert L.align_pairs(pairs, mode) == alone
        assert L.score_pairs(pairs, mode) == [a.score for a in alone]
    assert sorted(i for group in L._groups(pairs) for i in group) == list(range(len(pairs)))


def test_alignment_of_long_pairs():
    x, y = "ACGT" * 4000, "ACGT" * 2000 + "A" + "ACGT" * 2000
    a = L.align_pair(x, y)
    assert (a.score, len(a.seq1_aligned), a.seq1_aligned.count("-"), a.seq2_aligned) == (2 * 16000 - 2, 16001, 1, y)


@pytest.mark.parametrize("mode", [L.GLOBAL, L.LOCAL, L.SEMI_GLOBAL])
def test_alignment_work_for_a_cell(mode):
    """A diagonal of many pairs is a few array operations in 16 bits, its moves two bits a cell."""
    made = random.Random(5)
    pairs = [(x, x[::-1]) for x in ("".join(made.choices("ACGTN", k=400)) for _ in range(40))]
    sweep = L._Sweep([x for x, _ in pairs], [y for _, y in pairs], mode, L.ScoringScheme())
    moves = L._Moves(sweep)
    ends = L._forward(sweep, None, moves)
    assert sweep.score.dtype == np.int16 and sum(block.nbytes for _, block in moves.blocks) <= 0.3 * 40 * 400 * 400
    assert [x[0] for x in ends[:2]] == [plain(x, y, mode, L.ScoringScheme()) for x, y in pairs[:2]]


@pytest.mark.parametrize("length, kind", [(16_000, np.int16), (17_000, np.int32)])
def test_alignment_scores_fit_their_type(length, kind):
    """The highest and the lowest score of a pair of that length: no character equal to any, and all."""
    assert L._Sweep(["A" * length], ["C" * length], L.GLOBAL, L.ScoringScheme()).kind is kind
    assert L.score_pair("A" * length, "A" * length) == 2 * length and L.score_pair("A" * length, "C" * length) == -length
    a = L.align_pair("A" * length, "C", L.GLOBAL)
    assert a.score == -1 - 2 - (length - 2) and len(a.seq1_aligned) == length


def test_alignment_queries_read_whole_sequences(spark, tmp_path):
    s = "ACGT" * 15 + "GGATTACA" * 9
    spark.createDataFrame([(1, s, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for mode in (L.GLOBAL, L.LOCAL, L.SEMI_GLOBAL):
        got = Q.QUERIES[f"align_{mode}"](spark, str(tmp_path)).drop("doc_id").first()
        assert tuple(got) == L.align_pair(s, s[::-1], mode).row() and got["score"] == plain(s, s[::-1], mode, L.ScoringScheme())
    assert Q.QUERIES["align_score"](spark, str(tmp_path)).first()["score"] == plain(s, s[::-1], L.GLOBAL, L.ScoringScheme())
    row = list(range(len(s) + 1))
    for c in s:
        old, row = row, [row[0] + 1]
        for j, e in enumerate(reversed(s)):
            row.append(min(old[j] + (c != e), old[j + 1] + 1, row[j] + 1))
    assert Q.QUERIES["edit_distance"](spark, str(tmp_path)).first()["result"] == row[-1]


def test_format():
    assert L.align_pair("ACGTACGT", "ACGTCGT").format().startswith("Score: 12\nIdentity: 87.50%\nSeq1: 0..8\nSeq2: 0..7\n\nSeq1: ACGTACGT\n      |||| |||\nSeq2: ACGT-CGT\n")


def test_alignment_columns(spark):
    df = spark.createDataFrame([("ACGTACGT", "ACGTCGT"), (None, "A")], "a string, b string")
    rows = df.select(L.needleman_wunsch("a", "b").alias("x"), L.align_score("a", "b").alias("s"), L.edit_distance("a", "b").alias("d")).collect()
    assert rows[0]["x"]["score"] == rows[0]["s"] == 12 and rows[0]["d"] == 1 and rows[1]["x"] is None and rows[1]["s"] is None
    shown = df.limit(1).select(L.needleman_wunsch("a", "b").alias("x")).select(L.format_alignment("x").alias("f"), L.alignment_identity(F.col("x.seq1_aligned"), F.col("x.seq2_aligned")).alias("i")).first()
    assert shown["f"].startswith("Score: 12") and shown["i"] == 87.5
    pairs = spark.createDataFrame([("ACGT", x) for x in ("ACGT", "ACGTA", "ACG", "ACTT", "", "TGCA")], "a string, b string")
    assert [r[0] for r in pairs.select(L.edit_distance("a", "b")).collect()] == [0, 1, 1, 1, 4, 4]


def test_maps(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("ordinal"), F.col("id").cast("int").alias("x"))
    assert [r["y"] for r in X.map_items(df, lambda x: 2 * x, "x", "y", "int").orderBy("ordinal").collect()] == [2 * i for i in range(1, 1001)]

    def positive(x):
        if x < 0:
            raise ValueError("negative")
        return x

    with pytest.raises(Exception, match="negative"):
        X.map_items(spark.createDataFrame([(1,), (-4,)], "x int"), positive, "x", "y", "int").collect()
    chunks = spark.createDataFrame([(c, i, 3 * c + i + 1) for c in range(4) for i in range(3)], "c int, i int, x int")
    assert sorted((r[0], r[1]) for r in X.map_chunks(chunks, sum, "c", "x", "i", "int").collect()) == [(0, 6), (1, 15), (2, 24), (3, 33)]
    assert X.for_each(df, positive, "x") == 1.0 and 0 <= X.progress(spark) <= 1
    assert X.calculate_chunk_size(10) == 1024 and X.calculate_chunk_size(10, 1500) == 2048 and X.calculate_chunk_size(1 << 20, threads=8) == 1 << 15


def test_chunks_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ABCDEFG"), (2, "")], "id int, s string")
    assert [r[0] for r in df.orderBy("id").select(X.chunk_slice(F.col("s"), 3)).collect()] == [["ABC", "DEF", "G"], []]
    joined = X.split_join(df, "id", X.chunk_slice(F.col("s"), 2), F.lower, lambda p: F.array_join(p, "-"))
    assert [tuple(r) for r in joined.collect()] == [(1, "ab-cd-ef-g")]
    (tmp_path / "f").write_bytes(b"x" * 5000)
    got = X.process_file(spark, str(tmp_path / "f"), len, "int", min_chunk=2000).orderBy("start").collect()
    assert [(r["start"], r["result"]) for r in got] == [(0, 2048), (2048, 2048), (4096, 904)]


def test_long_search_and_pairs(spark):
    df = spark.createDataFrame([(1, "AAAA" * 5), (2, "ACGTACGTAC"), (3, "")], "id int, s string")
    for piece in (3, 7, 1000):
        got = sorted(tuple(r) for r in find_all_long(df, "id", "s", "AAA", piece, 3).collect())
        assert got == [(1, i) for i in range(18)]
    assert {tuple(r) for r in kmer_counts(df, "s", 4).collect()} == {("AAAA", 17), ("ACGT", 2), ("CGTA", 2), ("GTAC", 2), ("TACG", 1)}
    other = spark.createDataFrame([(9, "TTACGTACGG")], "id int, s string")
    assert [tuple(r) for r in candidate_pairs(df, other, "id", "s", 4, 2).collect()] == [(2, 9, 4)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a x\nACGT\n>b\nGG\n")
    q = stream_fasta(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fa").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("fa").collect()} == {("a", "x", "ACGT"), ("b", None, "GG")}
    rows = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", "ACGT") for i in range(7)], "t string, s string").select(F.to_timestamp("t").alias("ts"), "s")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = windowed_bases(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "ts", "s").writeStream.outputMode("complete").format("memory").queryName("wb").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["a"] for r in spark.table("wb").collect()) == [2, 5]
