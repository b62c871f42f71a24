import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe.functions import alphabet as A
from seqframe.functions import metadata as M
from seqframe.functions import packing as P
from seqframe.functions import sequence as S


def one(spark, value, **columns):
    columns = columns or {"x": "x"}
    types = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<int>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], types).select(value.alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [("ACGTACGT", "DNA"), ("ACGUACGU", "RNA"), ("ACDEFGHIKLMNPQRSTVWYX", "Protein"), ("ACGTJ123", None), ("", "DNA"), ("ACGT\n", None), (None, None), ("TU", None)])
def test_detect(spark, text, expected):
    assert one(spark, A.detect_alphabet("s"), s=text) == expected


def test_valid_and_sanitize(spark):
    assert one(spark, A.is_valid("s", "DNA"), s="acgtACGT") and not one(spark, A.is_valid("s", "DNA"), s="ACGUXCGT")
    assert not one(spark, A.is_valid("s", "RNA"), s="ACGUTCGU") and not one(spark, A.is_valid("s", "Protein"), s="ACDJ")
    assert one(spark, A.sanitize("s", "DNA", "N"), s="ACGUX") == "ACGNN" and one(spark, A.sanitize("s", "DNA", "$"), s="AX") == "A$"
    assert (A.size("DNA"), A.size("RNA"), A.size("Protein")) == (10, 10, 43)


@pytest.mark.parametrize("build, text", [(S.as_dna, "ACGUXYZ"), (S.as_rna, "ACGUTXYZ"), (S.as_protein, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (S.as_sequence, "12")])
def test_strict_and_null(spark, build, text):
    with pytest.raises(Exception, match="invalid"):
        one(spark, build("s"), s=text)
    assert one(spark, build("s", mode="null"), s=text) is None


CASES = [
    (lambda: S.complement("s"), "ACGTACGT", "TGCATGCA"), (lambda: S.reverse_complement("s"), "ACGTACGTA", "TACGTACGT"), (lambda: S.complement("s"), "ACGUACGU", "UGCAUGCA"), (lambda: S.reverse_complement("s"), "ACGUACGUA", "UACGUACGU"),
    (lambda: S.transcribe("s"), "ACGTACGTA", "ACGUACGUA"), (lambda: S.reverse_transcribe("s"), "ACGUACGUA", "ACGTACGTA"), (lambda: S.transcribe_text("s"), "ACGt", "ACGu"), (lambda: S.reverse("s"), "ACGT", "TGCA"), (lambda: S.reverse_complement_dna("s"), "AACGTT", "AACGTT"),
    (lambda: S.subsequence("s", 2, 6), "ACGTACGT", "GTAC"), (lambda: S.subsequence("s", 2, 2), "ACG", ""), (lambda: S.seq_slice("s", 2, 6), "ACGTACGT", "GTAC"), (lambda: S.seq_slice("s", -4), "ACGTACGT", "ACGT"), (lambda: S.seq_slice("s", None, -4), "ACGTACGT", "ACGT"),
    (lambda: S.seq_slice("s", None, None, 2), "ACGTACGT", "AGAG"), (lambda: S.seq_slice("s", 1, None, 2), "ACGTACGT", "CTCT"), (lambda: S.seq_slice("s", None, None, -1), "ACGT", "TGCA"), (lambda: S.seq_slice("s", 5, 2), "ACGTACGT", ""), (lambda: S.seq_slice("s"), "", ""),
    (lambda: S.gc_content("s"), "ACGTACGT", 50.0), (lambda: S.gc_content("s"), "", 0.0), (lambda: S.gc_content_called("s"), "ACGTNNNNNNNN", 50.0), (lambda: S.gc_content_called("s"), "", 0.0), (lambda: S.find_all("s", "ACG"), "ACGTACGT", [0, 4]), (lambda: S.find_all("s", "GT"), "ACGTACGT", [2, 6]),
    (lambda: S.find_all("s", "AAA"), "ACGTACGT", []), (lambda: S.find_all("s", "AA"), "AAAA", [0, 1, 2]), (lambda: S.find_all("s", ""), "ACGT", []), (lambda: S.kmp_search("s", "A"), "", []), (lambda: S.count("s", "AA"), "AAAA", 3), (lambda: S.count("s", ""), "A", 0), (lambda: S.count("s", "*."), "a*.*.", 2),
    (lambda: S.find_byte("s", "G"), "ACGT", 2), (lambda: S.find_byte("s", "N"), "ACGT", None), (lambda: S.count_byte("s", "A"), "ACGA", 2), (lambda: S.mask("s", [0, 3]), "ACGTA", "NCGNA"), (lambda: S.char_at("s", -2), "ACGTACGT", "G"), (lambda: S.base_composition("s"), "AAc", {"A": 2, "c": 1}), (lambda: S.base_composition("s"), "", {}),
    (lambda: S.subsequence_clamped("s", 2, 100), "ACGT", "GT"), (lambda: S.complement("s"), None, None), (lambda: S.length("s"), None, None),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_values(spark, i):
    build, text, expected = CASES[i]
    assert one(spark, build(), s=text) == expected


def test_gc_of_nine_and_n(spark):
    assert one(spark, S.gc_content("s"), s="ACGTACGTA") == pytest.approx(400 / 9)
    assert one(spark, S.gc_content("s"), s="ACGTNNNNNNNN") == pytest.approx(200 / 12)


@pytest.mark.parametrize("build", [lambda: S.subsequence("s", 2, 9), lambda: S.char_at("s", 100), lambda: S.mask("s", [4]), lambda: S.search("s", ""), lambda: S.complement("s", "Protein"), lambda: S.gc_content("s", "Protein"), lambda: S.transcribe("s", "RNA"), lambda: S.concatenate("s", F.lit("ACGU"))])
def test_errors(spark, build):
    with pytest.raises(Exception, match="USER_RAISED"):
        one(spark, build(), s="ACGT")


def test_bases_and_views(spark):
    for text in ("ACGTACGTNNACGT", "acgtACGTnnACGT"):
        assert tuple(one(spark, S.count_bases("s"), s=text)) == (3, 3, 3, 3, 2)
    assert tuple(one(spark, S.view_slide(2, 10, 12, 2))) == (4, 12) and tuple(one(spark, S.view_slide(2, 10, 12, -5))) == (0, 8) and tuple(one(spark, S.view_resize(4, 12, 4))) == (4, 8)
    assert one(spark, S.view_find_all("s", 2, 10, "GT"), s="ACGTACGTACGT") == [0, 4]


def test_protein(spark):
    assert one(spark, S.molecular_weight("s"), s="GX") == pytest.approx(57.0519 + 110 + 18.015)
    assert one(spark, S.reverse_complement("s", "Protein"), s="") == ""


def test_mask_by_column(spark):
    assert one(spark, S.mask("s", F.col("p"), "x"), s="ACGT", p=[1, 1, 3]) == "AxGx"


def test_random_dna_is_stable(spark):
    a, b = (one(spark, S.random_dna(40, F.lit("k"), 3)) for _ in range(2))
    assert a == b and len(a) == 40 and set(a) <= set("ACGT")
    assert one(spark, S.random_dna(40, F.lit("k"), 4)) != a


def test_packing(spark):
    for pack in (P.pack_dna, P.pack_dna_expr):
        got = one(spark, pack("s"), s="ACGTACGT")
        assert bytes(got["data"]).hex() == "1b1b" and got["len"] == 8
    assert one(spark, P.unpack_dna(P.pack_dna("s")), s="acgun") == "ACGTA"
    assert bytes(one(spark, P.pack_protein("s"), s="ARNDCQEGHILKMFP")["data"]).hex() == "0123456789abcde0"
    assert one(spark, P.unpack_protein(P.pack_protein("s")), s="ARNDCQEGHILKMFP") == "ARNDCQEGHILKMFP" and one(spark, P.unpack_protein(P.pack_protein("s")), s="STWYV*") == "XXXXXX"


@given(st.lists(st.text("ACGT", max_size=40), min_size=1, max_size=8))
@settings(max_examples=8, deadline=None)
def test_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", S.reverse_complement(S.reverse_complement("s", "DNA"), "DNA").alias("rc"), S.reverse_transcribe(S.transcribe_text("s")).alias("rt"), P.unpack_dna(P.pack_dna("s")).alias("p"), F.size(S.find_all("s", "AC")).alias("n"), S.count("s", "AC").alias("m")).collect()
    for r in rows:
        assert r["s"] == r["rc"] == r["rt"] == r["p"] and r["n"] == r["m"]


def test_metadata(spark):
    df = M.sequences(spark.createDataFrame([(1, "ACGT", "d"), (2, "AC", None)], "i int, t string, d string"), F.col("t"), F.col("i"), F.col("d"))
    rows = {r["id"]: r for r in M.transcribe(M.mask(M.subsequence(M.reverse(df), 0, 2), [0])).collect()}
    assert rows["1"]["description"] == "d (reversed) (subsequence 0..2) (masked) (transcribed)" and rows["1"]["seq"] == "NG" and rows["1"]["alphabet"] == "RNA"
    assert rows["2"]["description"] is None
    got = spark.createDataFrame([(None, "b", "x", None)], "i1 string, i2 string, d1 string, d2 string").select(*M.concatenated(*(F.col(c) for c in ("i1", "i2", "d1", "d2")))).first()
    assert tuple(got) == ("b", "x + [unnamed]")


def test_long_sequences_take_linear_time(spark, tmp_path):
    """160,000 bases: a walk from the start at each place would take most of a minute."""
    import time

    from seqframe.plans.pairs import kmers

    n = 160_000
    spark.range(1).select(F.repeat(F.lit("ACGTTGCA"), n // 8).alias("s"), F.sequence(F.lit(0), F.lit(n - 1), F.lit(7)).alias("at")).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    for value in (F.size(S.find_all("s", "ACG")), F.size(kmers(F.col("s"), 11)), F.length(S.seq_slice("s", None, None, 3)), F.length(S.mask("s", "at"))):
        one.select(value).first()
        began = time.time()
        one.select(value).first()
        assert time.time() - began < 3
    assert one.select(F.size(S.find_all("s", "ACG")).alias("n")).first()["n"] == n // 8


def test_places_in_text_that_is_not_ascii(spark):
    row = spark.createDataFrame([("éAéACé", [1, 4, 1])], "s string, at array<int>")
    got = row.select(S.find_all("s", "éA").alias("f"), S.seq_slice("s", None, None, 2).alias("t"), S.mask("s", "at").alias("m")).first()
    assert (got["f"], got["t"], got["m"]) == ([0, 2], "ééC", "éNéANé")
