import glob

import pytest
from pyspark.sql import functions as F

from seqframe.schema import SequenceError
from seqframe.sources import api, fasta, fastq, files

FASTA = "\r\n>seq1 First sequence\r\nACGT\r\n ACGT \r\n>seq2\tx y \nGT\n\nAC\n>empty\n>>odd z\nAC GT\n>last\nAAA"
FASTQ = "@s1 First\nACGT\n+\n@HHH\n@s2\n\n+x\n\n@s3 a b\r\nAC\r\n+\r\nII\r\n"


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("path", "block_start", "ordinal").select(*names).collect()]


@pytest.fixture(params=["128m", "7b"])
def split(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path, split):
    write(tmp_path / "a.fa", FASTA)
    write(tmp_path / "b.fa", ">one d\nAC\n")
    got = rows(api.read_sequences(spark, f"{tmp_path}/*.fa", "fasta"), "id", "description", "seq")
    assert got == [("seq1", "First sequence", "ACGTACGT"), ("seq2\tx", "y ", "GTAC"), (">odd", "z", "AC GT"), ("last", None, "AAA"), ("one", "d", "AC")]


def test_fastq(spark, tmp_path, split):
    write(tmp_path / "a.fq", FASTQ)
    write(tmp_path / "b.fq", "@x\nA\n+\nI\n")
    got = rows(api.read_fastq(spark, f"{tmp_path}/*.fq"), "id", "description", "seq", "quality")
    assert got == [("s1", "First", "ACGT", "@HHH"), ("s2", None, "", ""), ("s3", "a b", "AC", "II"), ("x", None, "A", "I")]


@pytest.mark.parametrize("text", ["ACGT\n", ">\nACGT\n>x\nAC\n"])
def test_headerless(spark, tmp_path, text):
    path = write(tmp_path / "a", text)
    with pytest.raises(Exception, match="without a header"):
        api.read_sequences(spark, path, "FASTA").collect()
    assert {r["id"] for r in api.read_sequences(spark, path, "FASTA", mode="null").collect()} <= {"x"}


@pytest.mark.parametrize("text", ["s1\nAC\n+\nII\n", "@s1\nAC\n-\nII\n", "@s\nAC\n+\nI\n", "@s\nAC\n+\n", "\n@s\nA\n+\nI\n"])
def test_bad_fastq(spark, tmp_path, text):
    path = write(tmp_path / "a", text)
    with pytest.raises(Exception, match="FASTQ"):
        api.read_fastq(spark, path).collect()
    api.read_fastq(spark, path, mode="null").collect()


def test_detect(spark, tmp_path):
    assert api.detect_format(spark, write(tmp_path / "a", ">s\nACGT\n")) == "FASTA" and api.detect_format(spark, write(tmp_path / "b", "@s\nACGT\n+\nHHHH\n")) == "FASTQ"
    for text in ("", "\n>a\nA\n", "@a\nC\nG\n"):
        with pytest.raises(SequenceError):
            api.detect_format(spark, write(tmp_path / "c", text))
    with pytest.raises(SequenceError):
        api.detect_format(spark, str(tmp_path / "none"))
    with pytest.raises(SequenceError):
        api.create_writer("UNKNOWN")


def test_strings(spark):
    got = [tuple(r) for r in api.read_fasta_string(spark, "  >a b c \n AC \nGT\n>d\n>e\nA").collect()]
    assert got == [("a", "b c", "ACGT", "DNA"), ("e", None, "A", "DNA")] and api.read_fasta_string(spark, "").count() == 0
    df = spark.createDataFrame([("@a b\nAC\n+\nII\n@c\nG\n+\nI",)], "t string")
    assert [tuple(r) for r in df.select(F.inline(fastq.parse_fastq("t"))).collect()] == [("a", "b", "AC", "II"), ("c", None, "G", "I")]


def test_undetectable_fails(spark, tmp_path):
    path = write(tmp_path / "a", ">a\nACGT\n>b\n123\n")
    with pytest.raises(Exception, match="invalid sequence"):
        api.read_fasta(spark, path).collect()
    assert {r["id"]: r["seq"] for r in api.read_fasta(spark, path, mode="null").collect()} == {"a": "ACGT", "b": None}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "d", "ACGTACG", "IIIIIII"), (1, "b", "", "A", "I"), (2, "c", None, "", "")], "ordinal long, id string, description string, seq string, quality string")
    assert api.write_string(df, "FASTA", 3) == ">a d\nACG\nTAC\nG\n>b \nA\n>c\n"
    api.write_fasta(df, str(tmp_path / "o"), single_file=True, line_width=3)
    (part,) = glob.glob(f"{tmp_path}/o/part*")
    assert open(part).read() == ">a d\nACG\nTAC\nG\n>b \nA\n>c\n"
    assert api.write_string(df, "FASTQ") == "@a d\nACGTACG\n+\nIIIIIII\n@b \nA\n+\nI\n@c\n\n+\n\n"
    with pytest.raises(Exception, match="without quality"):
        api.write_string(df.withColumn("quality", F.lit(None).cast("string")), "FASTQ")
    with pytest.raises(ValueError):
        fasta.to_fasta("id", None, "seq", 0)


def test_records_and_chunks(spark):
    df = spark.range(1).select(api.add_metadata(F.create_map(F.lit("source"), F.lit("x")), "date", "y").alias("m"))
    assert df.select(api.get_metadata(F.col("m"), "date"), api.get_metadata(F.col("m"), "none")).first() == ("y", None)
    got = spark.range(1).select(files.file_chunks(1000, 300).alias("c"), files.file_chunks(0, 300).alias("e")).first()
    assert [tuple(x) for x in got["c"]] == [(0, 300), (300, 600), (600, 900), (900, 1000)] and got["e"] == []


def test_io_stats(spark):
    df, seen = files.with_io_stats(spark.createDataFrame([("ab",), ("é",), (None,)], "t string"), "t")
    df.collect()
    assert seen.get == {"rows": 3, "bytes": 4}
