"""Reading and writing sequence files by format, and telling formats apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import detect_alphabet
from ..functions.sequence import as_sequence
from ..schema import SequenceError
from .fasta import LINE_WIDTH, parse_fasta, scan_fasta, to_fasta
from .fastq import parse_fastq, scan_fastq, to_fastq

FORMATS = ("FASTA", "FASTQ")
READERS = {"FASTA": scan_fasta, "FASTQ": scan_fastq}
PARSERS = {"FASTA": parse_fasta, "FASTQ": parse_fastq}


def format_name(format: str) -> str:
    if format.upper() not in FORMATS:
        raise SequenceError(f"unsupported format: {format}")
    return format.upper()


def detect_format(spark: SparkSession, path: str) -> str:
    """FASTA or FASTQ, by the first and third lines of one file."""
    try:
        lines = [r[0].removesuffix("\r") for r in spark.read.option("lineSep", "\n").text(path).limit(3).collect()]
    except Exception as e:
        raise SequenceError(f"Failed to detect file format: {e}") from e
    if lines and lines[0].startswith(">"):
        return "FASTA"
    if len(lines) == 3 and lines[0].startswith("@") and lines[2].startswith("+"):
        return "FASTQ"
    raise SequenceError(f"Failed to detect file format of {path}")


def create_parser(format: str):
    """The scan of a format: (spark, path, mode) -> records."""
    return READERS[format_name(format)]


def read_sequences(spark: SparkSession, path, format: str | None = None, mode: str = "strict", **_options) -> DataFrame:
    """Records of a file, a folder or a glob. Reader options such as storage_mode and buffer_size are accepted; Spark sizes its own reads."""
    return create_parser(format or detect_format(spark, path))(spark, path, mode)


def read_fasta(spark: SparkSession, path, mode: str = "strict", **options) -> DataFrame:
    """Records with an alphabet; one that fits none raises (strict) or has a NULL seq."""
    return scan_fasta(spark, path, mode).withColumn("alphabet", detect_alphabet("seq")).withColumn("seq", as_sequence("seq", mode))


def read_fastq(spark: SparkSession, path, mode: str = "strict", **options) -> DataFrame:
    return scan_fastq(spark, path, mode)


def read_fasta_string(spark: SparkSession, text: str, mode: str = "strict") -> DataFrame:
    rows = spark.createDataFrame([(text,)], "text string").select(F.inline(F.coalesce(parse_fasta("text"), parse_fasta(F.lit(">")))))
    return rows.withColumn("alphabet", detect_alphabet("seq")).withColumn("seq", as_sequence("seq", mode))


def _lines(df: DataFrame, format: str, line_width: int):
    names = set(df.columns)
    description = "description" if "description" in names else None
    if format_name(format) == "FASTA":
        return to_fasta("id", description, "seq", line_width, trailing_newline=False)
    return to_fastq("id", description, "seq", "quality", trailing_newline=False)


def create_writer(format: str):
    """A writer of a format: (df, path, **options)."""
    name = format_name(format)
    return lambda df, path, **options: write_sequences(df, path, name, **options)


def write_sequences(df: DataFrame, path: str, format: str = "FASTA", line_width: int = LINE_WIDTH, mode: str = "overwrite", single_file: bool = False) -> None:
    """A folder of part files, written in parallel; single_file gives one part in order of (path, block_start, ordinal)."""
    text = _lines(df, format, line_width).alias("value")
    order = [c for c in ("path", "block_start", "ordinal") if c in df.columns]
    if single_file:
        # A global order in one task: for small exports only.
        df = (df.orderBy(*order) if order else df).coalesce(1)
    df.select(text).write.mode(mode).option("lineSep", "\n").text(path)


def write_fasta(df: DataFrame, path: str, **options) -> None:
    write_sequences(df, path, "FASTA", **options)


def write_fastq(df: DataFrame, path: str, **options) -> None:
    write_sequences(df, path, "FASTQ", **options)


def append_fasta(df: DataFrame, path: str, **options) -> None:
    write_sequences(df, path, "FASTA", mode="append", **options)


def append_fastq(df: DataFrame, path: str, **options) -> None:
    write_sequences(df, path, "FASTQ", mode="append", **options)


def write_string(df: DataFrame, format: str = "FASTA", line_width: int = LINE_WIDTH) -> str:
    """All records as one string on the driver, in order: for small tables, as the name says."""
    order = [c for c in ("path", "block_start", "ordinal") if c in df.columns]
    rows = (df.orderBy(*order) if order else df).select(_lines(df, format, line_width).alias("t")).toLocalIterator()
    return "".join(f"{r['t']}\n" for r in rows)


def record(id, seq, description=None, quality=None, metadata=None):
    """A record's struct; metadata is a map column (later keys win with add_metadata)."""
    none = F.lit(None).cast("string")
    return F.struct(id.alias("id"), (none if description is None else description).alias("description"), seq.alias("seq"), (none if quality is None else quality).alias("quality"), (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"))


def add_metadata(metadata, key: str, value):
    """The map with key set to value, new or not."""
    kept = F.map_filter(metadata, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value if not isinstance(value, str) else F.lit(value)))


def get_metadata(metadata, key: str):
    return F.try_element_at(metadata, F.lit(key))
