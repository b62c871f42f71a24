"""FASTQ: strict records of four lines; a splittable scan, a parser of strings, and the writer's text.

Lines are numbered without a sort: each block's lines are counted, running sums over the (few) blocks of a file give each block its
offset, and the line number is offset + place in the block. Records are the lines with the same file and number div 4.
Quality lines may start with "@", so the scan never looks for one to find its place.

Errors: a header without "@", a separator without "+" (its rest is ignored), quality and sequence of different lengths, lines that are
not a multiple of four. Ids and sequences may be empty. Quality is text as in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import col
from .files import read_lines


def _problem(header: Column, seq: Column, plus: Column, quality: Column) -> Column:
    return (
        F.when(~F.startswith(header, F.lit("@")), "FASTQ: a header without @")
        .when(seq.isNull(), "FASTQ: missing sequence").when(plus.isNull(), "FASTQ: missing separator").when(quality.isNull(), "FASTQ: missing quality")
        .when(~F.startswith(plus, F.lit("+")), "FASTQ: a separator without +")
        .when(F.length(seq) != F.length(quality), "FASTQ: sequence and quality differ in length")
    )


def _named(header: Column) -> tuple[Column, Column]:
    parts = F.split(F.substring(header, F.lit(2), F.length(header)), " ", 2)
    return parts[0], F.get(parts, 1)


def scan_fastq(spark: SparkSession, path, mode: str = "strict") -> DataFrame:
    """RECORD_SCHEMA."""
    lines = read_lines(spark, path)
    blocks = lines.groupBy("path", "block_start").agg(F.count("*").alias("n"), F.min("ordinal").alias("least"))
    before = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = lines.join(blocks.select("path", "block_start", "least", "offset"), ["path", "block_start"])
    numbered = numbered.withColumn("number", F.col("offset") + F.col("ordinal") - F.col("least"))
    part = lambda i: F.max(F.when(F.col("number") % 4 == i, F.col("line")))
    records = numbered.groupBy("path", F.floor(F.col("number") / 4).alias("record")).agg(*(part(i).alias(c) for i, c in enumerate(("header", "seq", "plus", "quality"))), F.min("block_start").alias("block_start"), F.min("number").alias("ordinal"))
    problem = _problem(*(F.col(c) for c in ("header", "seq", "plus", "quality")))
    id_, description = _named(F.col("header"))
    seq = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("seq")) if mode == "strict" else F.col("seq")
    if mode != "strict":
        records = records.filter(problem.isNull())
    return records.select("path", "block_start", "ordinal", id_.alias("id"), description.alias("description"), seq.alias("seq"), "quality", F.create_map().cast("map<string,string>").alias("metadata"))


def parse_fastq(text: Column | str, mode: str = "strict") -> Column:
    """array of struct(id, description, seq, quality), for inline()."""
    whole = F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), r"\n\z", "")
    lines = F.split(whole, "\n")

    def record(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(4)]
        id_, description = _named(parts[0])
        problem = _problem(*parts)
        seq = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(parts[1]) if mode == "strict" else F.when(problem.isNull(), parts[1])
        return F.struct(id_.alias("id"), description.alias("description"), seq.alias("seq"), parts[3].alias("quality"))

    found = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(4)), record)
    found = F.when(whole == "", F.slice(found, 1, 0)).otherwise(found)
    return found if mode == "strict" else F.filter(found, lambda r: r["seq"].isNotNull())


def to_fastq(id_: Column | str, description: Column | str | None, seq: Column | str, quality: Column | str, trailing_newline: bool = True) -> Column:
    """Four lines; a NULL quality raises."""
    said = F.lit("") if description is None else F.coalesce(F.concat(F.lit(" "), col(description)), F.lit(""))
    quality = F.coalesce(col(quality), F.raise_error(F.lit("FASTQ: a record without quality")))
    text = F.concat(F.lit("@"), col(id_), said, F.lit("\n"), col(seq), F.lit("\n+\n"), quality)
    return F.concat(text, F.lit("\n")) if trailing_newline else text
