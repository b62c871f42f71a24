"""FASTA: a splittable scan, a parser of strings, and the writer's text.

The scan reads with the record separator "\\n>", so files are split anywhere and each record is one row. Only the first
chunk of a file keeps its ">"; it is the row with the least id in the block that starts at 0.

Rules: a header starts with ">" at the line's first character; the id ends at the first space (a tab is no separator) and the
rest is the description, which may be empty; sequence lines are trimmed and joined, inner spaces stay; records without a
sequence are left out. Residues before the first header and records with a blank id raise in strict mode; in null mode they are left out.
(Carrying them over into the next record would depend on the record before, which a split scan cannot see.) In strings,
lines are trimmed before the header test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import col

LINE_WIDTH = 60


def _clean(body: Column) -> Column:
    """Sequence lines, trimmed and joined."""
    return F.regexp_replace(body, r"[ \t\r\n\x0b\x0c]*(?:\n|\z)[ \t\r\n\x0b\x0c]*|\A[ \t\r\n\x0b\x0c]+", "")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _header(line: Column) -> tuple[Column, Column]:
    """id and description of a header without its ">"."""
    parts = F.split(line, " ", 2)
    return parts[0], F.get(parts, 1)


def _record(header: Column, body: Column) -> list[Column]:
    id_, description = _header(header)
    return [id_.alias("id"), description.alias("description"), _clean(body).alias("seq")]


def _checked(df: DataFrame, bad: Column, message: Column, mode: str) -> DataFrame:
    """Rows of df; bad ones raise, or go. The check is part of seq, so it is done where seq is used."""
    if mode == "strict":
        return df.withColumn("seq", F.when(bad, F.raise_error(message)).otherwise(F.col("seq")))
    return df.filter(~bad)


def scan_fasta(spark: SparkSession, path, mode: str = "strict") -> DataFrame:
    """RECORD_SCHEMA; order by path, block_start, ordinal is the files' order."""
    chunks = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("ordinal"), F.col("value")
    )
    first = chunks.filter("block_start = 0").groupBy(F.col("path").alias("first_path")).agg(F.min("ordinal").alias("first_ordinal"))
    rows = chunks.join(first, (F.col("path") == F.col("first_path")) & (F.col("ordinal") == F.col("first_ordinal")), "left")
    is_first = F.col("first_path").isNotNull()
    text = F.when(is_first, F.regexp_replace("value", r"\A(?:\r?\n)+", "")).otherwise(F.col("value"))
    rows = rows.withColumn("text", text).withColumn("headless", is_first & ~F.startswith("text", F.lit(">")))
    text = F.when(is_first, F.regexp_replace("text", r"\A>", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    header = F.regexp_replace(F.substring_index("text", "\n", 1), r"\r\z", "")
    body = F.expr("if(instr(text, '\n') > 0, substring(text, instr(text, '\n') + 1), '')")
    out = rows.select("path", "block_start", "ordinal", *_record(header, body), F.lit(None).cast("string").alias("quality"), F.create_map().cast("map<string,string>").alias("metadata"), "headless", "text")
    bad = (F.col("headless") & (_trimmed(F.col("text")) != "")) | (~F.col("headless") & (F.col("id") == "") & (F.col("seq") != ""))
    out = out.filter(F.col("headless") | (F.col("seq") != "")).filter(~(F.col("headless") & (_trimmed(F.col("text")) == "")))
    out = _checked(out, bad, F.concat(F.lit("FASTA: residues without a header in "), F.col("path")), mode)
    return out.drop("headless", "text")


def parse_fasta(text: Column | str) -> Column:
    """array of struct(id, description, seq), for inline(); lines are trimmed first. NULL for text without a header."""
    space = F.lit(" \t\n\x0b\x0c\r")
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.btrim(x, space))
    joined = F.concat(F.lit("\n"), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
    parts = F.split(joined, "\n>")
    records = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(*_record(F.substring_index(p, "\n", 1), F.when(F.instr(p, "\n") > 0, _rest(p)).otherwise(F.lit("")))))
    return F.when((F.get(parts, 0) == "") | (F.size(parts) == 0), F.filter(records, lambda r: (r["id"] != "") & (r["seq"] != "")))


def _rest(p: Column) -> Column:
    return F.substring(p, F.instr(p, "\n") + 1, F.length(p))


def to_fasta(id_: Column | str, description: Column | str | None, seq: Column | str, line_width: int = LINE_WIDTH, trailing_newline: bool = True) -> Column:
    """>id description, then the sequence in lines; no header for a NULL id. An empty sequence has a header only."""
    if line_width < 1:
        raise ValueError("line_width must be at least 1")
    id_, seq = col(id_), col(seq)
    said = F.lit("") if description is None else F.coalesce(F.concat(F.lit(" "), col(description)), F.lit(""))
    header = F.concat(F.lit(">"), id_, said, F.lit("\n"))
    lines = F.when(seq == "", "").otherwise(F.concat(F.regexp_replace(seq, f"(.{{{line_width}}})(?=.)", "$1\n"), F.lit("\n")))
    text = F.concat(F.coalesce(header, F.lit("")), lines)
    return text if trailing_newline else F.regexp_replace(text, r"\n\z", "")
