"""Text lines with their file and position, in whichever of two encodings each line is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bits of the row in a task (half a thousand million rows), and of the unit in which split offsets are told apart.
_ROW_BITS, _UNIT_BITS = 29, 4


def line_position() -> Column:
    """A number that grows along one file: its split's offset, then the row within the task.

    Splits start at least 16 bytes apart (files of up to 256 GB), and Spark numbers rows of a task in reading order.
    """
    block = F.shiftright(F.col("_metadata.file_block_start"), _UNIT_BITS)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return F.shiftleft(block, _ROW_BITS) + row


# What Windows-1252 has in place of Latin-1's second row of controls.
WINDOWS = {chr(byte): bytes([byte]).decode("cp1252") for byte in range(0x80, 0xA0) if byte not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def windows_text(latin: Column) -> Column:
    """Text of Windows-1252 that was read as Latin-1."""
    return F.translate(latin, "".join(WINDOWS), "".join(WINDOWS.values()))


def decoded(value: Column) -> Column:
    """The line as UTF-8 when its bytes are valid, else as Windows-1252 or, without its extra letters, Latin-1."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.when(F.is_valid_utf8(value), value).otherwise(windows_text(latin))


def text_lines(spark: SparkSession, path: str, head: bool = False) -> DataFrame:
    """Non-blank lines: archivo, line_no, value; with `head` those of each file's first block only."""
    source = spark.read.text(path)
    if head:
        source = source.filter(F.col("_metadata.file_block_start") == 0)
    raw = source.select(
        F.col("_metadata.file_path").alias("archivo"), line_position().alias("line_no"), decoded(F.col("value")).alias("value"))
    # Few lines hold either sign, so the pattern is tried on those alone.
    odd = F.startswith(F.col("value"), F.lit("﻿")) | F.contains(F.col("value"), F.lit("\r"))
    clean = F.when(odd, F.regexp_replace("value", "^﻿|\r$", "")).otherwise(F.col("value"))
    return raw.withColumn("value", clean).filter(F.trim("value") != "")


def first_lines(lines: DataFrame, count: int) -> DataFrame:
    """The first `count` lines of every file with their rank `n` (each task sends at most that many)."""
    order = F.row_number().over(Window.partitionBy("archivo").orderBy("line_no"))
    return lines.withColumn("n", order).filter(F.col("n") <= count)


def after_first(lines: DataFrame, count: int) -> DataFrame:
    """Lines after the first `count` of their file. The cut is one row per file, so lines are not
    shuffled by file."""
    if count <= 0:
        return lines
    heads = first_lines(lines, count).groupBy("archivo").agg(F.max("line_no").alias("_corte"))
    return lines.join(heads, "archivo").filter(F.col("line_no") > F.col("_corte")).drop("_corte")


def fields_of(lines: DataFrame, separator: str, most: int = -1) -> DataFrame:
    """Lines with their fields `c`, split literally (a quote is just a character); with `most`, the last holds the rest.

    A generator splits each line once: filters on its fields cannot pull the split into themselves. A sign behind a
    backslash is split without a regular expression.
    """
    sign = len(separator) == 1 and separator.isascii() and not separator.isalnum()
    pattern = "\\" + separator if sign else "\\Q" + separator + "\\E"
    return lines.select("*", F.explode(F.array(F.split("value", pattern, most))).alias("c"))


def field(index: int) -> Column:
    """A stripped field by position, '' when the line is shorter."""
    return F.trim(F.coalesce(F.get(F.col("c"), F.lit(index)), F.lit("")))
