"""Readers of plain text as Catalyst expressions: text -> metadata map and content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import model
from quillstream.functions.text import strip


def newlines(text: Column) -> Column:
    """Universal newlines."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def pieces(text: Column, separator: str) -> Column:
    """Stripped pieces between separators, without blank ones."""
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda x: x != "")


def read_txt(text: Column) -> Column:
    """Content: a paragraph for every piece between blank lines (null text: no blocks)."""
    return F.coalesce(F.transform(pieces(newlines(text), "\n\n"), model.paragraph), model.no_blocks())


def read_lines(pages: Column) -> Column:
    """Content: a paragraph for every line of every page that isn't blank."""
    lines = F.flatten(F.transform(pages, lambda p: pieces(p, "\n")))
    return F.coalesce(F.transform(lines, model.paragraph), model.no_blocks())


def read_titled_txt(text: Column) -> Column:
    """struct<metadata, content>: a first line underlined with ``=`` is the title, and a third
    line that begins ``By:`` the author; blank lines after them are skipped."""
    t = newlines(text)
    lines = F.split(t, "\n", -1)
    at = lambda k: F.coalesce(F.get(lines, F.lit(k)), F.lit(""))
    titled = (F.size(lines) >= 2) & strip(at(1)).rlike("^=+$")
    by = titled & strip(at(2)).startswith("By:")
    rest = F.when(by, F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0)))).when(titled, F.slice(lines, 3, F.size(lines) - 2)).otherwise(lines)
    title, author = strip(at(0)), strip(F.substring(strip(at(2)), 4, 1 << 30))
    empty = F.create_map().cast("map<string,string>")
    metadata = F.when(by, F.create_map(F.lit("title"), title, F.lit("author"), author)).when(titled, F.create_map(F.lit("title"), title)).otherwise(empty)
    return F.struct(metadata.alias("metadata"), read_txt(F.array_join(rest, "\n")).alias("content"))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def scan_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
