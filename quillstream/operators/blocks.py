"""Blocks as a relation: chapters, contents, byte offsets, records, and the joins of containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import escape_html


def explode_blocks(docs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, pos and the members of each block."""
    return docs.select(key, F.posexplode(content).alias("pos", "b")).select(key, "pos", "b.*")


def chapters(blocks: DataFrame, key: str) -> DataFrame:
    """``blocks`` with chapter: how many level-1 headings there are up to the block."""
    first = ((F.col("type") == "heading") & (F.col("level") == 1)).cast("int")
    return blocks.withColumn("chapter", F.sum(first).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def chapter_bodies(blocks: DataFrame, key: str) -> DataFrame:
    """key, chapter (0: what stands before the first level-1 heading), n_blocks, body."""
    esc = escape_html(F.col("data"))
    tag = F.when(F.col("type") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise(F.lit("p"))
    part = F.concat(F.lit("<"), tag, F.lit(">"), esc, F.lit("</"), tag, F.lit(">"))
    rows = chapters(blocks.filter(F.col("type").isin("paragraph", "heading")), key).withColumn("_part", part)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_part"))), lambda x: x["_part"])
    return rows.groupBy(key, "chapter").agg(F.count("*").alias("n_blocks"), F.array_join(ordered, "").alias("body"))


def zipped_titles(blocks: DataFrame, key: str) -> DataFrame:
    """key, chapter_no, title, body: bodies and level-1 titles by position.

    There is a body more than titles where text stands before the first title; then titles move
    one place up and the last body is dropped, as zipping does.
    """
    bodies = chapter_bodies(blocks, key)
    bodies = bodies.withColumn("chapter_no", F.row_number().over(Window.partitionBy(key).orderBy("chapter")))
    titles = blocks.filter((F.col("type") == "heading") & (F.col("level") == 1)).select(key, "pos", F.col("data").alias("title"))
    titles = titles.withColumn("chapter_no", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).drop("pos")
    return bodies.join(titles, [key, "chapter_no"]).select(key, "chapter_no", "title", "body")


def toc_entries(parts: DataFrame, key: str, *, part: str = "part", label: str = "label", total: Column | None = None) -> DataFrame:
    """key, pos, label, offset, length of the labelled parts of a text joined by line feeds.

    offset: bytes before the part; length: up to the next label, or to the end of the text.
    """
    w = Window.partitionBy(key).orderBy("pos")
    size = F.octet_length(part) + 1
    rows = parts.withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = F.sum(size).over(Window.partitionBy(key)) - 1 if total is None else total
    rows = rows.withColumn("_end", whole).filter(F.col(label).isNotNull())
    return rows.select(key, "pos", label, "offset", (F.coalesce(F.lead("offset").over(w), F.col("_end")) - F.col("offset")).alias("length"))


def text_records(data: Column, size: int = 4096) -> Column:
    """Byte slices of at most ``size``."""
    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    return F.transform(at, lambda i: F.substring(data, i + 1, size))


def record_offsets(sizes: DataFrame, key: str, n_records: Column) -> DataFrame:
    """``sizes`` (key, pos, size) with the file offset of each record of a PalmDB container."""
    before = F.sum("size").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("offset", F.lit(78) + n_records * 8 + 2 + F.coalesce(before, F.lit(0)))


def pagebreaks(blocks: DataFrame, key: str) -> DataFrame:
    """The level-1 headings with pagebreak: true for all but a document's first."""
    heads = blocks.filter((F.col("type") == "heading") & (F.col("level") == 1))
    return heads.withColumn("pagebreak", F.row_number().over(Window.partitionBy(key).orderBy("pos")) > 1)


def spine_items(spine: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Spine entries with their href, in spine order; of equal manifest ids the last one counts."""
    last = manifest.groupBy(key, "id").agg(F.max_by("href", "ord").alias("href"))
    return spine.join(last, [key, "id"]).select(key, "pos", "id", "href")


def covers(manifest: DataFrame, cover_ids: DataFrame, key: str) -> DataFrame:
    """The cover's href and format: the item named by the metadata, or the first marked as cover."""
    named = manifest.join(cover_ids.select(key, F.col("cover_id").alias("id")), [key, "id"], "left_semi").withColumn("_rank", F.lit(0))
    marked = manifest.filter(F.col("properties").contains("cover-image")).withColumn("_rank", F.lit(1))
    return named.unionByName(marked).groupBy(key).agg(F.min_by(F.struct("href", "media_type"), F.struct("_rank", "ord")).alias("c")).select(key, "c.href", "c.media_type")


def with_images(blocks: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Image blocks whose picture is there."""
    return blocks.filter(F.col("type") == "image").join(images.select(key, "name"), [key, "name"], "left_semi")


def merge_config(base: Column, update: Column) -> Column:
    """Dotted keys of two maps; the second wins where it has a value."""
    return F.map_zip_with(base, update, lambda _, a, b: F.coalesce(b, a))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """path and the config of its nearest directory (dir, values) at or above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    wide = files.select("path", F.explode(above).alias("dir"))
    return wide.join(configs, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "values"), F.length("dir")).alias("c")).select("path", "c.dir", "c.values")


def summary(results: DataFrame) -> DataFrame:
    """n_success and n_failed."""
    return results.agg(F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"))
