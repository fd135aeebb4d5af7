"""Queries over parsers, codecs and the conversion planner; registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import blocks as ops
from quillstream.operators import render
from quillstream.plans.convert import convert
from quillstream.queries import STRIP, Query, query, read, talks
from quillstream.sources import columns


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))


def html_docs(spark: SparkSession, sf_dir: str, target: str = "txt") -> DataFrame:
    """page_id, metadata, content of every page."""
    return columns.read_documents(page_bytes(spark, sf_dir), "html", keep=("page_id",), target=target)


def _decoded(x: str) -> str:
    for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    return STRIP.format(x)


_TITLE = _decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_H1 = _decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_ITEMS = f"list_transform(regexp_extract_all(regexp_extract(html, '<ul>(.*?)</ul>', 1), '<li><a[^>]*>([^<]*)</a></li>', 1), lambda x: {_decoded('x')})"


@query("html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_docs(spark, sf_dir).select("page_id", F.col("metadata")["title"].alias("title"))


@query("html_heading_blocks", f"SELECT page_id, {_H1} AS data, CAST(1 AS INTEGER) AS level FROM pages")
def html_heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explode_blocks(html_docs(spark, sf_dir), "page_id").filter("type = 'heading'").select("page_id", "data", "level")


@query("html_lists", f"SELECT page_id, array_to_string({_ITEMS}, '|') AS items FROM pages")
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, which only the rich reader gives."""
    return ops.explode_blocks(html_docs(spark, sf_dir, "pdf"), "page_id").filter("type = 'list'").select("page_id", F.array_join("items", "|").alias("items"))


@query("html_to_md")
def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_docs(spark, sf_dir).select("page_id", render.md(F.col("metadata"), F.col("content"), "html").alias("md"))


@query("html_to_txt")
def html_to_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_docs(spark, sf_dir).select("page_id", render.txt(F.col("metadata"), F.col("content"), "html").alias("txt"))


@query("palmdoc_roundtrip", "SELECT conv_id, turn, text FROM conversations")
def palmdoc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed and decompressed again."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", columns.palm_compress(F.encode("text", "UTF-8")).alias("z"))
    return t.select("conv_id", "turn", F.decode(columns.palm_decompress(F.col("z")), "UTF-8").alias("text"))


#: Blocks that come back from a book of a conversation, one string a conversation.
_BACK = "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'h1:' ELSE 'p:' END || text, chr(10) ORDER BY turn) AS blocks FROM conversations GROUP BY conv_id"


def _round_trip(fmt: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        books = columns.write_documents(talks(spark, sf_dir), fmt, keep=("conv_id",))
        back = columns.read_documents(books, fmt, data_col="output", keep=("conv_id",))
        mark = lambda b: F.concat(F.when(b["type"] == "heading", F.concat(F.lit("h"), b["level"].cast("string"), F.lit(":"))).otherwise(F.lit("p:")), b["data"])
        shown = F.filter("content", lambda b: b["type"].isin("paragraph", "heading"))
        return back.select("conv_id", F.array_join(F.transform(shown, mark), "\n").alias("blocks"))

    return f


for _fmt in ("fb2", "azw3", "docx"):
    query(f"{_fmt}_roundtrip", _BACK)(_round_trip(_fmt))

_FILES = "documents CROSS JOIN (VALUES ('html'), ('epub'), ('rtf')) AS f(dst)"


def _files(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(f".{suffix}"))
    return read(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("data"))


@query("convert_results", f"SELECT '/in/' || doc_id || '.txt' AS source_path, '/in/' || doc_id || '.' || f.dst AS target_path, true AS success, CAST(1 AS INTEGER) AS hops, 'txt>' || f.dst AS way FROM {_FILES}")
def convert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of files x formats through the planner."""
    r = convert(_files(spark, sf_dir, "txt"), ["html", "epub", "rtf"]).select("result.*")
    return r.select("source_path", "target_path", "success", "hops", F.array_join("conversion_path", ">").alias("way"))


@query("convert_multi_hop", "SELECT '/in/' || doc_id || '.htm' AS source_path, true AS success, CAST(2 AS INTEGER) AS hops, 'htm>txt>epub' AS way FROM documents")
def convert_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = convert(_files(spark, sf_dir, "htm"), ["epub"]).select("result.*")
    return r.select("source_path", "success", "hops", F.array_join("conversion_path", ">").alias("way"))


@query("convert_failures", "SELECT '/in/' || doc_id || '.html' AS source_path, false AS success, '/in/' || doc_id || '.docx' AS target_path FROM documents")
def convert_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML to DOCX is declared but has no intermediate: every row fails, as data."""
    return convert(_files(spark, sf_dir, "html"), ["docx"]).select("result.source_path", "result.success", "result.target_path")
