"""Queries over readers, writers and records in detail, each with DuckDB SQL; registered beside the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import model
from quillstream.format_queries import _BACK
from quillstream.functions import text as fn
from quillstream.operators import render
from quillstream.plans.convert import convert
from quillstream.queries import _RTF_BODY, _RTF_TOP, ESC, NL, P_EACH, P_HTML, PARAS, Query, nation_doc, page_sql, query, read, spread, talks
from quillstream.sources import columns, containers, palm, plain


def _shown(content: Column, more: Callable[[Column], Column] | None = None) -> Column:
    """Blocks as lines: kind, level and text."""

    def one(b: Column) -> Column:
        level = F.coalesce(b["level"].cast("string"), F.lit(""))
        out = F.concat(F.substring(b["type"], 1, 1), level, F.lit(":"), F.coalesce(b["data"], F.lit("")))
        return out if more is None else F.concat(out, more(b))

    return F.array_join(F.transform(content, one), "\n")


def _mapped(df: DataFrame, keep: str, col: str, f: Callable, kind: str = "string") -> DataFrame:
    """keep and f(value) of a binary column, as ``out``; one Arrow pass."""
    schema = f"{keep} {dict(df.dtypes)[keep]}, out {kind}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in (whole.slice(at, n) for at, n in columns.slices(whole.column(1))):
                got = pa.array([f(x) for x in batch.column(1).to_pylist()], pa.string() if kind == "string" else pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), got], names=[keep, "out"])

    return df.select(keep, col).mapInArrow(run, schema)


# --- text and markup readers ----------------------------------------------------------------------

_HEADED = f"'Doc ' || doc_id || {NL} || '=====' || {NL} || 'By: ' || source || {NL}"


@query("titled_text", f"SELECT doc_id, 'Doc ' || doc_id AS title, source AS author, CAST(len(p) AS INTEGER) AS n_blocks, array_to_string(p, '|') AS body FROM (SELECT d.doc_id, d.source, q.p FROM documents d JOIN ({PARAS}) q ON d.doc_id = q.doc_id)")
def titled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a title with a rule and an author line."""
    head = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit("\n=====\nBy: "), "source", F.lit("\n"))
    docs = read(spark, sf_dir, "documents").select("doc_id", plain.read_titled_txt(F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("d"))
    body = F.array_join(F.transform("d.content", lambda b: b["data"]), "|")
    return docs.select("doc_id", F.col("d.metadata")["title"].alias("title"), F.col("d.metadata")["author"].alias("author"), F.size("d.content").alias("n_blocks"), body.alias("body"))


_PARTS = "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part"


def _part_files(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """p_partkey and bytes: literal pieces, and columns where a piece begins with ``@``."""
    text = F.concat(*[F.col(x[1:]).cast("string") if x.startswith("@") else F.lit(x) for x in parts])
    return spread(read(spark, sf_dir, "part").select("p_partkey", F.encode(text, "UTF-8").alias("data")), "p_partkey")


@query("markdown_blocks", f"SELECT p_partkey, 'h1:' || p_name || {NL} || 'p:A ' || p_type || ' of ' || p_brand || ' and code' || {NL} || 'h2:' || p_brand || {NL} || 'p:size ' || p_size || {NL} || 'second line' AS blocks FROM ({_PARTS})")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _part_files(spark, sf_dir, "# ", "@p_name", "\n\nA **", "@p_type", "** of [", "@p_brand", "](http://example.org/) and `code`\n\n- tight\n- items\n\n", "@p_brand", "\n---\n\nsize ", "@p_size", "\nsecond line\n\n    indented code\n")
    return columns.read_documents(files, "md", keep=("p_partkey",)).select("p_partkey", _shown(F.col("content")).alias("blocks"))


@query("rtf_blocks", f"SELECT p_partkey, 'p:' || p_name || {NL} || p_type || {NL} || 'p:' || p_brand || ' é☃ {{x}}\\' AS blocks FROM ({_PARTS})")
def rtf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _part_files(spark, sf_dir, r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title T}}\pard\b ", "@p_name", r"\b0\par ", "@p_type", r"\par\par ", "@p_brand", r" \'e9" + "\\" + r"u9731? \{x\}\\}")
    return columns.read_documents(files, "rtf", keep=("p_partkey",)).select("p_partkey", _shown(F.col("content")).alias("blocks"))


@query("odt_blocks", f"SELECT p_partkey, p_brand AS title, p_type AS author, 'h2:' || p_name || {NL} || 'p:' || p_type || p_size || {NL} || 'h2:' || p_brand || {NL} || 'h4:' || p_size || {NL} || 'h1:' || p_name AS blocks FROM ({_PARTS})")
def odt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by outline level and by style names; what isn't a direct child is left out."""
    t, o, d = containers.TEXT, containers.OFFICE, containers.DC

    def pack(row: str) -> str:
        name, brand, kind, size = row.split("\x1f")
        body = f'<t:h t:outline-level="2">{name}</t:h><t:p>{kind}<t:span>{size}</t:span></t:p><t:list><t:list-item><t:p>no</t:p></t:list-item></t:list>'
        body += f'<t:p t:style-name="Heading_20_3">{brand}</t:p><t:p t:style-name="My heading 4">{size}</t:p><t:h> {name}\n</t:h><t:p> </t:p>'
        files = [("content.xml", f'<o:document-content xmlns:o="{o}" xmlns:t="{t}"><o:body><o:text>{body}</o:text></o:body></o:document-content>', True)]
        meta = f'<o:document-meta xmlns:o="{o}" xmlns:dc="{d}"><o:meta><dc:title>{brand}</dc:title><dc:creator>{kind}</dc:creator></o:meta></o:document-meta>'
        return containers._zip([*files, ("meta.xml", meta, True)]).hex()

    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\x1f", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("x"))
    files = _mapped(spread(rows, "p_partkey"), "p_partkey", "x", pack).select("p_partkey", F.unhex("out").alias("data"))
    docs = columns.read_documents(files, "odt", keep=("p_partkey",))
    return docs.select("p_partkey", F.col("metadata")["title"].alias("title"), F.col("metadata")["author"].alias("author"), _shown(F.col("content")).alias("blocks"))


_NATIONS = "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS n FROM nation GROUP BY n_regionkey"


@query("fb2_sections", f"SELECT CAST(n_regionkey AS BIGINT) AS region, 'Ann Lee, Bo, Cy' AS author, 'h1:Region ' || n_regionkey || {NL} || 'p:lead' || {NL} || array_to_string(list_transform(n, lambda x: 'h2:' || x || {NL} || 'p:In ' || x || ' now.' || {NL} || 'p:cited'), {NL}) AS blocks FROM ({_NATIONS})")
def fb2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections within sections, several authors, a citation; verses of a poem have no block."""
    names = "".join(f"<author>{x}</author>" for x in ("<first-name>Ann</first-name><last-name>Lee</last-name>", "<first-name>Bo</first-name>", "<last-name>Cy</last-name>", ""))
    top = f'<FictionBook xmlns="{containers.FB2}"><description><title-info><book-title>T</book-title>{names}</title-info></description><body><section><title><p>Region '
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    one = lambda x: F.concat(F.lit("<section><title><p>"), x["n_name"], F.lit("</p></title><p>In <emphasis>"), x["n_name"], F.lit("</emphasis> now.</p><cite><p>cited</p></cite><poem><stanza><v>lost</v></stanza></poem></section>"))
    xml = F.concat(F.lit(top), F.col("n_regionkey").cast("string"), F.lit("</p></title><p> lead </p>"), F.array_join(F.transform("n", one), ""), F.lit("</section></body></FictionBook>"))
    docs = columns.read_documents(n.select(F.col("n_regionkey").cast("long").alias("region"), F.encode(xml, "UTF-8").alias("data")), "fb2", keep=("region",))
    return docs.select("region", F.col("metadata")["author"].alias("author"), _shown(F.col("content")).alias("blocks"))


@query("html_tables", f"SELECT CAST(n_regionkey AS BIGINT) AS region, 'h|' || {NL} || 'h1:R' || {NL} || 't:' || array_to_string(list_transform(n, lambda x: x || '/' || length(x)), ';') || {NL} || 'l:1. ' || array_to_string(n, ',') AS blocks FROM ({_NATIONS})")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and ordered lists, which only the rich reader gives."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.array_join(F.transform("n", lambda x: F.concat(F.lit("<tr><td> "), x["n_name"], F.lit("</td><td>"), F.length(x["n_name"]).cast("string"), F.lit("</td></tr>"))), "")
    items = F.array_join(F.transform("n", lambda x: F.concat(F.lit("<li>"), x["n_name"], F.lit("</li>"))), "\n")
    page = F.concat(F.lit("<h1>R</h1><table><thead><tr><th>h</th></tr></thead><tbody>"), rows, F.lit("</tbody></table><ol>"), items, F.lit("</ol>"))
    docs = columns.read_documents(n.select(F.col("n_regionkey").cast("long").alias("region"), F.encode(page, "UTF-8").alias("data")), "html", keep=("region",), target="pdf")
    table = F.filter("content", lambda b: b["type"] == "table")[0]
    cells = F.array_join(F.transform(table["rows"], lambda r: F.array_join(r, "/")), ";")
    listed = F.filter("content", lambda b: b["type"] == "list")[0]
    heads = F.filter("content", lambda b: b["type"] == "heading")
    mark = F.when(listed["ordered"], F.lit("1. ")).otherwise(F.lit("- "))
    return docs.select("region", F.concat(F.array_join(table["headers"], "|"), F.lit("|\n"), _shown(heads), F.lit("\nt:"), cells, F.lit("\nl:"), mark, F.array_join(listed["items"], ",")).alias("blocks"))


@query("docx_rich", f"""SELECT CAST(n_regionkey AS BIGINT) AS region, 'r:' || n[1] || ' b i u #ff0000 12' || {NL} || 'r:' || n[1] || ' (https://example.org/?a=1&b=' || n_regionkey || ') #0000ff' || {NL} || 'h7:' || n[1] || {NL} ||
 't:' || array_to_string(list_transform(range(1, len(n) + 1), lambda i: k[i] || '/' || n[i]), ';') || ' key/name' AS blocks FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS n, list(n_nationkey ORDER BY n_nationkey) AS k FROM nation GROUP BY n_regionkey)""")  # fmt: skip
def docx_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs keep their style, list paragraphs are skipped, tables come last."""
    back = columns.read_documents(columns.write_documents(nation_doc(spark, sf_dir), "docx", keep=("region",)), "docx", data_col="output", keep=("region",))

    def more(b: Column) -> Column:
        style = F.concat_ws(" ", *[F.when(b[k], F.lit(k[0])) for k in ("bold", "italic", "underline")], b["color"], b["size"].cast("string"))
        table = F.concat(F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "/")), ";"), F.lit(" "), F.array_join(b["headers"], "/"))
        return F.when(b["type"] == "run", F.concat(F.lit(" "), style)).when(b["type"] == "table", table).otherwise(F.lit(""))

    return back.select("region", _shown(F.col("content"), more).alias("blocks"))


# --- books ------------------------------------------------------------------------------------------


def ascii_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """talks() with printable ASCII alone, so that no character is parted by records."""
    keep = lambda b: b.withField("data", F.regexp_replace(b["data"], "[^ -~]", "_"))
    return talks(spark, sf_dir).select("conv_id", "metadata", F.transform("content", keep).alias("content"))


_ASCII = "(SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '_', 'g') AS text FROM conversations)"
_BACK_ASCII = _BACK.replace("FROM conversations", f"FROM {_ASCII}")
_CHAPTERS = "SELECT *, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS ch, count_if(role = 'user') OVER (PARTITION BY conv_id) AS n FROM conversations"


def _back(fmt: str, docs: Callable[[SparkSession, str], DataFrame]) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        books = columns.write_documents(docs(spark, sf_dir), fmt, keep=("conv_id",))
        back = columns.read_documents(books, fmt, data_col="output", keep=("conv_id",))
        return back.select("conv_id", _shown(F.filter("content", lambda b: b["type"].isin("paragraph", "heading"))).alias("blocks"))

    return f


query("mobi_roundtrip", _BACK_ASCII)(_back("mobi", ascii_talks))
#: Titles and bodies are paired by position: where text stands before the first title, the last body goes.
query("epub_roundtrip", f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'h1:' ELSE 'p:' END || text, chr(10) ORDER BY turn) AS blocks FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY ch) AS k FROM ({_CHAPTERS})) WHERE n = 0 OR k <= n GROUP BY conv_id")(_back("epub", talks))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents: a title, an author, three paragraphs."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    meta = F.create_map(F.lit("title"), F.concat(F.lit("T ("), "c_name", F.lit(")")), F.lit("author"), F.col("c_mktsegment"))
    paras = F.array(model.paragraph(F.col("c_name")), model.paragraph(F.concat(F.lit("nation \\ é "), F.col("c_nationkey").cast("string"))), model.paragraph(F.col("c_mktsegment")))
    return c.select("c_custkey", meta.alias("metadata"), paras.alias("content"))


_PDF = f"['T (' || c_name || ')', 'By ' || c_mktsegment, c_name, 'nation \\ é ' || c_nationkey, c_mktsegment]"


def _pdf(target: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        books = columns.write_documents(customer_docs(spark, sf_dir), "pdf", keep=("c_custkey",))
        back = columns.read_documents(books, "pdf", data_col="output", keep=("c_custkey",), target=target)
        return back.select("c_custkey", F.col("metadata")["title"].alias("title"), F.size("content").alias("n"), F.array_join(F.transform("content", lambda b: b["data"]), "|").alias("text"))

    return f


query("pdf_pages", f"SELECT c_custkey, 'T (' || c_name || ')' AS title, CAST(1 AS INTEGER) AS n, array_to_string({_PDF}, {NL}) AS text FROM customer")(_pdf("txt"))
query("pdf_lines", f"SELECT c_custkey, 'T (' || c_name || ')' AS title, CAST(5 AS INTEGER) AS n, array_to_string({_PDF}, '|') AS text FROM customer")(_pdf("epub"))


@query("pdf_to_epub", f"SELECT c_custkey, array_to_string({_PDF}, '|') AS text FROM customer")
def pdf_to_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the pages a paragraph of the one chapter."""
    pdfs = columns.write_documents(customer_docs(spark, sf_dir), "pdf", keep=("c_custkey",)).select(F.concat(F.lit("/d/"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"), F.col("output").alias("data"))
    books = convert(pdfs, ["epub"]).select(F.regexp_extract("result.source_path", r"(\d+)", 1).cast("long").alias("c_custkey"), F.col("output").alias("data"))
    back = columns.read_documents(books, "epub", keep=("c_custkey",))
    return back.select("c_custkey", F.array_join(F.transform("content", lambda b: b["data"]), "|").alias("text"))


# --- records of books ---------------------------------------------------------------------------------

_T = "'Talk <' || conv_id || '>'"
_MOBI_LEN = f"""SELECT conv_id, CAST(strlen('<html><head><meta charset="utf-8"/></head><body>') + 1 + sum(strlen({ESC.format('text').replace('&#39;', '&#x27;')}) + CASE WHEN role = 'user' THEN 10 ELSE 8 END) + greatest(count_if(role = 'user') - 1, 0) * (strlen('<mbp:pagebreak/>') + 1) + strlen('</body></html>') AS BIGINT) AS size FROM conversations GROUP BY conv_id"""


def _h32(x: str) -> str:
    return f"printf('%08X', CAST({x} AS BIGINT))"


@query("mobi_header", f"""SELECT conv_id, '00020000' || {_h32('size')} || printf('%04X', CAST(ceil(size / 4096) AS BIGINT)) || '100000000000' || hex('MOBI') || '000000E800000002' || {_h32('65001')} AS head,
 hex('FCIS') || '00000014000000100000000100000000' || {_h32('size')} || '00000000000000200000000800010001' || '00000000' AS fcis, 'E98E0D0A' AS eof, CAST(size AS BIGINT) AS size FROM ({_MOBI_LEN})""")  # fmt: skip
def mobi_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of record 0, the flow record, the end record, and the length of the text that is in the records."""
    books = columns.write_documents(talks(spark, sf_dir), "mobi", keep=("conv_id",))

    def look(data: bytes) -> list[str]:
        r = palm.records_of(data)
        n = int.from_bytes(r[0][8:10], "big")
        return [r[0][:16].hex().upper() + r[0][16:32].hex().upper(), r[-2].hex().upper(), r[-1].hex().upper(), str(sum(len(palm.decompress(x)) for x in r[1 : n + 1]))]

    got = _mapped(books, "conv_id", "output", look, "array<string>")
    return got.select("conv_id", F.col("out")[0].alias("head"), F.col("out")[1].alias("fcis"), F.col("out")[2].alias("eof"), F.col("out")[3].cast("long").alias("size"))


def _exth(kind: str, value: str) -> str:
    return f"'{int(kind):08X}' || printf('%08X', strlen({value}) + 8) || hex({value})"


_ABOUT = [("100", "'A & B'"), ("106", "'2000-01-01'"), ("503", _T), ("524", "'en'")]
_EXTH = f"SELECT conv_id, 12 + 12 + {' + '.join(f'8 + strlen({v})' for _, v in _ABOUT)} AS raw, {' || '.join(_exth(k, v) for k, v in _ABOUT)} || '0000007D0000000C00000000' AS body FROM (SELECT DISTINCT conv_id FROM conversations)"


@query("mobi_exth", f"SELECT conv_id, hex('EXTH') || printf('%08X', CAST(ceil(raw / 4) * 4 AS BIGINT)) || '00000005' || body || repeat('00', CAST(ceil(raw / 4) * 4 - raw AS BIGINT)) AS exth, {_T} AS title, left({_T}, 31) AS name FROM ({_EXTH})")
def mobi_exth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata block in bytes, the full title where record 0 says it is, and the database's name."""
    books = columns.write_documents(talks(spark, sf_dir), "mobi", keep=("conv_id",))

    def look(data: bytes) -> list[str]:
        zero = palm.records_of(data)[0]
        at, n = int.from_bytes(zero[84:88], "big"), int.from_bytes(zero[88:92], "big")
        return [zero[248:at].hex().upper(), zero[at : at + n].decode(), data[:32].rstrip(b"\0").decode()]

    got = _mapped(books, "conv_id", "output", look, "array<string>")
    return got.select("conv_id", *[F.col("out")[k].alias(c) for k, c in enumerate(("exth", "title", "name"))])


_XESC = ESC.format("text").replace("&#39;", "&#x27;")
_KHEAD = """strlen('<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body aid="0000">') + strlen(""" + ESC.format(_T) + ")"
_SECTIONS = f"""SELECT conv_id, ch, row_number() OVER (PARTITION BY conv_id ORDER BY ch) - 1 AS k, {_KHEAD} AS head, sum(strlen({_XESC}) + CASE WHEN role = 'user' THEN 9 ELSE 7 END) AS body, CASE WHEN ch = 0 THEN {_T} ELSE arg_min(text, turn) END AS label FROM ({_CHAPTERS}) GROUP BY conv_id, ch"""
_PLACED = f"SELECT *, CAST(coalesce(sum(head + body + 14) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM ({_SECTIONS})"


def _kf8(field: int, shape: Callable[[list[bytes], int], list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    """conv_id and the strings that ``shape`` makes of the index that a header field points to."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        books = columns.write_documents(talks(spark, sf_dir), "azw3", keep=("conv_id",))

        def look(data: bytes) -> list[str]:
            r = palm.records_of(data)
            return shape(r, int.from_bytes(r[0][field : field + 4], "big"))

        return _mapped(books, "conv_id", "output", look, "array<string>").select("conv_id", F.array_join("out", "\n").alias("entries"))

    return f


query("kf8_skeletons", f"SELECT conv_id, string_agg('SKEL' || printf('%010d', k) || ' 1 1 ' || pos || ' ' || (head + 14)::BIGINT || ' ' || pos || ' ' || (head + 14)::BIGINT, chr(10) ORDER BY k) AS entries FROM ({_PLACED}) GROUP BY conv_id")(
    _kf8(0xFC, lambda r, k: [" ".join([label.decode(), *map(str, v[1] + v[6])]) for label, v in palm.index_of(r, k)])
)
query("kf8_chunks", f"SELECT conv_id, string_agg(printf('%010d', CAST(pos + head AS BIGINT)) || ' P-//*[@aid=''0000''] ' || k || ' ' || k || ' 0 ' || body::BIGINT, chr(10) ORDER BY k) AS entries FROM ({_PLACED}) GROUP BY conv_id")(
    _kf8(0xF8, lambda r, k: [" ".join([label.decode(), palm.string_at(r[k + 2], v[2][0]).decode(), *map(str, v[3] + v[4] + v[6])]) for label, v in palm.index_of(r, k)])
)
query("kf8_contents", f"SELECT conv_id, string_agg(printf('%03d', k) || ' ' || pos || ' ' || (head + body + 14)::BIGINT || ' ' || label, chr(10) ORDER BY k) AS entries FROM ({_PLACED}) GROUP BY conv_id")(
    _kf8(0xF4, lambda r, k: [" ".join([label.decode(), str(v[1][0]), str(v[2][0]), palm.string_at(r[k + 2], v[3][0]).decode("utf-8", "ignore")]) for label, v in palm.index_of(r, k)])
)
query("kf8_flow", f"SELECT conv_id, hex('FDST') || '0000000C0000000100000000' || {_h32('sum(head + body + 14)')} || ' text 0' AS entries FROM ({_PLACED}) GROUP BY conv_id")(
    _kf8(0xC0, lambda r, k: [r[k].hex().upper() + " " + " ".join(f"{label.decode()} {v[1][0]}" for label, v in palm.index_of(r, int.from_bytes(r[0][0x104:0x108], "big")))])
)


@query("aligned_records", "SELECT k, CASE WHEN a = 4096 THEN '4096 7' WHEN a = 4095 THEN '4095 7' WHEN a = 4094 THEN '4094 7' WHEN a = 4093 THEN '4096 4' ELSE '4096 3' END AS sizes FROM (SELECT o_orderkey AS k, 4092 + o_orderkey % 5 AS a FROM orders)")
def aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snowman at the border of two records goes to the second as a whole."""
    text = F.concat(F.repeat(F.lit("A"), (F.col("k") % 5 + 4092).cast("int")), F.lit("☃BBBB"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("data", F.encode(text, "UTF-8"))
    return _mapped(rows, "k", "data", lambda x: " ".join(str(len(p)) for p in palm.split_utf8(x))).withColumnRenamed("out", "sizes")


# --- scalar functions and settings ----------------------------------------------------------------------


@query("book_names", """SELECT n_nationkey AS k, left(replace(regexp_replace('É ' || n_name || ' of a long and winding road', '[^ -\\x7f]', '_', 'g'), ' ', '_'), 31) AS palm, split_part(lower(left(n_name, 2)) || '-XX', '-', 1) AS lang,
 CASE n_nationkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'jpg' END AS format, CASE n_nationkey % 3 WHEN 0 THEN n_name || ' Lee' WHEN 1 THEN 'Lee' ELSE n_name END AS author, hex(n_name || repeat(chr(0), CAST((4 - strlen(n_name) % 4) % 4 AS BIGINT))) AS aligned, hex(left(n_name, 5)) AS clipped FROM nation""")  # fmt: skip
def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    kind = F.when(k % 3 == 0, "image/jpeg").when(k % 3 == 1, "image/png").otherwise("unknown")
    first, last = F.when(k % 3 != 1, name).otherwise(F.lit("")), F.when(k % 3 != 2, F.lit("Lee")).otherwise(F.lit(""))
    return read(spark, sf_dir, "nation").select(
        k.alias("k"), fn.palm_name(F.concat(F.lit("É "), name, F.lit(" of a long and winding road"))).alias("palm"), fn.language_prefix(F.concat(F.lower(F.substring(name, 1, 2)), F.lit("-XX"))).alias("lang"),
        fn.media_format(kind).alias("format"), fn.author_name(first, last).alias("author"), F.hex(fn.align4(F.encode(name, "UTF-8"))).alias("aligned"), F.hex(fn.clip_bytes(name, 5)).alias("clipped"),
    )


@query("stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) + 2082844800 AS palm FROM events")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", fn.utc_stamp(F.col("ts")).alias("stamp"), fn.palm_seconds(F.col("ts").cast("timestamp")).alias("palm"))


@query("settings_layers", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'out-' || c_nationkey END AS directory, CASE WHEN c_custkey % 5 = 0 THEN 'latin-1' WHEN c_custkey % 2 = 0 THEN 'utf-16' ELSE 'utf-8' END AS encoding,
 '{name}.{ext}' AS pattern, 'none' AS missing FROM customer""")  # fmt: skip
def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML of a user and of a directory over the defaults, looked up by dotted keys."""
    k = F.col("c_custkey")
    user = F.when(k % 2 == 0, F.lit("documents:\n  encoding: utf-16\n")).otherwise(F.lit(""))
    near = F.concat(F.when(k % 3 == 0, F.concat(F.lit("output:\n  directory: out-"), F.col("c_nationkey").cast("string"), F.lit("\n"))).otherwise(F.lit("")), F.when(k % 5 == 0, F.lit("documents: {encoding: latin-1}\n")).otherwise(F.lit("")))
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\x1f", user, near).alias("x")), "c_custkey")

    def look(x: str) -> list[str]:
        from quillstream.plans import config as cfg

        got = cfg.Config(*map(cfg.parsed, x.split("\x1f")))
        return [got.get(key, "none") for key in ("output.directory", "documents.encoding", "output.filename_pattern", "no.such.key")]

    got = _mapped(rows, "c_custkey", "x", look, "array<string>")
    return got.select("c_custkey", *[F.col("out")[i].alias(c) for i, c in enumerate(("directory", "encoding", "pattern", "missing"))])


@query("pdf_runs", f"SELECT n_nationkey AS k, '<font size=\"12\"><font color=\"#FF0000\"><u><i><b>' || n_name || ' &amp; &lt;x&gt;</b></i></u></font></font>' AS styled, n_name || ' &amp; &lt;x&gt;' AS bare FROM nation")
def pdf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("n_name", F.lit(" & <x>"))
    styled = model.run(text, bold=F.lit(True), italic=F.lit(True), underline=F.lit(True), color=F.lit("#FF0000"), size=F.lit(12))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), render.pdf_run(styled).alias("styled"), render.pdf_run(model.run(text)).alias("bare"))


# --- the planner's bytes ----------------------------------------------------------------------------------


def _doubled_files(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(f".{suffix}"))
    return read(spark, sf_dir, "documents").select(path.alias("path"), F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("data"))


_OUT = {"txt": P_EACH, "md": P_EACH, "html": page_sql(P_HTML), "rtf": f"{_RTF_TOP} || {_RTF_BODY} || '}}'"}


@query("convert_outputs", " UNION ALL ".join(f"SELECT '/in/' || doc_id || '.{t}' AS target_path, {sql} AS output FROM ({PARAS})" for t, sql in _OUT.items()))
def convert_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plain text becomes."""
    got = convert(_doubled_files(spark, sf_dir, "txt"), list(_OUT))
    return got.select("result.target_path", F.decode("output", "UTF-8").alias("output"))


_MD_SRC = f"SELECT conv_id, turn, role, regexp_replace(text, '[^A-Za-z ,.]', '', 'g') AS text FROM conversations"


def _md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of a conversation's letters: a user's turns are headings."""
    text = F.regexp_replace("text", "[^A-Za-z ,.]", "")
    line = F.concat(F.when(F.col("role") == "user", F.lit("# A ")).otherwise(F.lit("A ")), text, F.lit("z"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("x"))
    return rows.select(F.concat(F.lit("/in/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.encode(F.array_join(F.transform("x", lambda v: v["x"]), "\n\n"), "UTF-8").alias("data"))


def _md_sql(head: str, para: str, before: str = "''", after: str = "''") -> str:
    return f"{before} || string_agg(CASE WHEN role = 'user' THEN {head} ELSE {para} END, '' ORDER BY turn) || {after}"


_MD_PAGE, _, _MD_END = page_sql("@@").partition(" || @@ || ")
_MD_RTF = _md_sql(rf"'\pard\fs28\b A ' || text || 'z\b0\fs24\par' || {NL}", rf"'\pard A ' || text || 'z\par' || {NL}", _RTF_TOP, "'}'")
_MD_OUT = {
    "txt": _md_sql(f"'A ' || upper(text) || 'Z' || {NL} || repeat('=', length(text) + 3) || {NL} || {NL}", f"'A ' || text || 'z' || {NL} || {NL}"),
    "html": _md_sql(f"'<h1>A ' || text || 'z</h1>' || {NL}", f"'<p>A ' || text || 'z</p>' || {NL}", _MD_PAGE, _MD_END),
    "rtf": _MD_RTF,
}


@query("convert_markdown", " UNION ALL ".join(f"SELECT '/in/' || conv_id || '.{t}' AS target_path, {sql} AS output FROM ({_MD_SRC}) GROUP BY conv_id" for t, sql in _MD_OUT.items()))
def convert_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Markdown becomes; RTF by way of an HTML page within the one hop."""
    return convert(_md_files(spark, sf_dir), list(_MD_OUT)).select("result.target_path", F.decode("output", "UTF-8").alias("output"))


@query("convert_hops", f"""SELECT c.conv_id, 'md>html>azw3' AS way, string_agg(CASE WHEN role = 'user' THEN 'h1:' ELSE 'p:' END || 'A ' || text || 'z', chr(10) ORDER BY turn) AS blocks FROM ({_MD_SRC}) c GROUP BY c.conv_id""")
def convert_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of two conversions, read back: blocks of the HTML between are those of the book."""
    pages = convert(_md_files(spark, sf_dir), ["html"]).select(F.regexp_replace("result.target_path", "html$", "htm").alias("path"), F.col("output").alias("data"))
    first = pages.select(F.regexp_replace("path", "htm$", "html").alias("path"), "data")
    got = convert(first, ["azw3"])
    books = got.select(F.regexp_extract("result.source_path", r"(\d+)", 1).cast("long").alias("conv_id"), F.concat(F.lit("md>"), F.array_join("result.conversion_path", ">")).alias("way"), F.col("output").alias("data"))
    back = columns.read_documents(books, "azw3", keep=("conv_id", "way"))
    return back.select("conv_id", "way", _shown(F.col("content")).alias("blocks"))


@query("convert_existing", """SELECT '/in/' || doc_id || '.txt' AS source_path, doc_id % 2 <> 0 OR doc_id % 3 = 0 AS success, CASE WHEN doc_id % 3 = 0 THEN '/out/' || doc_id || '-' || 'md' ELSE '/in/' || doc_id || '.md' END AS target_path FROM documents""")
def convert_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of even documents are there; only every third file's directory lets them be overwritten."""
    docs = read(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    third = F.col("doc_id") % 3 == 0
    path = F.concat(F.when(third, F.lit("/in/third/")).otherwise(F.lit("/in/")), ident, F.lit(".txt"))
    files = docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("data"))
    there = docs.filter("doc_id % 2 = 0").select(F.when(third, F.concat(F.lit("/out/"), ident, F.lit("-md"))).otherwise(F.concat(F.lit("/in/"), ident, F.lit(".md"))).alias("path"))
    near = {"/in/third": {"output.directory": "/out", "output.filename_pattern": "{name}-{ext}", "output.overwrite": True}}
    got = convert(files, ["md"], directories=near, existing=there)
    return got.select(F.replace("result.source_path", F.lit("/third"), F.lit("")).alias("source_path"), "result.success", "result.target_path")


@query("title_from_filename", "SELECT c_custkey, 'c' || c_custkey AS title FROM customer")
def title_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    files = c.select(F.concat(F.lit("/d/c"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), F.encode("c_name", "UTF-8").alias("data"))
    books = convert(files, ["mobi"], config={"documents.title_from_filename": True}).select(F.regexp_extract("result.source_path", r"(\d+)", 1).cast("long").alias("c_custkey"), F.col("output").alias("data"))
    return columns.read_documents(books, "mobi", keep=("c_custkey",)).select("c_custkey", F.col("metadata")["title"].alias("title"))


@query("epub_metadata", "SELECT c_custkey, 'T (' || c_name || ')' AS title, c_mktsegment AS author, 'en' AS language FROM customer")
def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = columns.write_documents(customer_docs(spark, sf_dir), "epub", keep=("c_custkey",))
    back = columns.read_documents(books, "epub", data_col="output", keep=("c_custkey",))
    return back.select("c_custkey", *[F.col("metadata")[x].alias(x) for x in ("title", "author", "language")])
