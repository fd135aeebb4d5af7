"""Conversion of whole tables: a planned chain of reads and writes in one Arrow pass.

``convert`` takes rows (path, data) and gives a row a file with the result struct and the bytes
of the target. Each hop is serialised as its format would be, so what a format can't carry is
lost, as between files. An error is data: a failed row has success = false and the message.
Plain text goes to text, HTML, Markdown and RTF in Catalyst (``quillstream.operators.render``)
and doesn't enter Python; the pass through Python is for what needs a parser, a codec or a registered converter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillstream.errors import NoRouteError
from quillstream.functions import text as fn
from quillstream.model import make
from quillstream.operators import render
from quillstream.operators.blocks import merge_config
from quillstream.operators.render import PAGE_TOP, RTF_COLORS, RTF_FONTS, STYLES, Style
from quillstream.plans import graph
from quillstream.sources import containers, markup, palm, plain

SUFFIX = {"markdown": "md", "htm": "html"}


def read_txt(text: str) -> dict:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return {"metadata": {}, "content": [make("paragraph", data=p.strip()) for p in text.split("\n\n") if p.strip()]}


def read_titled_txt(text: str) -> dict:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    metadata = {}
    if len(lines) > 1 and lines[1].strip() and set(lines[1].strip()) == {"="}:
        metadata["title"] = lines[0].strip()
        n = 2
        if len(lines) > 2 and lines[2].strip().startswith("By:"):
            metadata["author"] = lines[2].strip()[3:].strip()
            n = 3
        lines = lines[n:]
    return {"metadata": metadata, "content": read_txt("\n".join(lines))["content"]}


def read(fmt: str, data: bytes, target: str, encoding: str = "utf-8") -> dict:
    """A document for a converter from ``fmt`` to ``target``; readers differ by what is written."""
    if fmt == "txt":
        return (read_titled_txt if target in ("mobi", "azw3") else read_txt)(data.decode(encoding))
    if fmt in ("md", "markdown"):
        return markup.read_markdown(data.decode(encoding))
    if fmt in ("html", "htm"):
        return markup.read_html(data.decode(encoding), rich=target == "pdf", first_heading=target != "mobi")
    if fmt in ("docx", "doc"):
        return containers.read_docx(data)
    if fmt == "pdf":
        return containers.read_pdf(data, by_line=target == "epub")
    return {"rtf": containers.read_rtf, "odt": containers.read_odt, "epub": containers.read_epub, "fb2": containers.read_fb2}.get(fmt, palm.read_palm)(data)


def _text_page(doc: dict, s: Style, target: str) -> str:
    m, out = doc["metadata"], []
    esc = lambda x: escape(x).replace("&#x27;", s.apostrophe)
    title, author = m.get("title"), m.get("author")
    shown = ("paragraph", "text") if s.text_blocks or target == "txt" else ("paragraph",)
    if target == "html":
        out = [f"<{x}>" for x in PAGE_TOP] + [f"<title>{esc(title) if s.html_title and title else 'Document'}</title>", "</head>", "<body>"]
        if s.html_intro:
            out += [f"<h1>{esc(title)}</h1>"] if title else []
            out += [f"<p><em>By {esc(author)}</em></p>"] if author else []
        for b in doc["content"]:
            tag = "p" if b["type"] in shown else f"h{b['level']}" if b["type"] == "heading" else ""
            out += [f"<{tag}>{esc(b['data'])}</{tag}>"] if tag else []
        return "\n".join([*out, "</body>", "</html>"])
    if target == "txt":
        out += [f"{title}\n{'=' * len(title)}\n\n"] if s.txt_title and title else []
        out += [f"By: {author}\n\n"] if s.txt_author and author else []
    else:
        out += [f"# {title}\n\n"] if s.md_title and title else []
        out += [f"**Author:** {author}\n\n"] if s.md_author and author else []
    for b in doc["content"]:
        d = b["data"]
        if b["type"] in shown:
            out.append(f"{d}\n\n")
        elif b["type"] == "heading":
            if target == "md" or s.txt_heading == "hash":
                out.append("#" * (b["level"] + (s.md_deeper if target == "md" else 0)) + f" {d}\n\n")
            else:
                sign, lead = ("=", "") if s.txt_heading == "double" else ("-", "\n")
                out.append(f"{lead}{d.upper()}\n{sign * len(d)}\n\n")
    return "".join(out)


def _rtf(doc: dict) -> str:
    esc = lambda x: str(x).replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}")
    m, out = doc["metadata"], ["{\\rtf1\\ansi\\deff0", "{\\info"]
    out += [f"{{\\{k} {esc(m[k])}}}" for k in ("title", "author", "subject") if m.get(k)]
    out += ["}", RTF_FONTS, RTF_COLORS]
    for b in doc["content"]:
        if b["type"] == "heading":
            out.append(f"\\pard\\fs{32 - 4 * b['level']}\\b {esc(b['data'])}\\b0\\fs24\\par")
        elif b["type"] in ("paragraph", "text"):
            out.append(f"\\pard {esc(b['data'])}\\par")
        elif b["type"] == "table":
            for k, r in enumerate(([b["headers"]] if b["headers"] else []) + b["rows"]):
                cells = [f"\\b {esc(c)}\\b0\\cell" if b["headers"] and not k else f"{esc(c)}\\cell" for c in r]
                out.append(" ".join(["\\trowd", *[f"\\cellx{2000 * (j + 1)}" for j in range(len(r))], "\\pard\\intbl", *cells, "\\row"]))
            out.append("\\par")
        elif b["type"] == "list":
            out += [f"\\pard {f'{k}.' if b['ordered'] else chr(92) + 'bullet'}\\tab {esc(x)}\\par" for k, x in enumerate(b["items"], 1)] + ["\\par"]
    return "\n".join([*out, "}"])


def one_hop(data: bytes, src: str, dst: str, stem: str, config: dict) -> bytes:
    """Convert by the first converter of (src, dst); sinks that read HTML go through it."""
    own = graph.converter_of(src, dst)
    if own is not None and own.function is not None:
        return bytes(own.function(data, src, dst, stem, config))
    encoding = config.get("documents.encoding") or "utf-8"
    name = {"title": stem} if config.get("documents.title_from_filename") else {}
    if dst in ("docx", "rtf") or (dst == "pdf" and src not in ("txt", "html")):
        if src in ("html", "htm") and not config.get("html_to_rich"):
            raise NoRouteError("Conversion failed: no HTML intermediate for an HTML source")
        page = data.decode(encoding) if src in ("html", "htm") else one_hop(data, src, "html", stem, config).decode()
        doc = markup.read_html(page, rich=True)
    else:
        doc = read(src, data, dst, encoding)
    doc = {**doc, "metadata": doc["metadata"] | name}
    if dst in ("txt", "html", "md"):
        return _text_page(doc, STYLES[src], dst).encode()
    if dst == "rtf":
        return _rtf(doc).encode()
    m, blocks = doc["metadata"], doc["content"]
    if dst == "mobi":
        return palm.write_mobi(m, blocks, images=doc.get("images"))
    if dst == "azw3":
        return palm.write_azw3(m, blocks, stem, images=doc.get("images"))
    if dst == "pdf":
        return containers.write_pdf(m, blocks, stem, page_size=config.get("documents.pdf.page_size") or "A4")
    if dst == "epub":
        return (containers.write_paged_epub if src == "pdf" else containers.write_epub)(m, blocks, stem)
    if dst not in ("fb2", "docx"):
        raise NoRouteError(f"No converter found for {src} -> {dst}")
    return {"fb2": containers.write_fb2, "docx": containers.write_docx}[dst](m, blocks, stem)


def plan(src: str, dst: str) -> list[str] | None:
    """The chain of formats, or None where there is no converter (equal formats other than txt too)."""
    way = graph.find_path(src, dst)
    return way if way and len(way) > 1 else None


def _settings(values: dict) -> Column:
    """Dotted keys and their values as JSON."""
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, json.dumps(v))]).cast("map<string,string>")


def _row_config(path: Column, config: dict, directories: dict[str, dict], overrides: dict) -> Column:
    """The resolved settings of a file: config, then its nearest directory's, then overrides."""
    out = _settings({"output.directory": None, "output.filename_pattern": "{name}.{ext}", "output.overwrite": False, **config})
    if directories:
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        known = F.create_map(*[x for d, v in directories.items() for x in (F.lit(d.rstrip("/")), _settings(v))])
        near = F.try_element_at(F.filter(above, lambda d: F.array_contains(F.map_keys(known), d)), F.lit(-1))
        out = merge_config(out, F.coalesce(F.try_element_at(known, near), F.create_map().cast("map<string,string>")))
    return merge_config(out, _settings(overrides)) if overrides else out


def _value(settings: Column, key: str) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), settings[key], F.lit("}")), "$.v")


def _in_catalyst(src: Column, dst: Column, data: Column, settings: Column) -> Column:
    """The target's bytes where plain text can be written without leaving Catalyst, else null."""
    text = data.cast("string")
    content, nothing = plain.read_txt(text), F.create_map().cast("map<string,string>")
    forms = {"txt": render.txt(nothing, content), "html": render.html(nothing, content), "md": render.md(nothing, content), "rtf": render.rtf(F.create_map(F.lit("title"), F.lit("Document")), content)}
    own = {dst for dst in forms if (c := graph.converter_of("txt", dst)) is not None and c.function is not None}
    usual = F.coalesce(_value(settings, "documents.encoding"), F.lit("utf-8")).isin("utf-8", "UTF-8", "utf8") & (F.coalesce(_value(settings, "documents.title_from_filename"), F.lit("false")) == "false")
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        if name not in own:
            out = F.when((dst == name) & (src == "txt") & usual & F.is_valid_utf8(text), form).otherwise(out)
    return F.encode(out, "UTF-8")


def convert(
    files: DataFrame, targets: list[str], *, path_col: str = "path", data_col: str = "data", config: dict | None = None, directories: dict[str, dict] | None = None,
    overrides: dict | None = None, existing: DataFrame | None = None, keep_intermediate: bool = False,
) -> DataFrame:
    """Rows x targets: ``result`` (the result struct) and ``output`` (bytes, null on failure).

    ``files``: path and binary data. ``config`` and ``overrides``: dotted keys, of them
    ``output.directory``, ``output.filename_pattern`` and ``output.overwrite``; ``directories`` has
    the keys of single directories, of which the nearest at or above a file counts. ``existing``:
    paths (column ``path``) that are taken; without overwrite those rows fail. With
    ``keep_intermediate`` a third column has (path, data) of the files between. Null data fails;
    nothing raises.
    """
    name = F.element_at(F.split(path_col, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    work = files.select(F.col(path_col).alias("path"), F.col(data_col).alias("data"), F.explode(F.array(*[F.lit(t.lower().lstrip(".")) for t in targets])).alias("dst"), stem.alias("stem"))
    work = work.withColumn("settings", _row_config(F.col("path"), config or {}, directories or {}, overrides or {})).withColumn("src", fn.suffix_format(F.col("path")))
    folder = F.coalesce(_value(F.col("settings"), "output.directory"), F.regexp_replace("path", "/?[^/]*$", ""))
    folder = F.regexp_replace(folder, "(?<=.)/+$", "")
    place = fn.filename(_value(F.col("settings"), "output.filename_pattern"), F.col("stem"), F.col("dst"))
    work = work.withColumn("target", F.concat_ws("/", F.when(folder != "", folder), place))
    if existing is not None:
        taken = existing.select(F.col("path").alias("target")).distinct().withColumn("there", F.lit(True))
        work = work.join(taken, "target", "left").withColumn("taken", F.col("there") & (_value(F.col("settings"), "output.overwrite") != "true"))
    else:
        work = work.withColumn("taken", F.lit(None).cast("boolean"))
    work = work.withColumn("made", _in_catalyst(F.col("src"), F.col("dst"), F.col("data"), F.col("settings")))
    # what is made already needn't travel
    work = work.withColumn("data", F.when(F.col("made").isNull() & ~F.coalesce("taken", F.lit(False)), F.col("data")))
    known = list(graph.CONVERTERS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from quillstream.sources.columns import slices

        graph.restore(known)
        for whole in batches:
            for at, n in slices(whole[1]):
                rows = []
                for path, data, src, dst, stem, target, taken, made, settings in zip(*(c.slice(at, n).to_pylist() for c in whole)):
                    way, out, error, between = plan(src, dst), None, None, []
                    if way is None:
                        error = f"No converter found for {src} -> {dst}"
                    elif taken is True:
                        error = f"Target file already exists: {target}"
                    elif not made:
                        try:
                            if data is None:
                                raise ValueError("no data")
                            cfg, out = {k: json.loads(v) for k, v in settings}, data
                            for a, b in zip(way, way[1:]):
                                out = one_hop(out, a, b, stem, cfg)
                                if keep_intermediate:
                                    between.append((f"{path.rpartition('/')[0]}/{stem}_intermediate.{b}", out))
                        except Exception as e:  # noqa: BLE001 - a file's error is its result
                            out, error = None, str(e) or type(e).__name__
                    rows.append((error is None, target if way else None, error, way, len(way) - 1 if way else 0, out, between[:-1] if error is None else []))
                yield pa.array(rows, kind)

    schema = "struct<success:boolean,target_path:string,error:string,conversion_path:array<string>,hops:int,output:binary,intermediates:array<struct<path:string,data:binary>>>"
    kind = to_arrow_type(StructType.fromDDL(f"x {schema}").fields[0].dataType)
    # a function of columns, not of rows: what Catalyst made stays out of Python, and results leave it in small pieces
    go = F.arrow_udf(run, schema, ArrowUDFType.SCALAR_ITER).asNondeterministic()
    work = work.withColumn("r", go("path", "data", "src", "dst", "stem", "target", "taken", F.col("made").isNotNull(), "settings"))
    result = F.struct("r.success", F.col("path").alias("source_path"), "r.target_path", "r.error", "r.conversion_path", "r.hops").alias("result")
    output = F.when(F.col("r.success"), F.coalesce("made", "r.output")).alias("output")
    return work.select(result, output, *[F.col("r.intermediates").alias("intermediates")] * keep_intermediate)


def stem_of(path: str) -> str:
    return PurePosixPath(path).stem
