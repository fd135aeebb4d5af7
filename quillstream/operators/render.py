"""Writers of text formats as Catalyst expressions: metadata and content -> one string.

What a text, HTML or Markdown rendering looks like depends on the family the document was read
from; STYLES has what differs. ``rich_*`` render the whole block vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import escape_html, escape_rtf, hex_to_rgb, underline


@dataclass(frozen=True)
class Style:
    txt_title: bool = False
    txt_author: bool = False
    txt_heading: str = "hash"  # hash, double (upper case over =) or rule (upper case over -)
    html_title: bool = False
    html_intro: bool = False  # title and author at the head of the body
    md_title: bool = False
    md_author: bool = False
    md_deeper: int = 0
    text_blocks: bool = False  # html and md render ``text`` blocks
    apostrophe: str = "&#39;"


_BOOK = dict(txt_title=True, txt_author=True, txt_heading="rule", html_title=True, html_intro=True, md_title=True, md_author=True, md_deeper=1)
STYLES = {
    "txt": Style(text_blocks=True),
    "rtf": Style(text_blocks=True),
    "pdf": Style(html_title=True, md_title=True, md_author=True),
    "md": Style(txt_heading="double"),
    "html": Style(txt_title=True, txt_heading="rule", md_title=True),
    "docx": Style(txt_title=True, txt_heading="rule", html_title=True, md_title=True, md_author=True),
    "odt": Style(**_BOOK),
    "epub": Style(**_BOOK),
    "fb2": Style(**_BOOK),
    "azw3": Style(**_BOOK, apostrophe="&#x27;"),
}
STYLES |= {"markdown": STYLES["md"], "htm": STYLES["html"], "doc": STYLES["docx"], "azw": STYLES["azw3"], "mobi": STYLES["azw3"]}


#: The tags that begin every page.
PAGE_TOP = ("!DOCTYPE html", "html", "head", 'meta charset="utf-8"')
_FACES = (("swiss", "Arial"), ("modern", "Courier New"))
_INKS = ((0, 0, 0), (255, 0, 0), (0, 0, 255), (0, 128, 0))
RTF_FONTS = "{\\fonttbl" + "".join(f"{{\\f{k}\\f{kind} {face};}}" for k, (kind, face) in enumerate(_FACES)) + "}"
RTF_COLORS = "{\\colortbl;" + "".join(f"\\red{r}\\green{g}\\blue{b};" for r, g, b in _INKS) + "}"


def has(metadata: Column, key: str) -> Column:
    return F.coalesce(metadata[key] != "", F.lit(False))


def _if(flag: Column, value: Column) -> Column:
    return F.when(flag, value).otherwise(F.lit(""))


def _lines(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _txt_head(metadata: Column, title: bool, author: bool) -> list[Column]:
    out = []
    if title:
        t = metadata["title"]
        out.append(_if(has(metadata, "title"), F.concat(t, F.lit("\n"), underline(t, "="), F.lit("\n\n"))))
    if author:
        out.append(_if(has(metadata, "author"), F.concat(F.lit("By: "), metadata["author"], F.lit("\n\n"))))
    return out


def _ruled(data: Column, before: str, sign: str) -> Column:
    return F.concat(F.lit(before), F.upper(data), F.lit("\n"), underline(data, sign), F.lit("\n\n"))


def _hashed(data: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), data, F.lit("\n\n"))


def txt(metadata: Column, content: Column, family: str = "txt") -> Column:
    s = STYLES[family]
    head = {"hash": lambda b: _hashed(b["data"], b["level"]), "double": lambda b: _ruled(b["data"], "", "="), "rule": lambda b: _ruled(b["data"], "\n", "-")}[s.txt_heading]
    one = lambda b: F.when(b["type"].isin("text", "paragraph"), F.concat(b["data"], F.lit("\n\n"))).when(b["type"] == "heading", head(b)).otherwise(F.lit(""))
    return F.concat(*_txt_head(metadata, s.txt_title, s.txt_author), F.array_join(F.transform(content, one), ""))


def _page(metadata: Column, body: Column, s: Style) -> Column:
    esc = lambda c: escape_html(c, s.apostrophe)
    title = F.when(has(metadata, "title"), esc(metadata["title"])).otherwise(F.lit("Document")) if s.html_title else F.lit("Document")
    intro = []
    if s.html_intro:
        intro = [
            F.when(has(metadata, "title"), F.concat(F.lit("<h1>"), esc(metadata["title"]), F.lit("</h1>"))),
            F.when(has(metadata, "author"), F.concat(F.lit("<p><em>By "), esc(metadata["author"]), F.lit("</em></p>"))),
        ]
    top = [F.lit(f"<{x}>") for x in PAGE_TOP]
    head = _lines(*top, F.concat(F.lit("<title>"), title, F.lit("</title>")), F.lit("</head>"), F.lit("<body>"), *intro)
    return F.array_join(F.concat(head, F.array_compact(body), F.array(F.lit("</body>"), F.lit("</html>"))), "\n")


def _tag(name: Column | str, inner: Column) -> Column:
    n = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("<"), n, F.lit(">"), inner, F.lit("</"), n, F.lit(">"))


def html(metadata: Column, content: Column, family: str = "txt") -> Column:
    s = STYLES[family]
    shown = ["paragraph", "text"] if s.text_blocks else ["paragraph"]
    esc = lambda b: escape_html(b["data"], s.apostrophe)
    one = lambda b: F.when(b["type"].isin(shown), _tag("p", esc(b))).when(b["type"] == "heading", _tag(F.concat(F.lit("h"), b["level"].cast("string")), esc(b)))
    return _page(metadata, F.transform(content, one), s)


def _md_head(metadata: Column, title: bool, author: bool) -> list[Column]:
    out = []
    if title:
        out.append(_if(has(metadata, "title"), F.concat(F.lit("# "), metadata["title"], F.lit("\n\n"))))
    if author:
        out.append(_if(has(metadata, "author"), F.concat(F.lit("**Author:** "), metadata["author"], F.lit("\n\n"))))
    return out


def md(metadata: Column, content: Column, family: str = "txt") -> Column:
    s = STYLES[family]
    shown = ["paragraph", "text"] if s.text_blocks else ["paragraph"]
    one = lambda b: F.when(b["type"].isin(shown), F.concat(b["data"], F.lit("\n\n"))).when(b["type"] == "heading", _hashed(b["data"], b["level"] + s.md_deeper)).otherwise(F.lit(""))
    return F.concat(*_md_head(metadata, s.md_title, s.md_author), F.array_join(F.transform(content, one), ""))


# --- the whole vocabulary ---------------------------------------------------------------------


def _wrapped(data: Column, flag: Column, before: str, after: str | None = None) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(before), data, F.lit(before if after is None else after))).otherwise(data)


def _items(b: Column, bullet: str) -> Column:
    numbered = F.coalesce(b["ordered"], F.lit(False))
    mark = lambda i: F.when(numbered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit(bullet))
    return F.concat(F.array_join(F.transform(b["items"], lambda x, i: F.concat(mark(i), x, F.lit("\n"))), ""), F.lit("\n"))


def _headed(b: Column) -> Column:
    return F.coalesce(F.size(b["headers"]) > 0, F.lit(False))


def rich_txt(metadata: Column, content: Column) -> Column:
    def one(b: Column) -> Column:
        run = _wrapped(_wrapped(b["data"], b["bold"], "**"), b["italic"], "*")
        names = F.array_join(b["headers"], " | ")
        head = _if(_headed(b), F.concat(names, F.lit("\n"), underline(names, "-"), F.lit("\n")))
        rows = F.array_join(F.transform(b["rows"], lambda r: F.concat(F.array_join(r, " | "), F.lit("\n"))), "")
        kind = b["type"]
        return (
            F.when(kind.isin("text", "paragraph"), F.concat(b["data"], F.lit("\n\n")))
            .when(kind == "heading", _ruled(b["data"], "\n", "-"))
            .when(kind == "run", run)
            .when(kind == "table", F.concat(head, rows, F.lit("\n")))
            .when(kind == "list", _items(b, "• "))
            .when(kind == "link", F.concat(b["data"], F.lit(" ("), b["url"], F.lit(")\n")))
            .when(kind == "image", F.concat(F.lit("[Image: "), b["name"], F.lit("]\n")))
            .otherwise(F.lit(""))
        )

    return F.concat(*_txt_head(metadata, True, True), F.array_join(F.transform(content, one), ""))


def rich_md(metadata: Column, content: Column) -> Column:
    def row(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"))

    def rule(r: Column) -> Column:
        return F.concat(F.lit("|"), F.array_join(F.transform(r, lambda _: F.lit(" --- ")), "|"), F.lit("|\n"))

    def one(b: Column) -> Column:
        run = _wrapped(_wrapped(_wrapped(b["data"], b["bold"], "**"), b["italic"], "*"), b["underline"], "<u>", "</u>")
        first = F.when(_headed(b), b["headers"]).otherwise(F.get(b["rows"], F.lit(0)))
        rest = F.when(_headed(b), b["rows"]).otherwise(F.slice(b["rows"], 2, F.greatest(F.size(b["rows"]) - 1, F.lit(0))))
        head = F.when(first.isNotNull(), F.concat(row(first), rule(first))).otherwise(F.lit(""))
        kind = b["type"]
        return (
            F.when(kind.isin("text", "paragraph"), F.concat(b["data"], F.lit("\n\n")))
            .when(kind == "heading", _hashed(b["data"], b["level"]))
            .when(kind == "run", run)
            .when(kind == "table", F.concat(head, F.array_join(F.transform(rest, row), ""), F.lit("\n")))
            .when(kind == "list", _items(b, "- "))
            .when(kind == "link", F.concat(F.lit("["), b["data"], F.lit("]("), b["url"], F.lit(")\n\n")))
            .when(kind == "image", F.concat(F.lit("!["), b["name"], F.lit("]("), b["name"], F.lit(")\n\n")))
            .otherwise(F.lit(""))
        )

    return F.concat(*_md_head(metadata, True, True), F.array_join(F.transform(content, one), ""))


def rich_html(metadata: Column, content: Column, images: Column | None = None) -> Column:
    """``images``: map of name to struct<data, format>; images that it lacks aren't shown."""

    def cells(r: Column, tag: str) -> Column:
        return F.array_join(F.transform(r, lambda c: _tag(tag, escape_html(c))), "\n")

    def one(b: Column) -> Column:
        kind, esc = b["type"], escape_html(b["data"])
        span = _wrapped(_wrapped(esc, b["bold"], "<strong>", "</strong>"), b["italic"], "<em>", "</em>")
        css = F.concat_ws(
            "; ",
            F.when(b["underline"], F.lit("text-decoration: underline")),
            F.when(b["color"] != "", F.concat(F.lit("color: "), b["color"])),
            F.when(b["font"] != "", F.concat(F.lit("font-family: "), b["font"])),
            F.when(b["size"] != 0, F.concat(F.lit("font-size: "), b["size"].cast("string"), F.lit("pt"))),
        )
        span = F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'), span, F.lit("</span>"))).otherwise(span)
        head = F.when(_headed(b), F.concat(F.lit("<thead><tr>\n"), cells(b["headers"], "th"), F.lit("\n</tr></thead>")))
        rows = F.array_join(F.transform(b["rows"], lambda r: F.concat_ws("\n", F.lit("<tr>"), F.when(F.size(r) > 0, cells(r, "td")), F.lit("</tr>"))), "\n")
        table = F.concat_ws("\n", F.lit('<table border="1">'), head, F.lit("<tbody>"), F.when(F.size(b["rows"]) > 0, rows), F.lit("</tbody>"), F.lit("</table>"))
        tag = F.when(F.coalesce(b["ordered"], F.lit(False)), F.lit("ol")).otherwise(F.lit("ul"))
        items = F.when(F.size(b["items"]) > 0, F.array_join(F.transform(b["items"], lambda x: _tag("li", escape_html(x))), "\n"))
        listing = F.concat_ws("\n", F.concat(F.lit("<"), tag, F.lit(">")), items, F.concat(F.lit("</"), tag, F.lit(">")))
        anchor = F.concat(F.lit('<p><a href="'), escape_html(b["url"]), F.lit('">'), esc, F.lit("</a></p>"))
        out = F.when(kind.isin("paragraph", "text"), _tag("p", esc)).when(kind == "heading", _tag(F.concat(F.lit("h"), F.least(b["level"], F.lit(6)).cast("string")), esc))
        out = out.when(kind == "run", _tag("p", span)).when(kind == "table", table).when(kind == "list", listing).when(kind == "link", anchor)
        if images is not None:
            shown = F.concat(F.lit('<img src="data:image/'), images[b["name"]]["format"], F.lit(';base64,..." alt="'), escape_html(b["name"]), F.lit('">'))
            out = out.when((kind == "image") & images[b["name"]].isNotNull(), shown)
        return out

    return _page(metadata, F.transform(content, one), Style(html_title=True, html_intro=True))


def pdf_run(b: Column) -> Column:
    """Markup of a run as PDF paragraph writers take it, bold innermost and the size outermost."""
    out = escape_html(b["data"])
    for key, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")):
        out = _wrapped(out, b[key], f"<{tag}>", f"</{tag}>")
    font = lambda key, flag: F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(f'<font {key}="'), b[key].cast("string"), F.lit('">'), out, F.lit("</font>"))).otherwise(out)
    out = font("color", b["color"] != "")
    return font("size", b["size"] != 0)


def rtf(metadata: Column, content: Column) -> Column:
    def info(key: str) -> Column:
        return F.when(has(metadata, key), F.concat(F.lit("{\\" + key + " "), escape_rtf(metadata[key]), F.lit("}")))

    def row(cells: Column, bold: bool) -> Column:
        a, z = ("\\b ", "\\b0\\cell") if bold else ("", "\\cell")
        edges = F.transform(cells, lambda _, i: F.concat(F.lit("\\cellx"), ((i + 1) * 2000).cast("string")))
        texts = F.transform(cells, lambda c: F.concat(F.lit(a), escape_rtf(c), F.lit(z)))
        return F.array_join(F.concat(F.array(F.lit("\\trowd")), edges, F.array(F.lit("\\pard\\intbl")), texts, F.array(F.lit("\\row"))), " ")

    def one(b: Column) -> Column:
        kind, esc = b["type"], escape_rtf(b["data"])
        on = lambda c, mark: _if(F.coalesce(c, F.lit(False)), F.lit(mark))
        colored = b["color"] != ""
        run = F.concat(
            on(b["bold"], "\\b "), on(b["italic"], "\\i "), on(b["underline"], "\\ul "), on(colored & hex_to_rgb(b["color"]).isNotNull(), "\\cf1 "), esc,
            on(b["bold"], "\\b0 "), on(b["italic"], "\\i0 "), on(b["underline"], "\\ul0 "), on(colored, "\\cf0 "),
        )
        rows = F.transform(b["rows"], lambda r: row(r, False))
        table = F.array_join(F.concat(F.when(_headed(b), F.array(row(b["headers"], True))).otherwise(F.array().cast("array<string>")), rows, F.array(F.lit("\\par"))), "\n")
        bullet = lambda i: F.when(F.coalesce(b["ordered"], F.lit(False)), F.concat((i + 1).cast("string"), F.lit("."))).otherwise(F.lit("\\bullet"))
        items = F.transform(b["items"], lambda x, i: F.concat(F.lit("\\pard "), bullet(i), F.lit("\\tab "), escape_rtf(x), F.lit("\\par")))
        return (
            F.when(kind == "heading", F.concat(F.lit("\\pard\\fs"), (32 - b["level"] * 4).cast("string"), F.lit("\\b "), esc, F.lit("\\b0\\fs24\\par")))
            .when(kind.isin("paragraph", "text"), F.concat(F.lit("\\pard "), esc, F.lit("\\par")))
            .when(kind == "run", F.concat(F.lit("\\pard "), run, F.lit("\\par")))
            .when(kind == "table", table)
            .when(kind == "list", F.array_join(F.concat(items, F.array(F.lit("\\par"))), "\n"))
            .when(kind == "link", F.concat(F.lit("\\pard "), esc, F.lit(" (\\cf2 "), escape_rtf(b["url"]), F.lit("\\cf0)\\par")))
        )

    top = _lines(F.lit("{\\rtf1\\ansi\\deff0"), F.lit("{\\info"), info("title"), info("author"), info("subject"), F.lit("}"),
                 F.lit(RTF_FONTS), F.lit(RTF_COLORS))
    return F.array_join(F.concat(top, F.array_compact(F.transform(content, one)), F.array(F.lit("}"))), "\n")
