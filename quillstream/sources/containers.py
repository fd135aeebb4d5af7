"""Readers and writers of container formats, as plain functions on bytes.

Writers take metadata, blocks, a default title and a time (seconds), and give the same bytes for
the same input: ids come from hashes of the content.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable
from datetime import datetime, timezone
from html import escape
from posixpath import dirname, join
from xml.etree import ElementTree as ET

from quillstream.model import make
from quillstream.sources.markup import basic_blocks, parse

XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
FB2 = "http://www.gribuser.ru/xml/fictionbook/2.0"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
DC = "http://purl.org/dc/elements/1.1/"


_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


def _deflated(data: bytes) -> bytes:
    z = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def _zip(files: list[tuple[str, str | bytes, bool]]) -> bytes:
    """The bytes that zipfile makes of small archives with ASCII names; zipfile itself makes the others."""
    if len(files) > 0xFFFF or not all(name.isascii() for name, _, _ in files) or sum(len(data) for _, data, _ in files) > 1 << 28:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data, packed in files:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
        return out.getvalue()
    parts, listed, at = [], [], 0
    for name, data, packed in files:
        raw, label = data.encode() if isinstance(data, str) else bytes(data), name.encode()
        body, method, crc = _deflated(raw) if packed else raw, 8 if packed else 0, zlib.crc32(raw)
        parts += [_LOCAL.pack(b"PK\3\4", 20, 0, method, 0, 33, crc, len(body), len(raw), len(label), 0), label, body]
        listed += [_CENTRAL.pack(b"PK\1\2", 20 | 3 << 8, 20, 0, method, 0, 33, crc, len(body), len(raw), len(label), 0, 0, 0, 0, 0o600 << 16, at), label]
        at += 30 + len(label) + len(body)
    listing = b"".join(listed)
    return b"".join([*parts, listing, _END.pack(b"PK\5\6", 0, 0, len(files), len(files), len(listing), at, 0)])


def _taker(z: zipfile.ZipFile, data: bytes) -> Callable[[str], bytes]:
    """Reads members of an archive that lies in ``data``: plain Flate at once, all else as zipfile does."""

    def take(name: str) -> bytes:
        i = z.getinfo(name)
        at = i.header_offset
        if i.compress_type != zipfile.ZIP_DEFLATED or i.flag_bits & 0x61 or data[at : at + 4] != b"PK\3\4" or i.compress_size > 1 << 28:
            return z.read(name)
        label = int.from_bytes(data[at + 26 : at + 28], "little")
        at += 30 + label + int.from_bytes(data[at + 28 : at + 30], "little")
        try:
            out = zlib.decompress(data[at : at + i.compress_size], -15, i.file_size)
        except zlib.error:
            return z.read(name)
        return out if len(out) == i.file_size and zlib.crc32(out) == i.CRC else z.read(name)

    return take


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first(root: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in root.iter() if _local(e) == name), None)


def _esc(s: str) -> str:
    return escape(s).replace("&#x27;", "&#39;")


# --- EPUB -----------------------------------------------------------------------------------------


def chapters_of(blocks: list[dict]) -> list[tuple[str, str]]:
    """(title, body) of each chapter; bodies and titles are paired by position (see zipped_titles)."""
    bodies: list[list[str]] = []
    titles: list[str] = []
    now: list[str] = []
    for b in blocks:
        if b["type"] not in ("paragraph", "heading"):
            continue
        tag = f"h{b['level']}" if b["type"] == "heading" else "p"
        if tag == "h1":
            if now:
                bodies.append(now)
                now = []
            titles.append(b["data"])
        now.append(f"<{tag}>{_esc(b['data'])}</{tag}>")
    if now:
        bodies.append(now)
    if not bodies:
        return [("Content", "<p>No content</p>")]
    return list(zip(titles or [f"Chapter {k + 1}" for k in range(len(bodies))], map("".join, bodies)))


def el(name: str, *inside: str, **attrs: str) -> str:
    """An element; ``_`` in an attribute's name stands for ``-`` and ``__`` for ``:``."""
    given = "".join([f' {k.replace("__", ":").replace("_", "-")}="{v}"' for k, v in attrs.items()]) if attrs else ""
    return f"<{name}{given}>{''.join(inside)}</{name}>" if inside else f"<{name}{given}/>"


_OPF = "OEBPS/content.opf"
_NS = {"container": "urn:oasis:names:tc:opendocument:xmlns:container", "opf": "http://www.idpf.org/2007/opf", "ncx": "http://www.daisy.org/z3986/2005/ncx/", "html": "http://www.w3.org/1999/xhtml"}


def _mime(kind: str) -> str:
    return f"application/{kind}+xml"


def write_epub(metadata: dict, blocks: list[dict], title: str = "Unknown", seconds: int = 0, chapters: list[tuple[str, str]] | None = None) -> bytes:
    name, author, lang = metadata.get("title", title), metadata.get("author", "Unknown"), metadata.get("language", "en")
    parts = chapters_of(blocks) if chapters is None else chapters
    uid = str(uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16]))
    stamp = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    root = el("rootfile", full_path=_OPF, media_type=_mime("oebps-package"))
    files: list[tuple[str, str | bytes, bool]] = [
        ("mimetype", "application/epub+zip", False),
        ("META-INF/container.xml", XML + el("container", el("rootfiles", root), version="1.0", xmlns=_NS["container"]), True),
    ]
    items, refs, points = [el("item", id="ncx", href="toc.ncx", media_type=_mime("x-dtbncx"))], [], []
    for k, (label, body) in enumerate(parts, 1):
        file, text = f"chap_{k:02d}.xhtml", _esc(label)
        items.append(el("item", id=f"chapter{k}", href=file, media_type=_mime("xhtml")))
        refs.append(el("itemref", idref=f"chapter{k}"))
        points.append(el("navPoint", el("navLabel", el("text", text)), el("content", src=file), id=f"navPoint-{k}", playOrder=str(k)))
        page = el("html", el("head", el("title", text)), el("body", body), xmlns=_NS["html"])
        files.append((f"OEBPS/{file}", f"{XML}<!DOCTYPE html>\n{page}", True))
    about = [el("dc:identifier", uid, id="uid"), el("dc:title", _esc(name)), el("dc:creator", _esc(author)), el("dc:language", _esc(lang)), el("meta", stamp, property="dcterms:modified")]
    opf = el("package", el("metadata", *about, xmlns__dc=DC), el("manifest", *items), el("spine", *refs, toc="ncx"), xmlns=_NS["opf"], version="3.0", unique_identifier="uid")
    head = "<head>" + "".join(f'<meta name="dtb:{n}" content="{v}"/>' for n, v in (("uid", uid), ("depth", "1"))) + "</head>"
    ncx = el("ncx", head, el("docTitle", el("text", _esc(name))), el("navMap", *points), xmlns=_NS["ncx"], version="2005-1")
    files += [(_OPF, XML + opf, True), ("OEBPS/toc.ncx", XML + ncx, True)]
    return _zip(files)


def write_paged_epub(metadata: dict, blocks: list[dict], title: str = "Unknown", seconds: int = 0) -> bytes:
    """One chapter for a whole document of pages."""
    body = "".join(f"<p>{_esc(b['data'])}</p>" for b in blocks if b["type"] == "paragraph")
    return write_epub(metadata, blocks, title, seconds, [(metadata.get("title", title), body)])


def read_epub(data: bytes) -> dict:
    metadata, content, images = {}, [], {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        take = _taker(z, data)
        opf_path = _first(ET.fromstring(take("META-INF/container.xml")), "rootfile").get("full-path")
        opf, base = ET.fromstring(take(opf_path)), dirname(opf_path)
        found: dict[str, list[ET.Element]] = {}
        for e in opf.iter():
            found.setdefault(_local(e), []).append(e)
        for name, key in (("title", "title"), ("creator", "author"), ("language", "language"), ("description", "description"), ("publisher", "publisher"), ("subject", "subject"), ("date", "date")):
            e = found[name][0] if name in found else None
            if e is not None and e.text:
                metadata[key] = e.text if key in ("title", "author", "language") else e.text.strip()
        items = found.get("item", [])
        manifest = {e.get("id"): e for e in items}
        cover = next((e.get("content") for e in found.get("meta", ()) if e.get("name") == "cover"), None)
        cover = cover or next((e.get("id") for e in items if "cover-image" in (e.get("properties") or "")), None)
        if cover in manifest:
            try:
                kind = (manifest[cover].get("media-type") or "").rpartition("/")[2].replace("jpeg", "jpg")
                images["cover"] = {"data": take(join(base, manifest[cover].get("href"))), "format": kind or "jpg"}
            except KeyError:
                images.clear()
        for ref in found.get("itemref", ()):
            item = manifest.get(ref.get("idref"))
            if item is None:
                continue
            try:
                page = take(join(base, item.get("href"))).decode("utf-8", "ignore")
            except KeyError:  # an item that isn't there is skipped
                continue
            content += basic_blocks(parse(page), False)
    return {"metadata": metadata, "content": content, "images": images}


# --- FB2 ------------------------------------------------------------------------------------------


def write_fb2(metadata: dict, blocks: list[dict], title: str = "Unknown", seconds: int = 0) -> bytes:
    ET.register_namespace("", FB2)
    q = lambda n: f"{{{FB2}}}{n}"
    root = ET.Element(q("FictionBook"))
    info = ET.SubElement(ET.SubElement(root, q("description")), q("title-info"))
    ET.SubElement(info, q("book-title")).text = metadata.get("title", title)
    ET.SubElement(ET.SubElement(info, q("author")), q("first-name")).text = metadata.get("author", "Unknown")
    ET.SubElement(info, q("lang")).text = metadata.get("language", "en")
    body = at = ET.SubElement(root, q("body"))
    for b in blocks:
        if b["type"] == "heading":
            at = ET.SubElement(body, q("section"))
            ET.SubElement(ET.SubElement(at, q("title")), q("p")).text = b["data"]
        elif b["type"] == "paragraph":
            ET.SubElement(at, q("p")).text = b["data"]
    ET.indent(root)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _fb2_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        out += [_fb2_text(c), c.tail or ""]
    return "".join(out).strip()


def read_fb2(data: bytes) -> dict:
    root, metadata, content = ET.fromstring(data), {}, []
    info = _first(root, "title-info")
    if info is not None:
        t = _first(info, "book-title")
        if t is not None and t.text:
            metadata["title"] = t.text
        names = []
        for a in (e for e in info if _local(e) == "author"):
            parts = {_local(c): c.text for c in a}
            if name := " ".join(x for x in (parts.get("first-name"), parts.get("last-name")) if x):
                names.append(name)
        if names:
            metadata["author"] = ", ".join(names)
        lang = _first(info, "lang")
        if lang is not None and lang.text:
            metadata["language"] = lang.text

    def section(e: ET.Element, level: int) -> None:
        for c in e:
            kind = _local(c)
            if kind == "title":
                for p in c:
                    if _local(p) == "p" and p.text:
                        content.append(make("heading", data=p.text, level=level))
            elif kind == "section":
                section(c, level + 1)
            elif kind == "p":
                if text := _fb2_text(c):
                    content.append(make("paragraph", data=text))
            elif kind in ("poem", "cite"):
                content.extend(make("paragraph", data=t) for p in c.iter() if _local(p) == "p" and (t := _fb2_text(p)))

    for body in (e for e in root if _local(e) == "body"):
        for e in body:
            if _local(e) == "section":
                section(e, 1)
            elif _local(e) == "p" and (t := _fb2_text(e)):
                content.append(make("paragraph", data=t))
    return {"metadata": metadata, "content": content}


# --- ODT ------------------------------------------------------------------------------------------


def read_odt(data: bytes) -> dict:
    metadata, content = {}, []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        try:
            meta = ET.fromstring(z.read("meta.xml"))
            for name, key in (("title", "title"), ("creator", "author")):
                e = meta.find(f".//{{{DC}}}{name}")
                if e is not None and e.text:
                    metadata[key] = e.text
        except (KeyError, ET.ParseError):
            metadata.clear()
        body = ET.fromstring(z.read("content.xml")).find(f".//{{{OFFICE}}}body/{{{OFFICE}}}text")
    for e in body if body is not None else ():
        text = "".join(e.itertext()).strip()
        if not text or e.tag not in (f"{{{TEXT}}}h", f"{{{TEXT}}}p"):
            continue
        style = e.get(f"{{{TEXT}}}style-name", "")
        if _local(e) == "h":
            content.append(make("heading", data=text, level=int(e.get(f"{{{TEXT}}}outline-level") or 1)))
        elif "heading" in style.lower():
            content.append(make("heading", data=text, level=next((k for k in (2, 3, 4) if str(k) in style), 1)))
        else:
            content.append(make("paragraph", data=text))
    return {"metadata": metadata, "content": content}


# --- pictures -------------------------------------------------------------------------------------


def picture_size(data: bytes) -> tuple[str, int, int] | None:
    """(jpeg or png, width, height) of a picture, None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:3] == b"\xff\xd8\xff" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + size
    return None


def _pictures(blocks: list[dict], images: dict | None) -> dict[str, tuple[bytes, str, int, int]]:
    """The pictures that image blocks name and that are there, by name: data, kind, width, height."""
    out = {}
    for b in blocks:
        held = (images or {}).get(b["name"]) if b["type"] == "image" else None
        data = bytes((held or {}).get("data") or b"")
        if held and (size := picture_size(data)) and size[1] and size[2]:
            out[b["name"]] = (data, *size)
    return out


# --- DOCX -----------------------------------------------------------------------------------------

_CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFF = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _wp(text: str, style: str = "", props: str = "") -> str:
    lead = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{lead}<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _wpicture(k: int, name: str, wide: int, high: int) -> str:
    """A picture four inches wide, in a paragraph of its own."""
    cx = 4 * 914_400
    a, pic = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
    size = f'cx="{cx}" cy="{cx * high // wide}"'
    shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr>'
    inner = f'<pic:pic xmlns:pic="{pic}"><pic:nvPicPr><pic:cNvPr id="{k}" name="{escape(name)}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rIdP{k}" xmlns:r="{_OFF}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>{shape}</pic:pic>'
    drawing = f'<wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent {size}/><wp:docPr id="{k}" name="{escape(name)}"/><a:graphic xmlns:a="{a}"><a:graphicData uri="{pic}">{inner}</a:graphicData></a:graphic></wp:inline>'
    return f"<w:p><w:r><w:drawing>{drawing}</w:drawing></w:r></w:p>"


def write_docx(metadata: dict, blocks: list[dict], title: str = "Unknown", seconds: int = 0, images: dict | None = None) -> bytes:
    out, pictures = [], _pictures(blocks, images)
    number = {name: k for k, name in enumerate(pictures, 1)}
    for b in blocks:
        data = b["data"] or ""
        if b["type"] == "heading":
            out.append(_wp(data, f"Heading{min(b['level'], 9)}"))
        elif b["type"] in ("paragraph", "text"):
            out.append(_wp(data))
        elif b["type"] == "run":
            props = "".join(f"<w:{t}/>" for t, on in (("b", b["bold"]), ("i", b["italic"])) if on) + ('<w:u w:val="single"/>' if b["underline"] else "")
            if re.fullmatch("#?[0-9a-fA-F]{6}", b["color"] or ""):
                props += f'<w:color w:val="{b["color"].lstrip("#").upper()}"/>'
            props += f'<w:sz w:val="{2 * b["size"]}"/>' if b["size"] else ""
            out.append(_wp(data, "", props))
        elif b["type"] == "table":
            rows = ([b["headers"]] if b["headers"] else []) + (b["rows"] or [])
            width = len(rows[0]) if rows else 0
            cells = "".join("<w:tr>" + "".join(f"<w:tc>{_wp(str(c))}</w:tc>" for c in r[:width]) + "</w:tr>" for r in rows)
            out.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="LightGridAccent1"/></w:tblPr>{cells}</w:tbl>')
        elif b["type"] == "list":
            out += [_wp(x, "ListNumber" if b["ordered"] else "ListBullet") for x in b["items"] or []]
        elif b["type"] == "link":
            out.append(_wp(f"{data} ({b['url']})", "", '<w:color w:val="0000FF"/>'))
        elif b["type"] == "image" and b["name"] in pictures:
            _, _, wide, high = pictures[b["name"]]
            out.append(_wpicture(number[b["name"]], b["name"], wide, high))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10))
    styles += "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("ListBullet", "List Bullet"), ("ListNumber", "List Number")))
    m = {"title": metadata.get("title", title), "creator": metadata.get("author", ""), "subject": metadata.get("subject", "")}
    core = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in m.items() if v)
    linked = "".join(f'<Relationship Id="rIdP{number[n]}" Type="{_OFF}/image" Target="media/image{number[n]}.{kind}"/>' for n, (_, kind, _, _) in pictures.items())
    types = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-{c}+xml"/>' for p, c in (("/word/document.xml", "officedocument.wordprocessingml.document.main"), ("/word/styles.xml", "officedocument.wordprocessingml.styles"), ("/docProps/core.xml", "package.core-properties")))
    return _zip([
        ("[Content_Types].xml", f'{XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/>{types}</Types>', True),
        ("_rels/.rels", f'{XML}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_OFF}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="{_REL}/metadata/core-properties" Target="docProps/core.xml"/></Relationships>', True),
        ("word/_rels/document.xml.rels", f'{XML}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_OFF}/styles" Target="styles.xml"/>{linked}</Relationships>', True),
        ("word/document.xml", f'{XML}<w:document xmlns:w="{W}"><w:body>{"".join(out)}<w:sectPr/></w:body></w:document>', True),
        ("word/styles.xml", f'{XML}<w:styles xmlns:w="{W}">{styles}</w:styles>', True),
        ("docProps/core.xml", f'{XML}<cp:coreProperties xmlns:cp="{_CORE}" xmlns:dc="{DC}">{core}</cp:coreProperties>', True),
        *((f"word/media/image{number[n]}.{kind}", data, False) for n, (data, kind, _, _) in pictures.items()),
    ])


def read_docx(data: bytes) -> dict:
    """Headings and paragraphs first, then all tables; list paragraphs are skipped."""
    q = lambda n: f"{{{W}}}{n}"
    metadata = {"title": "", "author": "", "subject": ""}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(q("body"))
        names = {}
        if "word/styles.xml" in z.namelist():
            names = {s.get(q("styleId")): s.find(q("name")).get(q("val")) for s in ET.fromstring(z.read("word/styles.xml")).iter(q("style")) if s.find(q("name")) is not None}
        if "docProps/core.xml" in z.namelist():
            core = ET.fromstring(z.read("docProps/core.xml"))
            for name, key in (("title", "title"), ("creator", "author"), ("subject", "subject")):
                e = core.find(f"{{{DC}}}{name}")
                metadata[key] = (e.text or "") if e is not None else ""

    def text(e: ET.Element) -> str:
        return "".join("\n" if t.tag in (q("br"), q("cr")) else "\t" if t.tag == q("tab") else t.text or "" for t in e.iter() if t.tag in (q("t"), q("br"), q("cr"), q("tab")))

    content, tables = [], []
    for e in body:
        if e.tag == q("tbl"):
            rows = [["\n".join(text(p) for p in c.iter(q("p"))).strip() for c in r.findall(q("tc"))] for r in e.findall(q("tr"))]
            tables.append(make("table", headers=rows[0] if len(rows) > 1 else None, rows=rows[1:]))
        if e.tag != q("p") or not text(e).strip():
            continue
        style = e.find(f"{q('pPr')}/{q('pStyle')}")
        name = names.get(style.get(q("val")), style.get(q("val"))) if style is not None else ""
        if name.lower().startswith("heading"):
            level = name.rpartition(" ")[2]
            content.append(make("heading", data=text(e).strip(), level=int(level) if level.isdigit() else 1))
            continue
        if name.startswith("List"):
            continue
        runs = []
        for r in e.findall(q("r")):
            p = r.find(q("rPr"))
            get = lambda n: None if p is None else p.find(q(n))  # noqa: B023, E731
            on = lambda n: (x := get(n)) is not None and x.get(q("val")) not in ("0", "false", "none")  # noqa: B023, E731
            color, size, font = get("color"), get("sz"), get("rFonts")
            runs.append(make("run", data=text(r), bold=on("b") or None, italic=on("i") or None, underline=on("u") or None, color=None if color is None or color.get(q("val")) == "auto" else "#" + color.get(q("val")).lower(), size=None if size is None else int(size.get(q("val"))) // 2, font=None if font is None else font.get(q("ascii"))))
        plain = len(runs) <= 1 and not any(r[k] for r in runs for k in ("bold", "italic", "underline", "color", "font", "size"))
        if plain:
            content.append(make("paragraph", data=text(e).strip()))
        else:
            content += [r for r in runs if r["data"].strip()]
    return {"metadata": metadata, "content": content + tables}


# --- RTF ------------------------------------------------------------------------------------------

_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S)
_SKIP = frozenset("fonttbl colortbl stylesheet info title author subject pict object header footer footnote listtable themedata datastore".split())
_SIGN = {"par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "cell": "|", "row": "\n"}


def rtf_text(data: str) -> str:
    out, stack, skip, uc, jump = [], [], False, 1, 0
    for m in _RTF.finditer(data):
        word, arg, byte, sign, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, uc))
            jump = 0
        elif brace:
            skip, uc = stack.pop() if stack else (False, 1)
            jump = 0
        elif sign is not None:
            if sign == "*":
                skip = True
            elif jump:
                jump -= 1
            elif not skip:
                out.append({"~": "\xa0", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign))
        elif word:
            if word in _SKIP:
                skip = True
            elif skip:
                continue
            elif word == "uc":
                uc = int(arg or 1)
            elif word == "u":
                out.append(chr(int(arg or 63) % 65536))
                jump = uc
            elif word in _SIGN:
                out.append(_SIGN[word])
        elif byte or char:
            if jump:
                jump -= 1
            elif not skip:
                out.append(bytes((int(byte, 16),)).decode("cp1252", "replace") if byte else char)
    return "".join(out)


def read_rtf(data: bytes) -> dict:
    parts = rtf_text(data.decode("utf-8", "ignore")).split("\n\n")
    return {"metadata": {}, "content": [make("paragraph", data=p.strip()) for p in parts if p.strip()]}


# --- PDF ------------------------------------------------------------------------------------------

_SIZES = {"A4": (595, 842), "letter": (612, 792), "legal": (612, 1008)}


def _lines(text: str, size: float, width: float) -> list[str]:
    room, out = max(1, int(width / (0.5 * size))), []
    for line in text.split("\n"):
        now = ""
        for w in line.split(" "):
            if now and len(now) + 1 + len(w) > room:
                out.append(now)
                now = w
            else:
                now = f"{now} {w}" if now else w
        out.append(now)
    return out


def _pdf_picture(data: bytes, kind: str, wide: int, high: int) -> bytes | None:
    """An image object: a JPEG as it is, a PNG's data where PDF has the same coding (8 bits, no alpha, no interlace)."""
    head = b"/Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent 8" % (wide, high)
    if kind == "jpeg":
        marker = next((k for k in range(2, len(data) - 9) if data[k] == 0xFF and 0xC0 <= data[k + 1] <= 0xCF and data[k + 1] not in (0xC4, 0xC8, 0xCC)), None)
        colors = {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}.get(data[marker + 9] if marker else 3, b"/DeviceRGB")
        return b"<<%s/ColorSpace%s/Filter/DCTDecode/Length %d>>stream\n%s\nendstream" % (head, colors, len(data), data)
    if data[24] != 8 or data[25] not in (0, 2) or data[28]:
        return None
    parts, at = [], 8
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    n, body = (3 if data[25] else 1), b"".join(parts)
    return b"<<%s/ColorSpace%s/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors %d/BitsPerComponent 8/Columns %d>>/Length %d>>stream\n%s\nendstream" % (head, b"/DeviceRGB" if n == 3 else b"/DeviceGray", n, wide, len(body), body)


def write_pdf(metadata: dict, blocks: list[dict], title: str = "Unknown", seconds: int = 0, page_size: str = "A4", images: dict | None = None) -> bytes:
    """A PDF 1.4 text document in Helvetica (Latin-1; other signs become ``?``); pictures four inches wide."""
    w, h = _SIZES.get(page_size, _SIZES["A4"])
    margin = 72
    flow: list[tuple] = []  # line, font size, space after; or a picture's name, its height, space after
    shown = {n: (o, high * 288 / wide) for n, (data, kind, wide, high) in _pictures(blocks, images).items() if (o := _pdf_picture(data, kind, wide, high))}

    def add(text: str, size: float, after: float) -> None:
        rows = _lines(text, size, w - 2 * margin)
        flow.extend((x, size, after if k == len(rows) - 1 else 0) for k, x in enumerate(rows))

    if metadata.get("title"):
        add(metadata["title"], 24, 14)
    if metadata.get("author"):
        add(f"By {metadata['author']}", 12, 14)
    for b in blocks:
        data = b["data"] or ""
        if b["type"] == "heading":
            add(data, max(8, 20 - 2 * min(b["level"], 6)), 8)
        elif b["type"] in ("paragraph", "text", "run"):
            add(data, 11, 14.4)
        elif b["type"] == "table":
            for r in ([b["headers"]] if b["headers"] else []) + (b["rows"] or []):
                add("   ".join(map(str, r)), 10, 2)
        elif b["type"] == "list":
            for k, x in enumerate(b["items"] or [], 1):
                add(f"{k}. {x}" if b["ordered"] else f"\u2022 {x}", 11, 2)
        elif b["type"] == "link":
            add(f"{data} ({b['url']})", 11, 8)
        elif b["type"] == "image" and b["name"] in shown:
            flow.append((list(shown).index(b["name"]), min(shown[b["name"]][1], h - 2 * margin), 14.4))
    pages, now, y = [], [], h - margin
    for line, size, after in flow:
        if isinstance(line, int):
            if y - size < margin and now:
                pages.append(now)
                now, y = [], h - margin
            y -= size
            now.append(b"ET q 288 0 0 %.1f %d %.1f cm /P%d Do Q BT" % (size, margin, y, line))
            y -= after
            continue
        if y - size * 1.2 < margin:
            pages.append(now)
            now, y = [], h - margin
        y -= size * 1.2
        text = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        now.append(b"/F1 %g Tf 1 0 0 1 %d %.1f Tm (%s) Tj" % (size, margin, y, text))
        y -= after
    pages.append(now)
    info = b"".join(b"/%s (%s)" % (k, metadata[n].encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for k, n in ((b"Title", "title"), (b"Author", "author"), (b"Subject", "subject")) if metadata.get(n))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + len(shown) + 2 * k) for k in range(len(pages)))), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", b"<<%s>>" % info, *(o for o, _ in shown.values())]
    named = b"/XObject<<%s>>" % b"".join(b"/P%d %d 0 R" % (k, 5 + k) for k in range(len(shown))) if shown else b""
    for k, ops in enumerate(pages):
        body = zlib.compress(b"BT\n" + b"\n".join(ops) + b"\nET")
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Resources<</Font<</F1 3 0 R>>%s>>/Contents %d 0 R>>" % (w, h, named, 6 + len(shown) + 2 * k))
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<</Size %d/Root 1 0 R/Info 4 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)
    return bytes(out)


_OBJ = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?:(stream\r?\n)|endobj)", re.S)
#: Of numbers only negative ones count: they may be gaps.
_STR = re.compile(rb"\(((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<([0-9A-Fa-f\s]+)>|/([^\s/<>\[\]()]+)\s+[-\d.]+\s+Tf|(-\d+(?:\.\d+)?)(?=[\s(<\]])|(T\*|Tj|TJ|Td|TD|Tm|'|\")", re.S)
_PLAIN, _CODED, _FONT, _NUMBER = 1, 2, 3, 4  # groups of _STR; the fifth is an operator
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_STREAMED, _CATALOG = re.compile(rb"/Type\s*/ObjStm"), re.compile(rb"/Type\s*/Catalog")
_REF, _NAMED_REF = re.compile(rb"(\d+)\s+\d+\s+R"), re.compile(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R")
_TO_UNICODE, _INFO = re.compile(rb"/ToUnicode\s+(\d+)\s+\d+\s+R"), re.compile(rb"/Info\s+(\d+)")
_DICT = re.compile(rb"\s*(?:<<)?(.*?)(?:>>|\Z)", re.S)
_REFS = {k: re.compile(rb"/" + k + rb"\s*\[?((?:\s*\d+\s+\d+\s+R)+)") for k in (b"Kids", b"Pages", b"Contents")}
_PARTS = {k: re.compile(rb"/" + k + rb"\s*(?:(\d+)\s+\d+\s+R)?") for k in (b"Resources", b"Font")}
_ABOUT = {n: re.compile(rb"/" + k + rb"\s*\(((?:\\.|[^\\()])*)\)", re.S) for k, n in ((b"Title", "title"), (b"Author", "author"), (b"Subject", "subject"))}
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_ESC = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_bytes(raw: bytes) -> bytes:
    if b"\\" not in raw:
        return raw

    def sub(m: re.Match) -> bytes:
        x = m[1]
        return bytes((int(x, 8) & 255,)) if x[:1].isdigit() else _ESC.get(x, b"" if x in (b"\n", b"\r") else x)

    return _ESCAPED.sub(sub, raw)


def _pdf_hex(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw).decode()
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def _pdf_string(raw: bytes) -> str:
    data = _pdf_bytes(raw)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _pdf_codes(cmap: bytes) -> dict[bytes, str]:
    """Codes of a font and the characters that its ToUnicode map gives them."""
    out: dict[bytes, str] = {}
    text = lambda x: x.decode("utf-16-be", "replace")
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        found = [_pdf_hex(x) for x in _HEX.findall(body)]
        out |= {code: text(to) for code, to in zip(found[::2], found[1::2])}
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, listed, first in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:\[(.*?)\]|<([0-9A-Fa-f]+)>)", body, re.S):
            low, size = int(a, 16), len(a) // 2
            many = [text(_pdf_hex(x)) for x in _HEX.findall(listed)]
            for k in range(min(int(b, 16) - low + 1, 1 << 16)):
                if first:
                    to = _pdf_hex(first)
                    out[(low + k).to_bytes(size, "big")] = text((int.from_bytes(to, "big") + k).to_bytes(len(to), "big"))
                elif k < len(many):
                    out[(low + k).to_bytes(size, "big")] = many[k]
    return out


def _pdf_text(ops: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    held, codes = "", {}
    for m in _STR.finditer(ops):
        kind = m.lastindex
        found = m[kind]
        if kind == _FONT:
            codes = fonts.get(found, {})
        elif kind == _NUMBER:
            held += " " if held and float(found) < -200 else ""  # a gap within a line
        elif kind == _PLAIN or kind == _CODED:
            if codes:
                raw = _pdf_bytes(found) if kind == _PLAIN else _pdf_hex(found)
                size = max(map(len, codes))
                held += "".join(codes.get(raw[k : k + size], "") for k in range(0, len(raw), size))
            else:
                held += _pdf_string(found) if kind == _PLAIN else _pdf_hex(found).decode("cp1252", "replace")
        elif found in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if found in (b"'", b'"') and out else "") + held)
            held = ""
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).rstrip("\n")


def _pdf_objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Head and stream of every object; a stream is as long as its head says, or else up to its end mark."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    at = 0
    while m := _OBJ.search(data, at):
        at, body = m.end(), None
        if m[3]:
            size = _LENGTH.search(m[2])
            end = data.find(b"endstream", at + (int(size[1]) if size else 0))
            body = data[at : at + int(size[1])] if size else data[at : end if end >= 0 else len(data)]
            at = end if end >= 0 else len(data)
        out[int(m[1])] = (m[2], body)
    for head, body in list(out.values()):  # objects that lie in streams
        if body and _STREAMED.search(head):
            first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"First", b"N"))
            raw = _inflated(body) if b"FlateDecode" in head else body
            place = [int(x) for x in raw[:first].split()[: 2 * n]]
            ends = [*place[3::2], len(raw) - first]
            for number, a, b in zip(place[::2], place[1::2], ends):
                out.setdefault(number, (raw[first + a : first + b], None))
    return out


def _inflated(body: bytes) -> bytes:
    return zlib.decompressobj().decompress(body)


def read_pdf(data: bytes, by_line: bool = False) -> dict:
    """A paragraph a page (or a line) of Flate-coded text in simple fonts or fonts with a ToUnicode map; metadata of the info object."""
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF files can't be read")
    objects = _pdf_objects(data)
    if not objects:
        raise ValueError("not a PDF file this reader understands")
    ref = lambda body, key: _REFS[key].search(body)
    ids = lambda m: [int(x) for x in _REF.findall(m[1])] if m else []

    def body_of(k: int) -> bytes:
        head, body = objects.get(k, (b"", None))
        return (_inflated(body) if b"FlateDecode" in head else body) if body else b""

    def part(head: bytes, key: bytes) -> bytes:
        """What follows a key: the object that it refers to, or the rest of this one."""
        m = _PARTS[key].search(head)
        return b"" if not m else objects.get(int(m[1]), (b"", None))[0] if m[1] else head[m.end() :]

    def pages(k: int, above: bytes = b"") -> list[tuple[int, bytes]]:
        """Pages with the resources that hold for them."""
        head = objects.get(k, (b"", None))[0]
        above = part(head, b"Resources") or above
        return [p for c in ids(ref(head, b"Kids")) for p in pages(c, above)] if b"/Kids" in head else [(k, above)]

    kept: dict[int, dict[bytes, str]] = {}

    def codes(font: int) -> dict[bytes, str]:
        if font not in kept:
            m = _TO_UNICODE.search(objects.get(font, (b"", None))[0])
            kept[font] = _pdf_codes(body_of(int(m[1]))) if m else {}
        return kept[font]

    root = next((ids(ref(b, b"Pages"))[0] for b, _ in objects.values() if _CATALOG.search(b)), None)
    texts = []
    for p, resources in pages(root) if root is not None else []:
        listed = _DICT.match(part(resources, b"Font"))[1]
        fonts = {name: codes(int(k)) for name, k in _NAMED_REF.findall(listed)}
        parts = [body_of(c) for c in ids(ref(objects.get(p, (b"", None))[0], b"Contents"))]
        texts.append(_pdf_text(b"\n".join(parts), fonts))
    m = _INFO.search(data)
    info = objects.get(int(m[1]), (b"", None))[0] if m else b""
    found = {n: about.search(info) for n, about in _ABOUT.items()}
    metadata = {n: _pdf_string(x[1]) if x else "" for n, x in found.items()}
    if by_line:
        metadata = {n: v.strip() for n, v in metadata.items() if v.strip()}
        texts = [x.strip() for t in texts for x in t.split("\n")]
    return {"metadata": metadata, "content": [make("paragraph", data=t) for t in texts if t.strip()]}
