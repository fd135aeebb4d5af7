"""PalmDB books: the LZ77 codec, number codes, and reading and writing of MOBI files."""

from __future__ import annotations

import hashlib
import struct
from html import escape

from quillstream.model import make
from quillstream.sources.markup import basic_blocks, parse, title_of

RECORD = 4096
NONE = 0xFFFFFFFF
FLIS = b"FLIS" + struct.pack(">IHHIIHHIII", 8, 0x41, 0, 0, NONE, 1, 3, 3, 1, NONE)
EOF = bytes.fromhex("e98e0d0a")


def compress(data: bytes) -> bytes:
    """Literals, counted odd bytes, and back references (3 to 10 bytes, at most 256 back)."""
    out, i, n = bytearray(), 0, len(data)
    plain = [9 <= b <= 0x7F for b in range(256)]
    while i < n:
        size = gap = 0
        if i >= 3:
            low, want, most = max(0, i - 256), 3, min(10, n - i)
            while want <= most and (at := data.rfind(data[i : i + want], low, i)) >= 0:  # the longest match, the nearest of these
                size, gap = want, i - at
                want += 1
        if size:
            out += struct.pack(">H", 0x8000 | gap << 3 | size - 3)
            i += size
        elif plain[data[i]]:
            out.append(data[i])
            i += 1
        else:
            end = i + 1
            while end < n and end - i < 8 and not plain[data[end]]:
                end += 1
            out.append(end - i)
            out += data[i:end]
            i = end
    return bytes(out)


def decompress(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            code = (c << 8 | data[i]) & 0x3FFF
            i += 1
            gap = code >> 3
            for _ in range((code & 7) + 3):
                if 0 < gap <= len(out):
                    out.append(out[-gap])
    return bytes(out)


def vwi(n: int) -> bytes:
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def base32(n: int) -> str:
    out = ""
    while n or not out:
        n, r = divmod(n, 32)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[r] + out
    return out.rjust(4, "0")


def align4(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def split_utf8(data: bytes, size: int = RECORD) -> list[bytes]:
    """Slices of at most ``size`` bytes that part no character."""
    out, i = [], 0
    while i < len(data):
        end = min(len(data), i + size)
        while end < len(data) and end > i and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[i:end])
        i = end
    return out or [b""]


def fcis(length: int) -> bytes:
    return b"FCIS" + struct.pack(">IIIIIIIIHHI", 20, 16, 1, 0, length, 0, 32, 8, 1, 1, 0)


def fcis_kf8(length: int) -> bytes:
    return b"FCIS" + struct.pack(">IIIIIIIIIIHHI", 20, 16, 2, 0, length, 0, 40, 0, 40, 8, 1, 1, 0)


def fdst(length: int) -> bytes:
    return b"FDST" + struct.pack(">IIII", 12, 1, 0, length)


def cover_records(images: dict | None) -> list[bytes]:
    """The cover as an image record, if it is a JPEG (there is no image library to make it one)."""
    data = bytes(((images or {}).get("cover") or {}).get("data") or b"")
    return [data] if data.startswith(b"\xff\xd8\xff") else []


def exth(title: str, author: str, metadata: dict, n_images: int = 0, kf8: bool = False) -> bytes:
    """Numbered metadata; the cover, where there is one, is the first image."""
    u32 = struct.Struct(">I").pack
    rows = [(100, author.encode()), (106, metadata.get("date", "2000-01-01").encode())]
    rows += [*((204 + k, u32(v)) for k, v in enumerate((202, 2, 9, 0))), (501, b"EBOK")] if kf8 else []
    language = metadata.get("language", "en")
    rows += [(503, title.encode()), (524, (language.split("-")[0] if kf8 else language).encode())]
    rows += [(528, b"true")] if kf8 else []
    rows += [(125, u32(n_images))]
    rows += [(k, clip(metadata[name], 500)) for k, name in ((101, "publisher"), (103, "description"), (105, "subject")) if metadata.get(name)]
    rows += [(201, u32(0))] if n_images else []
    body = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in rows)
    return b"EXTH" + struct.pack(">II", 12 + len(body) + -(12 + len(body)) % 4, len(rows)) + body + bytes(-(12 + len(body)) % 4)


def clip(text: str, n: int) -> bytes:
    return text.encode()[:n]


def database_name(title: str) -> bytes:
    """At most 31 bytes of ASCII without spaces."""
    return "".join(c if " " <= c <= "\x7f" else "_" for c in title).replace(" ", "_").encode()[:31]


def mobi_html(blocks: list[dict]) -> tuple[str, list[dict]]:
    """Markup with a page break before every level-1 heading but the first, and its contents."""
    parts, toc = ['<html><head><meta charset="utf-8"/></head><body>'], []
    for b in blocks:
        text = escape(b["data"] or "")
        if b["type"] == "heading":
            if b["level"] == 1:
                if toc:
                    parts.append("<mbp:pagebreak/>")
                toc.append({"label": b["data"], "offset": len("\n".join(parts).encode()) + 1})
            parts.append(f"<h{b['level']}>{text}</h{b['level']}>")
        elif b["type"] in ("paragraph", "text", "run") and text:
            parts.append(f"<p>{text}</p>")
    html = "\n".join([*parts, "</body></html>"])
    ends = [x["offset"] for x in toc[1:]] + [len(html.encode())]
    return html, [x | {"length": e - x["offset"]} for x, e in zip(toc, ends)]


def palm_db(records: list[bytes], name: bytes, seconds: int, seed: int, step: int = 1) -> bytes:
    head = name[:31].ljust(32, b"\0") + struct.pack(">HHIIIIII", 0, 0, seconds, seconds, 0, 0, 0, 0) + b"BOOKMOBI" + struct.pack(">IIH", seed, 0, len(records))
    at, listed = len(head) + 8 * len(records) + 2, b""
    for k, r in enumerate(records):
        listed += struct.pack(">II", at, step * k)
        at += len(r)
    return head + listed + b"\0\0" + b"".join(records)


def indx(entries: list[tuple[bytes, bytes]], tags: list[tuple[int, int, int, int]], cncx: int) -> list[bytes]:
    """Index header and data record: (label, values) by a tag table."""
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * (len(tags) + 1), 1) + b"".join(map(bytes, [*tags, (0, 0, 0, 1)]))
    last = bytes([len(entries[-1][0])]) + entries[-1][0] + struct.pack(">H", len(entries))
    head = b"INDX" + struct.pack(">IIIIIIIIIIIII", 192, 0, 0, 2, 0, 1, 65001, NONE, len(entries), 0, 0, 0, cncx)
    head = head.ljust(180, b"\0") + struct.pack(">I", 192) + bytes(8)
    body = align4(head + tagx) + align4(last)
    head_rec = body[:20] + struct.pack(">I", len(align4(head + tagx)) + len(align4(last))) + body[24:] + b"IDXT" + struct.pack(">H", len(align4(head + tagx))) + b"\0\0"
    data, offsets = b"", []
    for label, values in entries:
        offsets.append(192 + len(data))
        data += bytes([len(label)]) + label + values
    data = align4(data)
    rec = (b"INDX" + struct.pack(">IIIIII", 192, 0, 1, 0, 192 + len(data), len(entries)) + b"\xff" * 8).ljust(192, b"\0")
    return [head_rec, rec + data + align4(b"IDXT" + b"".join(struct.pack(">H", o) for o in offsets))]


def ncx_records(toc: list[dict], digits: int = 3) -> list[bytes]:
    if not toc:
        return []
    names, at, entries = b"", [], []
    for x in toc:
        raw = clip(x["label"] or "", 500)
        at.append(len(names))
        names += vwi(len(raw)) + raw
    for k, (x, o) in enumerate(zip(toc, at)):
        entries.append((b"%0*d" % (digits, k), b"\x0f" + vwi(x["offset"]) + vwi(x["length"]) + vwi(o) + vwi(0)))
    return [*indx(entries, [(1, 1, 1, 0), (2, 1, 2, 0), (3, 1, 4, 0), (4, 1, 8, 0)], 1), align4(names)]


def guide_records(start: int = 0) -> list[bytes]:
    """The guide: where the text begins."""
    return indx([(b"text", b"\x01" + vwi(start))], [(1, 1, 1, 0)], 0)


def write_mobi(metadata: dict, blocks: list[dict], seconds: int = 0, images: dict | None = None) -> bytes:
    """A MOBI version 6 book. Ids come from the text, and the time is given, so it is repeatable."""
    title, author = metadata.get("title", "Unknown"), metadata.get("author", "")
    html, toc = mobi_html(blocks)
    raw = html.encode()
    texts = [compress(raw[k : k + RECORD]) for k in range(0, max(1, len(raw)), RECORD)]
    cover = cover_records(images)
    ncx, head, name = ncx_records(toc), exth(title, author, metadata, len(cover)), title.encode()
    n, uid = len(texts), int.from_bytes(hashlib.sha256(raw).digest()[:4], "big") or 1
    ncx_at = n + 1 + len(cover) if ncx else NONE
    flis = n + 1 + len(cover) + len(ncx)
    mobi = b"MOBI" + struct.pack(">IIIII", 232, 2, 65001, uid, 6) + b"\xff" * 40
    mobi += struct.pack(">IIIIIIII", n + 1, 16 + 232 + len(head), len(name), 0x0409, 0, 0, 6, n + 1 if cover else NONE) + bytes(16) + struct.pack(">I", 0x40) + bytes(32)
    mobi += struct.pack(">IIIIII", NONE, NONE, 0, 0, 0, 0) + bytes(4) + struct.pack(">HHIIIII", 1, n, 0, flis + 1, 1, flis, 1) + bytes(8)
    mobi += struct.pack(">IIIIII", NONE, 0, NONE, NONE, 0, ncx_at)
    zero = align4(struct.pack(">HHIHHI", 2, 0, len(raw), n, RECORD, 0) + mobi + head + name)
    return palm_db([zero, *texts, *cover, *ncx, FLIS, fcis(len(raw)), EOF], title.encode("utf-8", "replace"), seconds, uid & 0xFFFFFF)


def index_of(records: list[bytes], k: int) -> list[tuple[bytes, dict[int, list[int]]]]:
    """Labels and tag values of the index whose header is record ``k``: its tag table, entry offsets and number codes."""
    head, out = records[k], []
    at = head.index(b"TAGX")
    size = struct.unpack_from(">I", head, at + 4)[0]
    tags = [tuple(head[j : j + 4]) for j in range(at + 12, at + size, 4)]
    for rec in records[k + 1 : k + 1 + struct.unpack_from(">I", head, 24)[0]]:
        end, n = struct.unpack_from(">II", rec, 20)
        for j in range(n):
            at = struct.unpack_from(">H", rec, end + 4 + 2 * j)[0]
            label, at = rec[at + 1 : at + 1 + rec[at]], at + 1 + rec[at]
            control, at = rec[at], at + 1
            values: dict[int, list[int]] = {}
            for tag, width, mask, last in tags:
                if last or not control & mask:
                    continue
                times = (control & mask) >> ((mask & -mask).bit_length() - 1) if mask & (mask - 1) else 1
                for _ in range(width * times):
                    value = 0
                    while not rec[at] & 0x80:
                        value, at = value << 7 | rec[at], at + 1
                    value, at = value << 7 | rec[at] & 0x7F, at + 1
                    values.setdefault(tag, []).append(value)
            out.append((label, values))
    return out


def string_at(record: bytes, at: int) -> bytes:
    """The length-prefixed string at an offset of a string record."""
    n = 0
    while not record[at] & 0x80:
        n, at = n << 7 | record[at], at + 1
    n, at = n << 7 | record[at] & 0x7F, at + 1
    return record[at : at + n]


def trailing_size(data: bytes, flags: int) -> int:
    """Bytes at a text record's end that aren't text."""
    size = 0
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            n = shift = 0
            for b in reversed(data[: len(data) - size][-4:]):
                n |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            size += n
    if flags & 1 and size < len(data):
        size += (data[len(data) - size - 1] & 3) + 1
    return size


def records_of(data: bytes) -> list[bytes]:
    """The records of a PalmDB file."""
    n = struct.unpack_from(">H", data, 76)[0]
    at = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)] + [len(data)]
    return [data[a:b] for a, b in zip(at, at[1:])]


def read_palm(data: bytes) -> dict:
    """MOBI and AZW3 without DRM: author and title of EXTH, text of all records, its blocks."""
    records = records_of(data)
    zero = records[0]
    kind, _, _, n_text = struct.unpack_from(">HHIH", zero)
    metadata: dict[str, str] = {}
    flags = 0
    if zero[16:20] == b"MOBI":
        size = struct.unpack_from(">I", zero, 20)[0]
        if struct.unpack_from(">I", zero, 128)[0] & 0x40:
            k, left = 16 + size + 12, struct.unpack_from(">I", zero, 16 + size + 8)[0]
            while left and k + 8 <= len(zero):
                code, length = struct.unpack_from(">II", zero, k)
                value = zero[k + 8 : k + length].decode("utf-8", "ignore")
                if code in (100, 503) and value:
                    metadata["author" if code == 100 else "title"] = value
                k, left = k + max(8, length), left - 1
        if size >= 228:
            flags = struct.unpack_from(">I", zero, 240)[0] & 0xFFFF
    texts = []
    for record in records[1 : min(n_text, len(records) - 2) + 1]:
        record = record[: len(record) - trailing_size(record, flags)]
        texts.append((decompress(record) if kind == 2 else record).decode("utf-8", "ignore"))
    root = parse("".join(texts))
    if "title" not in metadata:
        metadata |= title_of(root, False)
    return {"metadata": metadata, "content": basic_blocks(root, False)}


def write_azw3(metadata: dict, blocks: list[dict], title: str, seconds: int = 0, images: dict | None = None) -> bytes:
    """A KF8 book: one skeleton and chunk a level-1 section, UTF-8 aligned text records."""
    name, author = metadata.get("title", title), metadata.get("author", "Unknown")
    sections: list[list[dict]] = []
    for b in blocks:
        if b["type"] in ("paragraph", "text", "heading"):
            if not sections or (b["type"] == "heading" and b["level"] == 1):
                sections.append([])
            sections[-1].append(b if b["type"] == "heading" else make("paragraph", data=b["data"]))
    raw, skeletons, chunks, toc, at = b"", [], [], [], 0
    for k, section in enumerate(sections or [[]]):
        head = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(name)}</title></head><body aid="{base32(k)}">'.encode()
        tail = b"</body></html>"
        body = b"".join((f"<h{b['level']}>{escape(b['data'])}</h{b['level']}>" if b["type"] == "heading" else f"<p>{escape(b['data'])}</p>").encode() for b in section)
        skeletons.append((b"SKEL%010d" % k, b"\x0a" + vwi(1) * 2 + (vwi(at) + vwi(len(head) + len(tail))) * 2))
        chunks.append((b"%010d" % (at + len(head)), b"\x0f" + vwi(0) + vwi(k) + vwi(k) + vwi(0) + vwi(len(body))))
        label = next((b["data"] for b in section if b["type"] == "heading"), name)
        toc.append({"label": label, "offset": at, "length": len(head) + len(body) + len(tail)})
        raw += head + body + tail
        at += len(head) + len(body) + len(tail)
    texts = [compress(x) + b"\0" for x in split_utf8(raw)]
    n, uid = len(texts), int.from_bytes(hashlib.sha256(raw).digest()[:4], "big") or 1
    aid = b"P-//*[@aid='0000']"
    chunk = [*indx(chunks, [(2, 1, 1, 0), (3, 1, 2, 0), (4, 1, 4, 0), (6, 2, 8, 0)], 1), align4(vwi(len(aid)) + aid)]
    skel = indx(skeletons, [(1, 1, 3, 0), (6, 2, 12, 0)], 0)
    cover, ncx, guide = cover_records(images), ncx_records(toc), guide_records()
    first = n + 1
    c = first + len(cover)
    s, x = c + 3, c + 5
    g = x + len(ncx)
    f = g + len(guide)
    head, title_bytes = exth(name, author, metadata, len(cover), kf8=True), name.encode()
    mobi = bytearray(264)
    mobi[0:4] = b"MOBI"
    for offset, value in {4: 264, 8: 2, 12: 65001, 16: uid, 20: 8, 64: first, 68: 16 + 264 + len(head), 72: len(title_bytes), 76: 9, 88: 8, 92: first if cover else NONE, 112: 0x40, 148: NONE, 152: NONE, 176: f, 180: 1, 184: f + 2, 188: 1, 192: f + 1, 196: 1, 208: NONE, 216: NONE, 220: NONE, 224: 1, 228: x if ncx else NONE, 232: c, 236: s, 240: NONE, 244: g, 248: NONE, 256: NONE}.items():
        struct.pack_into(">I", mobi, offset, value & NONE)
    mobi[24:64] = b"\xff" * 40
    zero = struct.pack(">HHIHHI", 2, 0, len(raw), n, RECORD, 0) + bytes(mobi) + head + title_bytes + bytes(8192)
    records = [zero, *texts, *cover, *chunk, *skel, *ncx, *guide, fdst(len(raw)), FLIS, fcis_kf8(len(raw)), EOF]
    return palm_db(records, database_name(name), seconds, 2 * len(records) - 1, step=2)
