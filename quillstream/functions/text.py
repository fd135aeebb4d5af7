"""Scalar functions as Catalyst expressions: stripping, escaping, names, colours, number codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip takes it; one pattern for Java's and RE2's syntax.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"{p}{k}" for p in ("COM", "LPT") for k in range(1, 10)]]
PALM_EPOCH = 2_082_844_800


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def _each(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_html(s: Column, apostrophe: str = "&#39;") -> Column:
    """``apostrophe`` is ``&#x27;`` in the writers of the Kindle family."""
    return _each(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)])


def escape_rtf(s: Column) -> Column:
    return _each(s, [("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")])


def sanitize_filename(name: Column, replacement: str = "_") -> Column:
    clean = F.btrim(F.regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1f]', replacement), F.lit(". "))
    clean = F.when(F.upper(clean).isin(RESERVED), F.concat(F.lit(replacement), clean)).otherwise(clean)
    return F.when(clean == "", F.lit("unnamed")).otherwise(clean)


def hex_to_rgb(color: Column) -> Column:
    """struct<r,g,b>, null unless six hexadecimal digits follow any ``#``."""
    digits = F.regexp_replace(color, "^#+", "")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def underline(s: Column, sign: str) -> Column:
    """A rule as long as the text (before any change of case)."""
    return F.repeat(F.lit(sign), F.length(s))


def base32(n: Column) -> Column:
    """Digits 0-9A-V, at least four."""
    digits = F.conv(n.cast("string"), 10, 32)
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))


def vwi(n: Column) -> Column:
    """Forward variable-width integer: seven bits a byte, the last byte marked (n < 2**28)."""
    byte = lambda k, mark: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(0x7F) + (0x80 if mark else 0)), 2, "0")
    at = lambda size: F.concat(*[byte(k, k == 0) for k in range(size - 1, -1, -1)])
    return F.unhex(F.when(n < 1 << 7, at(1)).when(n < 1 << 14, at(2)).when(n < 1 << 21, at(3)).otherwise(at(4)))


def align4(data: Column) -> Column:
    """Bytes padded with zeros to a multiple of four."""
    size = F.octet_length(data)
    return F.rpad(data, (F.ceil(size / 4) * 4).cast("int"), F.lit(b"\x00"))


def filename(pattern: Column, name: Column, ext: Column) -> Column:
    return F.replace(F.replace(pattern, F.lit("{name}"), name), F.lit("{ext}"), ext)


def palm_name(name: Column) -> Column:
    """At most 31 bytes; signs outside ASCII and spaces become ``_``."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7f]", "_"), " ", "_"), 1, 31)


def media_format(media_type: Column) -> Column:
    kind = F.replace(F.element_at(F.split(media_type, "/"), -1), F.lit("jpeg"), F.lit("jpg"))
    return F.when(media_type.contains("/"), kind).otherwise(F.lit("jpg"))


def author_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.when(first != "", first), F.when(last != "", last))


def language_prefix(lang: Column) -> Column:
    return F.element_at(F.split(lang, "-"), 1)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def palm_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts) + F.lit(PALM_EPOCH)


def suffix_format(path: Column) -> Column:
    """Lower-case format of a path's last suffix; empty without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def clip_bytes(s: Column, n: int) -> Column:
    """The first ``n`` bytes of a text."""
    return F.substring(F.encode(s, "UTF-8"), 1, n)
