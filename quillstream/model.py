"""The document model: one row a document, its content an ordered array of blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One struct for every kind of block; members that a kind doesn't use are null.
BLOCK = (
    "struct<type:string,data:string,level:int,style:string,bold:boolean,italic:boolean,underline:boolean,"
    "color:string,font:string,size:int,headers:array<string>,rows:array<array<string>>,items:array<string>,"
    "ordered:boolean,url:string,name:string>"
)
FIELDS = {x.split(":", 1)[0]: x.split(":", 1)[1] for x in BLOCK[7:-1].split(",")}
_NO_MEMBERS = dict.fromkeys(FIELDS)
CONTENT = f"array<{BLOCK}>"
DOCUMENT = f"metadata map<string,string>, content {CONTENT}"
RESULT = "struct<success:boolean,source_path:string,target_path:string,error:string,conversion_path:array<string>,hops:int>"


def block(kind: Column | str, **members: Column) -> Column:
    """A block struct of one kind; ``data`` is also a run's or link's text."""
    given = {"type": F.lit(kind) if isinstance(kind, str) else kind, **members}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def paragraph(data: Column) -> Column:
    return block("paragraph", data=data)


def heading(data: Column, level: Column | int) -> Column:
    return block("heading", data=data, level=F.lit(level) if isinstance(level, int) else level)


def run(data: Column, **style: Column) -> Column:
    return block("run", data=data, **style)


def table(rows: Column, headers: Column | None = None) -> Column:
    return block("table", rows=rows, **({} if headers is None else {"headers": headers}))


def listing(items: Column, ordered: Column | bool = False) -> Column:
    return block("list", items=items, ordered=F.lit(ordered) if isinstance(ordered, bool) else ordered)


def link(data: Column, url: Column) -> Column:
    return block("link", data=data, url=url)


def image(name: Column) -> Column:
    return block("image", name=name)


def make(kind: str, **members) -> dict:
    """A block as a plain dict, for readers of binary formats."""
    return {**_NO_MEMBERS, "type": kind, **members}


def no_blocks() -> Column:
    return F.array().cast(CONTENT)
