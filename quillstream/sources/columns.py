"""Formats that need a parser, as table operations: one Arrow pass from bytes to blocks or back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillstream import model
from quillstream.sources import containers, palm


def slices(data, rows: int = 500, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of the rows of an Arrow array, in runs of at most ``rows`` and of about ``size`` bytes.

    What is made of a run as Python objects is gone before the next one begins.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = pa.types.is_binary(data.type) or pa.types.is_string(data.type)
    each = pc.fill_null(pc.binary_length(data), 0).to_pylist() if flat else [data.nbytes // max(1, len(data))] * len(data)
    at = held = 0
    for k, n in enumerate(each):
        if k > at and (k - at == rows or held + n > size):
            yield at, k - at
            at, held = k, 0
        held += n
    if at < len(each):
        yield at, len(each) - at


def blocks_of(content) -> list[list[dict] | None]:
    """The rows of an Arrow array of blocks as to_pylist gives them, but a member at a time: most members are null in all blocks."""
    import pyarrow.compute as pc

    flat = content.flatten()
    if flat.null_count:
        return content.to_pylist()
    members = [[None] * len(x) if x.null_count == len(x) else x.to_pylist() for x in flat.flatten()]
    names, out, at = [x.name for x in flat.type], [], 0
    made = [dict(zip(names, x)) for x in zip(*members)]
    for n in pc.list_value_length(content).to_pylist():
        out.append(None if n is None else made[at : at + n])
        at += n or 0
    return out


def read_documents(files: DataFrame, fmt: str, *, data_col: str = "data", keep: tuple[str, ...] = ("path",), target: str = "txt") -> DataFrame:
    """``keep`` columns, metadata, content and error; a file that is null or can't be read has its error."""
    kinds = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", metadata map<string,string>, content {model.CONTENT}, error string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from quillstream.plans.convert import read

        for whole in batches:
            for batch in (whole.slice(at, n) for at, n in slices(whole.column(len(keep)))):
                docs = []
                for data in batch.column(len(keep)).to_pylist():
                    try:
                        if data is None:
                            raise ValueError("no data")
                        doc = read(fmt, data, target)
                        docs.append((list(doc["metadata"].items()), doc["content"], None))
                    except Exception as e:  # noqa: BLE001 - a file's error is its result
                        docs.append(([], [], str(e) or type(e).__name__))
                made = [pa.array(x, t) for x, t in zip(zip(*docs), kinds_out)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "metadata", "content", "error"])

    kinds_out = [to_arrow_type(x.dataType) for x in StructType.fromDDL(schema).fields[len(keep) :]]
    return files.select(*keep, data_col).mapInArrow(run, schema)


def write_documents(docs: DataFrame, fmt: str, *, keep: tuple[str, ...] = ("path",), title: str = "Unknown") -> DataFrame:
    """``keep`` columns and output: bytes of each document (metadata, content) in a format.

    A column ``images`` (map of a name to a struct with ``data``), where there is one, has the
    pictures of image blocks (DOCX, PDF) and the cover (MOBI, AZW3).
    """
    kinds = dict(docs.dtypes)
    pictured = "images" in docs.columns and fmt in ("docx", "pdf", "mobi", "azw3")
    write = {"epub": containers.write_epub, "fb2": containers.write_fb2, "docx": containers.write_docx, "pdf": containers.write_pdf, "azw3": palm.write_azw3, "mobi": lambda m, b, _, **more: palm.write_mobi(m, b, **more)}[fmt]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in (whole.slice(at, n) for at, n in slices(whole.column(len(keep) + 1))):
                metadata, content = batch.column(len(keep)).to_pylist(), blocks_of(batch.column(len(keep) + 1))
                images = batch.column(len(keep) + 2).to_pylist() if pictured else [None] * len(content)
                out = [write(dict(m or ()), list(blocks or ()), title, **({"images": dict(i or ())} if pictured else {})) for m, blocks, i in zip(metadata, content, images)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "output"])

    return docs.select(*keep, "metadata", "content", *["images"] * pictured).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", output binary")


def _each(f: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A function of bytes as one of columns; nulls stay null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at, n in slices(whole):
                yield pa.array([None if x is None else f(x) for x in whole.slice(at, n).to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary", ArrowUDFType.SCALAR_ITER)


def palm_compress(data: Column) -> Column:
    return _each(palm.compress)(data)


def palm_decompress(data: Column) -> Column:
    return _each(palm.decompress)(data)
