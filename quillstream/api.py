"""The Python interface: convert files, register converters, look at sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans import config as cfg
from quillstream.plans import graph
from quillstream.plans.convert import convert as convert_table
from quillstream.plans.convert import read
from quillstream.session import local_session
from quillstream.sources.sink import write_files


def convert_files(
    sources: Iterable[str | Path], formats: Iterable[str], *, output: str | None = None, overwrite: bool = False, keep_intermediate: bool = False, config: dict | None = None, spark: SparkSession | None = None,
) -> DataFrame:
    """Convert and write files, every source to every format; a row of results each.

    Each source has its own configuration: defaults, then the user's file (or ``config`` in its
    place), then the file of its nearest directory, then what is given here. The files are written
    by the tasks when the rows are read. Sources that aren't files give failed rows.
    """
    spark = spark or local_session()
    paths = [Path(s).resolve() for s in sources]
    there = [p for p in dict.fromkeys(paths) if validate_input(p)]
    over = ({"output.directory": str(Path(output).resolve())} if output else {}) | ({"output.overwrite": True} if overwrite else {})
    base = cfg.dotted(cfg.merge(cfg.DEFAULTS, cfg.user_values() if config is None else config))
    found = {p.parent: cfg.nearest(p) for p in there}
    local = {str(d): cfg.dotted(cfg.load(at)) for d, at in found.items() if at}
    settings = [base | local.get(str(p.parent), {}) | over for p in there] or [base | over]
    folders = {str(s["output.directory"] or p.parent).rstrip("/") for s, p in zip(settings, there)}
    taken = [(f"{d}/{x.name}",) for d in folders if Path(d).is_dir() for x in Path(d).iterdir()]
    existing = spark.createDataFrame(taken, "path string") if taken else None
    bad = [(False, str(p), None, "Source is not a file", None, 0) for p in paths if p not in there for _ in formats]
    kinds = "success boolean, source_path string, target_path string, error string, conversion_path array<string>, hops int"
    if not there:
        return spark.createDataFrame(bad, kinds)
    files = spark.read.format("binaryFile").load(["file://" + re.sub(r"([{}\[\]*?\\])", r"\\\1", str(p)) for p in there])  # no pattern
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").alias("data"))
    got = write_files(convert_table(files, list(formats), config=base, directories=local, overrides=over, existing=existing, keep_intermediate=keep_intermediate))
    return got.unionByName(spark.createDataFrame(bad, kinds)) if bad else got


def convert(source: str | Path, format: str, output: str | None = None, *, overwrite: bool = False, keep_intermediate: bool = False, spark: SparkSession | None = None) -> bool:
    """Convert one file; whether that worked."""
    rows = convert_files([source], [format], output=output, overwrite=overwrite, keep_intermediate=keep_intermediate, spark=spark).collect()
    return bool(rows) and all(r["success"] for r in rows)


def register_converter(name: str, inputs: list[str], outputs: list[str], function: Callable[[bytes, str, str, str, dict], bytes], requires: tuple[str, ...] = ()) -> bool:
    """Add a converter: ``function(data, source format, target format, stem, settings)`` gives bytes.

    It takes part in planning behind those that are there and runs on the executors. It is left out
    where a module that it ``requires`` is missing.
    """
    return graph.register(name, inputs, outputs, function, requires)


def validate_input(path: str | Path) -> bool:
    """Whether a source is a file."""
    return Path(path).is_file()


def extract_metadata(data: bytes, fmt: str) -> dict[str, str]:
    """The metadata that a format's reader finds."""
    return read(fmt.lower().lstrip("."), data, "txt")["metadata"]
