"""The format graph: converters, edges, and shortest conversion paths as a relation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Converter:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    #: (data, source format, target format, stem, config) -> bytes; None for those built in.
    function: Callable[[bytes, str, str, str, dict], bytes] | None = None

    def can_convert(self, src: str, dst: str) -> bool:
        return _plain(src) in self.inputs and _plain(dst) in self.outputs


def _plain(fmt: str) -> str:
    return fmt.lower().lstrip(".")


def _c(name: str, inputs: str, outputs: str) -> Converter:
    return Converter(name, tuple(inputs.split()), tuple(outputs.split()))


#: In order of priority: of several converters for a pair, the first one is taken.
CONVERTERS: list[Converter] = [
    _c("txt", "txt", "txt html md"), _c("pdf", "pdf", "txt html md"), _c("markdown", "md markdown", "html txt"), _c("html", "html htm", "txt md"),
    _c("docx", "docx doc", "txt html md"), _c("rtf", "rtf", "txt html md"), _c("epub", "epub", "txt html md"), _c("to_epub", "txt html md", "epub"),
    _c("pdf_to_epub", "pdf", "epub"), _c("to_mobi", "txt html md epub", "mobi"), _c("azw3", "azw3 azw mobi", "txt html md"), _c("to_azw3", "txt html md epub", "azw3 mobi"),
    _c("fb2", "fb2", "txt html md"), _c("to_fb2", "txt html md", "fb2"), _c("odt", "odt", "txt html md"), _c("to_pdf", "txt html md docx odt epub fb2 rtf", "pdf"),
    _c("to_docx", "txt html md pdf odt epub fb2 rtf", "docx"), _c("to_rtf", "txt html md pdf docx odt epub fb2", "rtf"),
]
MAX_HOPS = 4


_WAYS: dict[tuple[str, str], list[str] | None] = {}


def register(name: str, inputs: list[str], outputs: list[str], function: Callable | None = None, requires: tuple[str, ...] = ()) -> bool:
    """Add a converter behind those that are there; its function runs wherever a table's rows are.

    One that ``requires`` modules which aren't installed is left out (and False is returned).
    """
    if any(find_spec(m) is None for m in requires):
        return False
    restore([*CONVERTERS, Converter(name, tuple(map(_plain, inputs)), tuple(map(_plain, outputs)), function)])
    return True


def restore(converters: list[Converter]) -> None:
    """Make these the registered converters (workers get the driver's this way)."""
    if converters != CONVERTERS:
        CONVERTERS[:] = converters
        _WAYS.clear()


def converter_of(src: str, dst: str) -> Converter | None:
    """The first converter for a pair."""
    return next((c for c in CONVERTERS if c.can_convert(src, dst)), None)


def edges(spark: SparkSession) -> DataFrame:
    """src, dst, converter, priority, ordinal (place of dst among all declared for src)."""
    rows = [(c.name, k, list(c.inputs), list(c.outputs)) for k, c in enumerate(CONVERTERS)]
    made = spark.createDataFrame(rows, "converter string, priority int, inputs array<string>, outputs array<string>")
    flat = made.select("converter", "priority", F.explode("inputs").alias("src"), "outputs").select("src", F.posexplode("outputs").alias("_k", "dst"), "converter", "priority")
    return flat.select("src", "dst", "converter", "priority", (F.col("priority") * 100 + F.col("_k")).alias("ordinal"))


def converters(spark: SparkSession) -> DataFrame:
    """The converter taken for each pair."""
    return edges(spark).groupBy("src", "dst").agg(F.min_by("converter", "priority").alias("converter"), F.min("ordinal").alias("ordinal"))


def paths(spark: SparkSession, max_hops: int = MAX_HOPS) -> DataFrame:
    """src, dst, path, hops: the shortest path of every pair; ties to the edges declared first.

    The frontier is extended by one join a hop (the graph is a few dozen rows); (hops, ordinals)
    is the order in which a breadth-first search would meet the paths.
    """
    step = F.broadcast(converters(spark).select(F.col("src").alias("_at"), F.col("dst").alias("_to"), "ordinal"))
    ways = converters(spark).select("src", "dst", F.array("src", "dst").alias("path"), F.array("ordinal").alias("order"))
    every = ways
    for _ in range(max_hops - 1):
        ways = ways.join(step, (F.col("dst") == F.col("_at")) & ~F.array_contains("path", F.col("_to")))
        ways = ways.select("src", F.col("_to").alias("dst"), F.concat("path", F.array("_to")).alias("path"), F.concat("order", F.array("ordinal")).alias("order"))
        best = ways.groupBy("src", "dst").agg(F.min(F.struct("order", "path")).alias("b"))
        ways = best.select("src", "dst", F.col("b.path").alias("path"), F.col("b.order").alias("order"))
        every = every.unionByName(ways)
    best = every.groupBy("src", "dst").agg(F.min(F.struct(F.size("order").alias("hops"), F.col("order").alias("order"), F.col("path").alias("path"))).alias("b"))
    return best.select("src", "dst", F.col("b.path").alias("path"), F.col("b.hops").alias("hops"))


def list_formats(spark: SparkSession) -> DataFrame:
    """src and its distinct targets, upper-cased and sorted."""
    return edges(spark).groupBy(F.upper("src").alias("src")).agg(F.array_sort(F.collect_set(F.upper("dst"))).alias("targets"))


def find_path(src: str, dst: str) -> list[str] | None:
    """The path of one pair (the planner's use), searched once; [src] if the formats are equal."""
    pair = _plain(src), _plain(dst)
    if pair not in _WAYS:
        _WAYS[pair] = _search(*pair)
    return _WAYS[pair]


def _search(src: str, dst: str) -> list[str] | None:
    near: dict[str, list[str]] = {}
    for c in CONVERTERS:
        for a in c.inputs:
            near.setdefault(a, []).extend(c.outputs)
    if dst in near.get(src, ()):
        return [src, dst]
    if src == dst:
        return [src]
    seen, queue = {src}, [[src]]
    while queue:
        way = queue.pop(0)
        for x in near.get(way[-1], ()):
            if x == dst:
                return [*way, x]
            if x not in seen and len(way) <= MAX_HOPS - 1:
                seen.add(x)
                queue.append([*way, x])
    return None
