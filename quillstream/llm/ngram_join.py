"""N-gram Jaccard join: a MinHash LSH forest, prefixes shortened by the data, exact verification.

1. One narrow pass hashes every text's words and forms its set of word n-grams. Texts with the
   same set are one class; only one representative of a class goes on.
2. Each of ``trees`` trees labels a class with a sequence of minimum hashes, whose prefixes are the
   nodes of a trie. The shortest prefix that is ever matched has the greatest depth at which a pair
   at the threshold shares it in some tree with the target recall (:func:`prefix_depth`). Classes
   that share no such prefix with another are done; for the others the rest of their labels is
   computed and the tries are written sorted, by prefix and label.
3. Prefixes are matched deepest first. Members of one node (equal tree and prefix) get its least
   class as anchor: linear in the members, no pairs are made, and two texts that share any node
   share an anchor.
4. Members of an anchor are compared exactly by their whole texts, on blocks of at most ``block``
   texts a side; large anchors are split to pairs of blocks, so no task holds an unbounded group. A
   pair counts at the first anchor that it shares, and not where it shared one at a greater depth,
   so links are counted without being listed: a block gives every member its number of links and
   one fellow member of its connected part. Anchors whose members have all met before are left out.
5. Then matched prefixes are shortened while the recall isn't there: a pair of similarity s shares a
   prefix of depth d in some tree with chance p = 1 - (1 - s^d)^trees, so each link found stands for
   (1 - p) / p that are missed (Horvitz and Thompson's estimate over the similarities found), and as
   many links at the threshold as could hide unseen (three over their chance, the 95 % bound) count
   as missed too. Shortening ends where links found / (found + missed) reaches the target, or at the
   shortest prefix, which reaches it for every pair by itself.
6. Connected components of the links give the groups.

Words are the lower-cased text's runs of characters other than ASCII white space. A text with
fewer than n words has one gram, all its words. Null, empty and wordless texts have no grams:
each is a class and a group of its own, without links. Rows with equal ids are separate rows;
a class's id is its least non-null doc_id. Ties need no rule: results are sets. An empty table
gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import chunk_sums, mix64, release, row_key, stored, told_apart, word_ranges
from quillstream.llm.components import components, unite

_LOG = logging.getLogger(__name__)
_SEEDS = np.random.default_rng(0xF0E57)
_ODD = _SEEDS.integers(1, 2**64 - 1, 4096, dtype=np.uint64) | np.uint64(1)
_XOR = _SEEDS.integers(1, 2**64 - 1, 4096, dtype=np.uint64)
DEEPER = 4  # label components of 16 bits beyond the shortest prefix
BINS = 64  # of similarities from 0 to 1


def recall_bound(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair of this Jaccard similarity shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int, target: float, max_depth: int = 16) -> int:
    """The greatest depth, up to ``max_depth``, at which the recall bound meets the target."""
    for depth in range(max_depth, 0, -1):
        if recall_bound(threshold, depth, trees) >= target:
            return depth
    raise ValueError(f"{trees} trees can't reach recall {target} at {threshold}")


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    coded = [(x or "").lower().encode() for x in texts]
    raw = np.frombuffer(b"\n".join(coded), dtype=np.uint8)
    begin, end = word_ranges(raw)
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    words = mix64(chunk_sums(raw, begin, end))
    after = np.cumsum([len(x) + 1 for x in coded])
    stop = np.searchsorted(begin, after, side="left")
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(grams) else 0):
        grams += words[j : len(words) - n + 1 + j] * _ODD[4000 + j]
    grams = mix64(grams)
    out, a = [], 0
    for b in stop.tolist():
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            few = mix64((words[a:b] * _ODD[4000 : 4000 + b - a]).sum(keepdims=True) ^ np.uint64(b - a))
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def signature(grams: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Minimum hashes number ``begin`` to ``end`` of a non-empty set."""
    best = np.full(end - begin, 2**64 - 1, np.uint64)
    for a in range(0, len(grams), 1024):
        part = grams[a : a + 1024]
        np.minimum(best, ((part[:, None] ^ _XOR[begin:end]) * _ODD[begin:end]).min(axis=0), out=best)
    return best


def sketch(docs: DataFrame, *, n: int, trees: int, depth: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, high and low (hashes of the n-gram set, null without grams), n_grams, prefixes."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    base = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row_key"), text.alias("text"))
    salt = mix64(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("high", pa.int64()), ("low", pa.int64()), ("n_grams", pa.int64()), ("prefixes", pa.list_(pa.int64()))])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                high, low, sizes, prefixes = [], [], [], []
                for grams in gram_sets(batch.column(2).to_pylist(), n):
                    sizes.append(len(grams))
                    if not len(grams):
                        high.append(None)
                        low.append(None)
                        prefixes.append([])
                        continue
                    both = mix64(np.array([grams.sum(), np.bitwise_xor.reduce(mix64(grams))], np.uint64) + np.uint64(len(grams))).view(np.int64)
                    high.append(int(both[0]))
                    low.append(int(both[1]))
                    key = salt.copy()
                    for column in signature(grams, 0, trees * depth).reshape(depth, trees):
                        key = mix64(key ^ column)
                    prefixes.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t.type) for x, t in zip((high, low, sizes, prefixes), list(schema)[2:])]], schema=schema)

    return base.mapInArrow(run, "doc_id long, row_key binary, high long, low long, n_grams long, prefixes array<long>")


def labelled(pool: DataFrame, *, n: int, trees: int, depth: int) -> DataFrame:
    """``pool`` (cls, class_size, text) with ``labels``: of each tree, DEEPER 16-bit components."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, labels = whole.slice(at, 512), []
                for grams in gram_sets(batch.column(2).to_pylist(), n):
                    packed = np.zeros(trees, np.uint64)
                    for column in signature(grams, trees * depth, trees * (depth + DEEPER)).reshape(DEEPER, trees):
                        packed = packed << np.uint64(16) | mix64(column) >> np.uint64(48)
                    labels.append(packed.view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.list_(pa.int64()))], names=["cls", "class_size", "text", "labels"])

    return pool.mapInArrow(run, "cls long, class_size long, text string, labels array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by products of 0/1 matrices."""
    every = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float32)

    def part(sets: list[np.ndarray], low: int, high: int) -> np.ndarray:
        m = np.zeros((len(sets), high - low), np.float32)
        for k, s in enumerate(sets):
            own = s[np.searchsorted(s, every[low]) : np.searchsorted(s, every[high - 1], side="right")]
            m[k, np.searchsorted(every[low:high], own)] = 1
        return m

    for a in range(0, len(every), width):
        b = min(len(every), a + width)
        x = part(left, a, b)
        out += x @ (x if left is right else part(right, a, b)).T
    return out


def verify(members: DataFrame, pool: DataFrame, *, n: int, threshold: float, block: int) -> DataFrame:
    """Links among the members of each anchor, by their whole texts.

    ``members``: anchor, size (how many members it has), cls, met (lists of sorted anchors; a pair that shares one in lists of one
    place isn't counted here); ``pool``: cls, class_size, text. Gives, for members with links, cls,
    links, near (links weighted with class sizes) and root (a fellow of the same connected part),
    and rows with a null cls whose ``bins`` count links by similarity.
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    placed = members.select("anchor", "cls", "met", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("anchor", "cls", "met", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one = bool((pdf.lo == pdf.hi).all())
        sides = [pdf] if one else [pdf[pdf.own == pdf.lo], pdf[pdf.own == pdf.hi]]
        none = pd.DataFrame({c: pd.Series([], dtype=object if c == "bins" else "int64") for c in ("cls", "links", "near", "root", "bins")})
        if not len(sides[0]) or not len(sides[-1]):
            return none
        open_ = np.triu(np.ones((len(pdf), len(pdf)), bool), 1) if one else np.ones((len(sides[0]), len(sides[1])), bool)
        for k in range(len(pdf.met.iloc[0])):
            lists = [[np.sort(x[k]) for x in side.met] for side in sides]
            if any(map(len, lists[0])) and any(map(len, lists[-1])):
                open_ &= shared_counts(lists[0], lists[-1]) == 0
        if not open_.any():
            return none
        for_pair = [open_.any(axis=1), open_.any(axis=0)]
        if not one:  # who has met all of the other side isn't looked at again
            sides = [side[mine] for side, mine in zip(sides, for_pair)]
            open_ = open_[np.ix_(*for_pair)]
        sets = [gram_sets(side.text.tolist(), n) for side in sides]
        shared = shared_counts(sets[0], sets[-1])
        total = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[-1]])[None, :] - shared
        found = open_ & (shared >= threshold * total) & (shared > 0)
        i, j = np.nonzero(found)
        if not len(i):
            return none
        bins = np.bincount(np.minimum(BINS - 1, (shared[i, j] / total[i, j] * BINS).astype(int)), minlength=BINS)
        cls = np.concatenate([side.cls.to_numpy() for side in sides])
        size = np.concatenate([side.class_size.to_numpy() for side in sides])
        if not one:
            j = j + len(sides[0])
        label = np.arange(len(cls))
        unite(label, i, j)
        links = np.bincount(i, minlength=len(cls)) + np.bincount(j, minlength=len(cls))
        near = np.zeros(len(cls), np.int64)
        np.add.at(near, i, size[j])
        np.add.at(near, j, size[i])
        own = np.flatnonzero(links)
        out = pd.DataFrame({"cls": cls[own], "links": links[own], "near": near[own], "root": cls[label[own]], "bins": None})
        last = pd.DataFrame({"cls": [pd.NA], "links": [0], "near": [0], "root": [pd.NA], "bins": [bins]})
        return pd.concat([out.astype({"cls": "Int64", "root": "Int64"}), last.astype({"cls": "Int64", "root": "Int64"})])

    return placed.join(pool.select("cls", "class_size", "text"), "cls").groupBy("anchor", "lo", "hi").applyInPandas(compare, "cls long, links long, near long, root long, bins array<long>")


def estimated_recall(bins: np.ndarray, depth: int, trees: int, threshold: float) -> float:
    """Share of all links that those found at this depth and deeper are estimated to be."""
    at = np.maximum(np.arange(BINS) / BINS, threshold)
    chance = recall_bound(at, depth, trees)
    unseen = recall_bound(threshold, depth, trees)
    missed = (bins * (1 - chance) / chance).sum() + 3 * (1 - unseen) / unseen
    return float(bins.sum() / (bins.sum() + missed))


def ngram_join(docs: DataFrame, *, n: int = 3, threshold: float = 0.5, trees: int = 56, target: float = 0.999, block: int = 512, id_col: str = "doc_id", text_col: str = "text", report: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links).

    documents: doc_id, row_key, high, low; classes: cls, high, low, class_id, class_size, row_key,
    n_grams; links: cls, links, near, root (see :func:`verify`; a class may have several rows).
    (depth, links found so far, estimated recall) of every depth are appended to ``report``.
    """
    depth = prefix_depth(threshold, trees, target)
    sketched = stored(sketch(docs, n=n, trees=trees, depth=depth, id_col=id_col, text_col=text_col), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "row_key")).alias("_first")
    made = sketched.filter("high is not null").groupBy("high", "low").agg(first, F.count("*").alias("class_size"), F.first("n_grams").alias("n_grams"), F.first("prefixes").alias("prefixes"))
    made = stored(made, "made")
    classes = made.select(told_apart(made, "high", "low").alias("cls"), "high", "low", F.col("_first.doc_id").alias("class_id"), "class_size", F.col("_first.row_key").alias("row_key"), "n_grams", "prefixes")
    rows = classes.select("cls", F.posexplode("prefixes").alias("tree", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    nodes = stored(rows.join(shared, "key"), "nodes")
    wanted = classes.join(nodes.select("cls").distinct(), "cls", "left_semi").select("row_key", "cls", "class_size")
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    texts = docs.select(row_key(doc_id, text).alias("row_key"), text.alias("text")).groupBy("row_key").agg(F.first("text").alias("text"))
    pool = stored(labelled(texts.join(wanted, "row_key").select("cls", "class_size", "text"), n=n, trees=trees, depth=depth), "pool")
    forest = nodes.join(pool.select("cls", "labels"), "cls").select("key", F.element_at("labels", F.col("tree") + 1).alias("label"), "cls")
    forest = stored(forest.sortWithinPartitions("key", "label"), "forest")
    release(nodes)

    links, bins, used = None, np.zeros(BINS, np.int64), []
    met = None  # cls, met: of each depth so far, the sorted anchors
    for before, more in enumerate(range(DEEPER, -1, -2)):
        cut = F.shiftrightunsigned("label", 16 * (DEEPER - more)) if more else F.lit(0).cast("long")
        trie = forest.select("key", cut.alias("prefix"), "cls")
        anchors = trie.groupBy("key", "prefix").agg(F.min("cls").alias("anchor"), F.count("*").alias("_n")).filter("_n > 1").select("key", "prefix", "anchor")
        members = trie.join(anchors, ["key", "prefix"]).select("anchor", "cls").distinct()
        own = stored(members.groupBy("cls").agg(F.array_sort(F.collect_list("anchor")).alias("mine")), "anchors")  # at most one a tree
        used.append(own)
        if met is None:
            known = own.withColumn("met", F.array().cast("array<array<long>>"))
        else:
            known = own.join(met, "cls", "left").withColumn("met", F.coalesce("met", F.array_repeat(F.array().cast("array<long>"), before)))
        asked = known.select(F.explode("mine").alias("anchor"), "cls", "mine", "met")
        size = asked.groupBy("anchor").agg(F.count("*").alias("size"))
        if met is not None:  # anchors with a common earlier anchor of all members have nothing new
            tags = asked.select("anchor", F.posexplode("met").alias("_k", "_tags")).select("anchor", "_k", F.explode("_tags").alias("_tag"))
            most = tags.groupBy("anchor", "_k", "_tag").agg(F.count("*").alias("_n")).groupBy("anchor").agg(F.max("_n").alias("_most"))
            size = size.join(most, "anchor", "left").filter("coalesce(_most, 0) < size").select("anchor", "size")
        lower = F.filter("mine", lambda x: x < F.col("anchor"))
        asked = asked.join(size, "anchor").select("anchor", "size", "cls", F.concat("met", F.array(lower)).alias("met"))
        got = stored(verify(asked, pool, n=n, threshold=threshold, block=block), "links")
        for r in got.filter("cls is null").select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
            bins[r["k"]] += r["n"]
        pairs = got.filter("cls is not null").select("cls", "links", "near", "root")
        links = pairs if links is None else links.unionByName(pairs)
        recall = estimated_recall(bins, depth + more, trees, threshold)
        _LOG.info("prefixes of depth %d: %d links, estimated recall %.5f", depth + more, bins.sum(), recall)
        if report is not None:
            report.append((depth + more, int(bins.sum()), recall))
        if recall >= target:
            break
        if more:
            met = stored(known.select("cls", F.concat("met", F.array("mine")).alias("met")), "met")  # who met deeper meets here too
            used.append(met)
    release(pool, forest, *used)
    return sketched.select("doc_id", "row_key", "high", "low"), classes.drop("prefixes"), links


def ngram_groups(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, n_links, component_id, kept, row_key.

    n_links counts the other documents it is linked with directly, copies included.
    component_id is the least doc_id reachable by links; the document of that id is kept (rows that
    are equal in id and text are kept or not together).
    """
    documents, classes, links = ngram_join(docs, **options)
    near = links.groupBy("cls").agg(F.sum("near").alias("_near"))
    group = components(links, "cls", "root").withColumnRenamed("node", "cls")
    known = classes.join(near, "cls", "left").join(group, "cls", "left").withColumn("_c", F.coalesce("component", "cls"))
    least = known.groupBy("_c").agg(F.min("class_id").alias("component_id"), F.min(F.struct(F.col("class_id").isNull(), "class_id", "row_key")).alias("_first"))
    per = known.join(least, "_c").select("high", "low", "class_id", "class_size", (F.col("class_size") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"), "component_id", F.col("_first.row_key").alias("_stays"))
    out = documents.join(per, ["high", "low"], "left")
    alone = F.col("high").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row_key") == F.col("_stays"))).alias("kept"),
        "row_key",
    )
