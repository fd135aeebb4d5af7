"""Embedding near-dedup on a robust-pruned flat graph, built in overlapping shards.

1. Equal vectors of one label are one class; one representative goes on.
2. Centroids are fitted on a bounded sample of representatives (``fit_rows``); every
   representative joins the shards of its ``overlap`` nearest centroids, within its label. Shards
   that are still large get centroids of their own, fitted on a sample of them of the same bound,
   so the number of shards grows with the vectors.
3. In each shard, nearest-neighbour candidates are thinned by robust pruning (alpha) to at most
   ``degree`` edges; the adjacency lists that a vector got in its shards are united.
4. In each shard every member is a query: greedy beam search from the medoid, the query's own
   node or known neighbours, and the nearest of the graph's components (each has an entry node),
   then the range is expanded through every node near enough until nothing new comes. A vector
   whose candidates all lie in the range may have more neighbours than candidates, and the graph
   may fall apart there: such tight vectors are compared with whole blocks exactly.
5. Found pairs are verified by cosine in double precision and marked in a bit table of the block.
   They are never listed: a block gives every member its number of links and one fellow of its
   connected part. A pair counts in the first shard that both its vectors are in.
6. The links of a sample of vectors are counted exactly; the sample grows until enough of its
   vectors have links, or it holds all vectors, and then the exact links are the result. While the
   audited recall (of links and, on average, of a vector's links) is under the target, all is done
   again with shards that overlap more and longer beams, candidate lists and edge lists. If that
   doesn't reach the target either, all vectors are compared exactly, in blocks, and a warning is
   logged.
7. Connected components of the links give the groups.

Shards of more than ``block`` vectors are split by hash into blocks with a graph each, and every
block's members are searched in all blocks of the shard, so nothing is capped or dropped.

Vectors link only when labels are equal and not null and lengths are equal. Vectors that are
null, empty, zero, or hold null or non-finite components link with nothing: they have n_links 0
and their own id as component. Components of any finite size are fine: vectors are scaled by their
largest component first. Repeated rows and equal ids count as rows of their own. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import release, stored, told_apart
from quillstream.llm.components import components, unite

_LOG = logging.getLogger(__name__)
_LINKS = "cls long, links long, near long, root long"  # near: links weighted with class sizes


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; fewer centroids come back where there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    x = unit(np.unique(x, axis=0))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def robust_prune(x: np.ndarray, candidates: int = 48, degree: int = 20, alpha: float = 1.2) -> tuple[list[np.ndarray], np.ndarray]:
    """Adjacency of unit vectors: nearest candidates, thinned so that kept edges point apart.

    Also returned: each vector's least cosine among its candidates, -2 where all are candidates.

    A candidate goes when alpha times its distance to a kept neighbour is at most its distance
    to the node. Reverse edges are added, and lists that they make longer than twice the degree
    are pruned again.
    """
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)], np.full(n, -2.0)
    k, out = min(candidates, n - 1), []
    least = np.full(n, -2.0)
    step = max(16, 1024 * 48 * 48 // max(k, 48) ** 2)  # of rows, as each takes k x k distances
    for a in range(0, n, step):
        sims = x[a : a + step] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        if k < n - 1:
            least[a : a + len(sims)] = np.take_along_axis(sims, near[:, -1:], 1)[:, 0]
        inner = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nid,njd->nij", x[near], x[near])))
        alive = np.ones(near.shape, bool)
        kept = np.zeros(near.shape, bool)
        rows = np.arange(len(near))
        for _ in range(min(degree, k)):
            first = alive.argmax(axis=1)
            live = alive[rows, first]
            if not live.any():
                break
            kept[rows[live], first[live]] = True
            alive &= ~((alpha * inner[rows, first] <= far) & live[:, None])
            alive[rows, first] = False
        out += [near[i][kept[i]] for i in range(len(near))]
    source = np.repeat(np.arange(n), [len(v) for v in out])
    target = np.concatenate(out)
    pairs = np.unique(np.concatenate([source * n + target, target * n + source]))
    lists = np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n))
    return [thin(x, i, v, degree, alpha) if len(v) > 2 * degree else v for i, v in enumerate(lists)], least


def thin(x: np.ndarray, i: int, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of one list that reverse edges have made long."""
    far = np.sqrt(np.maximum(0, 2 - 2 * (x[near] @ x[i])))
    order = np.argsort(far, kind="stable")
    near, far, kept = near[order], far[order], []
    while len(near) and len(kept) < 2 * degree:
        kept.append(near[0])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (x[near] @ x[near[0]])))
        left = alpha * apart > far
        left[0] = False
        near, far = near[left], far[left]
    return np.array(kept, dtype=np.int64)


def entries(x: np.ndarray, adjacency: list[np.ndarray]) -> np.ndarray:
    """One node of every connected component of a graph: the one nearest to the component's mean."""
    n = len(x)
    source, target = np.repeat(np.arange(n), [len(v) for v in adjacency]), np.concatenate(adjacency)
    label, last = np.arange(n), None
    while last is None or (label != last).any():
        last, label = label, label.copy()
        np.minimum.at(label, source, last[target])
        np.minimum.at(label, target, last[source])
        label = label[label]
    label = np.unique(label, return_inverse=True)[1]
    mean = np.zeros((label.max() + 1, x.shape[1]), x.dtype)
    np.add.at(mean, label, x)
    order = np.lexsort((-np.einsum("ij,ij->i", x, mean[label]), label))
    return order[np.searchsorted(label[order], np.arange(len(mean)))]


def range_search(q: np.ndarray, x: np.ndarray, adjacency: list[np.ndarray], known: np.ndarray, radius: float, beam: int, slack: float = 0.04) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of cosine >= radius - slack that greedy search and range expansion reach.

    They come in portions, as memory for the steps of a few queries is held at a time. ``known``
    has nodes of this graph where a query's search begins besides, -1 for none.
    """
    n = len(x)
    width = max(1, max(len(v) for v in adjacency))
    nbrs = np.full((n + 1, width), n, np.int64)  # node n is a stand-in far from everything
    for i, v in enumerate(adjacency):
        nbrs[i, : len(v)] = v
    far = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    medoid = int((x @ x.mean(axis=0)).argmax())
    doors = entries(x, adjacency)
    few = max(1000, 4_000_000 // width)  # nodes whose neighbours are looked at together
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        m = len(part)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        inside = np.zeros((m, n + 1), bool)
        mine = known[a : a + m]
        k = min(beam, len(doors))
        open_ = doors[np.argpartition(-(part @ x[doors].T), k - 1, axis=1)[:, :k]]
        pool = np.concatenate([np.full((m, 1), medoid), np.where(mine >= 0, mine, n), open_, np.full((m, beam), n)], axis=1)
        pool.sort(axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = n
        seen[rows, pool] = True
        score = np.where(pool < n, np.einsum("md,mbd->mb", part, far[pool]), -3.0)
        done = pool == n
        while not done.all():
            best = np.where(done, -9.0, score).argmax(axis=1)
            active = ~done[rows[:, 0], best]
            done[rows[:, 0], best] = True
            step = np.where(active[:, None], nbrs[pool[rows[:, 0], best]], n)
            step = np.where(seen[rows, step], n, step)
            seen[rows, step] = True
            value = np.where(step < n, np.einsum("md,mbd->mb", part, far[step]), -3.0)
            pool, score = np.concatenate([pool, step], 1), np.concatenate([score, value], 1)
            done = np.concatenate([done, step == n], 1)
            i, j = np.nonzero(score >= radius - slack)  # what leaves the beam is kept for the expansion
            inside[i, pool[i, j]] = True
            top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            pool, score, done = (np.take_along_axis(v, top, 1) for v in (pool, score, done))
        i, j = np.nonzero(inside)
        while len(i):
            yield i + a, j
            fresh: list[tuple[np.ndarray, np.ndarray]] = []
            for b in range(0, len(i), few):
                source, step = np.repeat(i[b : b + few], width), nbrs[j[b : b + few]].ravel()
                new = ~seen[source, step]
                key = np.unique(source[new] * (n + 1) + step[new])
                source, step = key // (n + 1), key % (n + 1)
                seen[source, step] = True
                near = [np.einsum("ij,ij->i", part[source[c : c + 100_000]], far[step[c : c + 100_000]]) >= radius - slack for c in range(0, len(key), 100_000)]
                near = np.concatenate(near) if near else np.zeros(0, bool)
                fresh.append((source[near], step[near]))
            i, j = (np.concatenate(v) for v in zip(*fresh))


def mark(found: np.ndarray, i: np.ndarray, j: np.ndarray, q: np.ndarray, x: np.ndarray, radius: float) -> None:
    """Set found[i, j] for the pairs whose cosine in double precision is at least ``radius``."""
    for b in range(0, len(i), 100_000):
        s, t = i[b : b + 100_000], j[b : b + 100_000]
        ok = np.einsum("ij,ij->i", q[s], x[t]) >= radius
        found[s[ok], t[ok]] = True


def tally(found: np.ndarray, left: np.ndarray, right: np.ndarray, cls: np.ndarray, size: np.ndarray, both: bool = True) -> pd.DataFrame:
    """Links, weighted links and a fellow, for rows that have links, from a table of found pairs.

    ``left`` and ``right`` number the table's rows and columns in ``cls`` and ``size``; with
    ``both`` a pair counts for its column as well as for its row.
    """
    links, near, label = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64), np.arange(len(cls))
    for a in range(0, len(left), 256):
        part = found[a : a + 256]
        i, j = np.nonzero(part)
        unite(label, left[i + a], right[j])
        np.add.at(links, left[a : a + 256], part.sum(axis=1))
        np.add.at(near, left[a : a + 256], np.rint(part @ size[right].astype(float)).astype(np.int64))
        if both:
            np.add.at(links, right, part.sum(axis=0))
            np.add.at(near, right, np.rint(size[left[a : a + 256]].astype(float) @ part).astype(np.int64))
    own = np.flatnonzero(links)
    return pd.DataFrame({"cls": cls[own], "links": links[own], "near": near[own], "root": cls[label[own]]})


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, high, low; classes: cls, high, low, label, class_id, class_size, v) of the vectors that can link."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("high", F.when(good, F.xxhash64("label", "v"))).withColumn("low", F.when(good, F.xxhash64(F.lit(77), "v", "label")))
    made = rows.filter("high is not null").groupBy("high", "low").agg(F.first("label").alias("label"), F.min("vec_id").alias("class_id"), F.count("*").alias("class_size"), F.first("v").alias("v"))
    made = stored(made, "vectors")
    return rows.select("vec_id", "high", "low"), made.select(told_apart(made, "high", "low").alias("cls"), "high", "low", "label", "class_id", "class_size", "v")


def nearest_shards(v: list, centroids: np.ndarray | None, overlap: int) -> list[np.ndarray]:
    """Numbers of the ``overlap`` nearest centroids of each vector; 0 for vectors of another length."""
    out = [np.zeros(1, np.int64)] * len(v)
    fits = [] if centroids is None else np.flatnonzero([len(a) == centroids.shape[1] for a in v])
    if len(fits):
        sims = unit(np.stack([v[i] for i in fits])) @ centroids.T
        k = min(overlap, sims.shape[1])
        for i, s in zip(fits, np.argpartition(-sims, k - 1, axis=1)[:, :k]):
            out[i] = s
    return out


def refined(placed: DataFrame, by: list[str], shard: int, fit_rows: int, parts: int, rounds: int = 4, made: list | None = None) -> DataFrame:
    """``placed`` with shards of more than 8 x ``shard`` vectors divided by centroids of their own.

    Stored tables are appended to ``made``. A shard that doesn't fall apart (its vectors are alike) stays large and is split to blocks later.
    """
    schema, made = placed.schema, [] if made is None else made
    for _ in range(rounds):
        sizes = stored(placed.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > 8 * shard), "large")
        made.append(sizes)
        if sizes.isEmpty():
            break
        large, rest = placed.join(sizes, by), placed.join(sizes, by, "left_anti")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(min(parts, -(-int(pdf["_n"].iloc[0]) // shard)))
            c = k_means(np.stack(pdf.v.to_list()), k)
            return pdf.iloc[:1][by].assign(centroids=[list(map(list, c))])

        kinds = ", ".join(f"{c} {t}" for c, t in placed.dtypes if c in by)
        sample = large.filter(F.pmod(F.xxhash64("cls", F.lit(9)), F.col("_n")) < fit_rows)
        centroids = stored(sample.groupBy(*by).applyInPandas(fit, kinds + ", centroids array<array<double>>"), "centroids")
        slices = F.ceil(F.col("_n") / 20_000).cast("long")
        asks = large.withColumn("slice", F.pmod(F.xxhash64("cls", F.lit(8)), slices))
        given = centroids.join(sizes, by).select(*by, "centroids", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))

        def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            c = np.stack([np.array(x) for x in right["centroids"].iloc[0]]) if len(right) else None
            near = nearest_shards(left.v.to_list(), c, 2)
            out = left.loc[np.repeat(left.index, [len(s) for s in near])].reset_index(drop=True)
            return out.assign(shard=out.shard * parts + np.concatenate(near))[schema.names]

        moved = asks.groupBy(*by, "slice").cogroup(given.groupBy(*by, "slice")).applyInPandas(assign, schema)
        placed = stored(rest.unionByName(moved), "shards")
        made += [centroids, placed]
        if placed.groupBy(*by).count().agg(F.max("count")).first()[0] > 0.8 * sizes.agg(F.max("_n")).first()[0]:
            break
    return placed


def find_links(classes: DataFrame, *, radius: float, centroids: np.ndarray | None, overlap: int, beam: int, degree: int, block: int, candidates: int = 48, shard: int = 1500, fit_rows: int = 20_000, parts: int = 4096, made: list | None = None) -> DataFrame:
    """Links of classes (cls, label, class_size, v), counted by :func:`tally`; a class may have several rows.

    Tables stored on the way, which are of no use once the links are, are appended to ``made``.
    """
    kind, made = dict(classes.dtypes)["label"], [] if made is None else made

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = nearest_shards(pdf.v.to_list(), centroids, overlap)
            out = pdf.loc[np.repeat(pdf.index, [len(s) for s in near])].reset_index(drop=True)
            yield out.assign(shard=np.concatenate(near) if near else np.zeros(0, np.int64), dim=[len(v) for v in out.v])[["cls", "label", "dim", "shard", "class_size", "v"]]

    by = ["label", "dim", "shard"]
    placed = stored(classes.select("cls", "label", "class_size", "v").mapInPandas(assign, f"cls long, label {kind}, dim int, shard long, class_size long, v array<double>"), "shards")
    made.append(placed)
    placed = refined(placed, by, shard, fit_rows, parts, made=made)
    sized = placed.join(placed.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), by)
    sized = sized.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.cls.to_numpy()
        near, least = robust_prune(unit(np.stack(pdf.v.to_list())), candidates=candidates, degree=degree)
        return pd.DataFrame({"cls": ids, "shard": pdf["shard"].to_numpy(), "near": [ids[v] for v in near], "tight": least >= radius - 1e-6})

    lists = sized.groupBy(*by, "own").applyInPandas(build, "cls long, shard long, near array<long>, tight boolean")
    united = lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("tight").alias("tight"), F.collect_list("shard").alias("shards"))  # one a shard
    nodes = stored(sized.join(united, "cls"), "nodes")
    made.append(nodes)
    cols = [*by, "cls", "class_size", "v", "near", "tight", F.filter("shards", lambda x: x < F.col("shard")).alias("before"), "own"]
    search = nodes.select(*cols, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    search = search.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf.v.to_list()))
        ids, part, tight = pdf.cls.to_numpy(), pdf.own.to_numpy(), pdf.tight.to_numpy(dtype=bool)
        lo, hi = pdf.lo.iloc[0], pdf.hi.iloc[0]
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        found = np.zeros((len(left), len(right)), bool)
        for qs, ts, table in ((left, right, found), (right, left, found.T))[: 1 if lo == hi else 2]:
            if not len(qs) or not len(ts):
                continue
            order = np.argsort(ids[ts])
            known = ids[ts][order]

            def nodes_of(v: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                return order[at[known[at] == v]]

            close, loose = np.flatnonzero(tight[qs]), np.flatnonzero(~tight[qs])
            for a in range(0, len(close), 512):
                table[close[a : a + 512]] |= x[qs[close[a : a + 512]]] @ x[ts].T >= radius
            if len(loose):
                begin = np.full((len(loose), 4), -1)
                if lo == hi:
                    begin[:, 0] = loose
                else:
                    for k, v in enumerate(pdf.near.iloc[qs[loose]]):
                        met = nodes_of(v)[:4]
                        begin[k, : len(met)] = met
                adjacency = [nodes_of(v) for v in pdf.near.iloc[ts]]
                for i, j in range_search(x[qs[loose]].astype(np.float32), x[ts].astype(np.float32), adjacency, begin, radius, beam):
                    mark(table, loose[i], j, x[qs], x[ts], radius)
        if lo == hi:
            found |= found.T
            found &= np.triu(np.ones(found.shape, bool), 1)
        most = max(1, max(map(len, pdf.before)))
        before = np.full((len(pdf), most), -1)
        for k, v in enumerate(pdf.before):
            before[k, : len(v)] = v
        for a in range(0, len(left), 256):
            i, j = np.nonzero(found[a : a + 256])
            for b in range(0, len(i), 100_000):
                s, t = before[left[i[b : b + 100_000] + a]], before[right[j[b : b + 100_000]]]
                again = ((s[:, :, None] == t[:, None, :]) & (s >= 0)[:, :, None]).any(axis=(1, 2))
                found[i[b : b + 100_000][again] + a, j[b : b + 100_000][again]] = False
        return tally(found, left, right, ids, pdf.class_size.to_numpy())

    return search.groupBy(*by, "lo", "hi").applyInPandas(look, _LINKS)


def compare(queries: DataFrame, classes: DataFrame, *, radius: float, block: int) -> DataFrame:
    """Links of the ``queries`` (some or all of ``classes``) with all classes, without a graph.

    Both sides are split by hash into blocks of about ``block`` vectors, and every pair of blocks is
    a group; with ``queries`` the same table as ``classes``, each unordered pair of blocks is one.
    """
    by, once = ["label", "dim"], queries is classes
    left, right = (t.select("cls", "label", "class_size", F.size("v").alias("dim"), "v") for t in (queries, classes))

    def counted(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))

    sizes = counted(left, "nq").join(counted(right, "nt"), by)
    own = F.xxhash64("cls", F.lit(5))
    cols = [*by, "cls", "class_size", "v"]
    left = left.join(sizes, by).select(*cols, F.pmod(own, "nq").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("t"), F.lit(True).alias("asks"))
    right = right.join(sizes, by).select(*cols, F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.pmod(own, "nt").cast("int").alias("t"), F.lit(False).alias("asks"))
    both = left.unionByName(right)

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf.asks.to_numpy(dtype=bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("cls", "links", "near", "root")})
        x = unit(np.stack(pdf.v.to_list()))
        cls, first, number = np.unique(pdf.cls.to_numpy(), return_index=True, return_inverse=True)
        found = np.zeros((asks.sum(), (~asks).sum()), bool)
        for a in range(0, len(found), 512):
            found[a : a + 512] = x[asks][a : a + 512] @ x[~asks].T >= radius
        place = np.full(len(cls), -1)
        place[number[~asks]] = np.arange((~asks).sum())
        itself = place[number[asks]]
        found[np.flatnonzero(itself >= 0), itself[itself >= 0]] = False
        return tally(found, number[asks], number[~asks], cls, pdf.class_size.to_numpy()[first], both=once and pdf.q.iloc[0] < pdf.t.iloc[0])

    return (both.filter("q <= t") if once else both).groupBy(*by, "q", "t").applyInPandas(look, _LINKS)


def truth(classes: DataFrame, n: int, *, radius: float, sample: int, block: int) -> tuple[DataFrame, bool]:
    """(links of sampled classes, whether every class is sampled).

    The sample grows until ``sample`` of its classes have links or it holds all classes.
    """
    share = 4 * sample / max(1, n)
    while True:
        whole = share >= 1
        chosen = classes if whole else classes.filter(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
        true = stored(compare(chosen, classes, radius=radius, block=block), "audit")
        if whole:
            return true, True
        linked = true.select("cls").distinct().count()
        if linked >= sample:
            return true, False
        release(true)
        share *= min(16, max(2, 1.5 * sample / max(1, linked)))


def audit(true: DataFrame, links: DataFrame) -> tuple[int, int, float]:
    """(links of the sample, those of them that were found, mean share found of a vector's links)."""
    per = true.groupBy("cls").agg(F.sum("links").alias("true")).join(links.groupBy("cls").agg(F.sum("links").alias("got")), "cls", "left")
    per = per.withColumn("got", F.least(F.coalesce("got", F.lit(0)), F.col("true")))
    row = per.agg(F.sum("true"), F.sum("got"), F.avg(F.col("got") / F.col("true"))).first()
    return row[0] or 0, row[1] or 0, 1.0 if row[2] is None else row[2]


def near_dedup(vectors: DataFrame, *, radius: float = 0.93, overlap: int = 3, beam: int = 16, degree: int = 20, shard: int = 1500, block: int = 6000, fit_rows: int = 20_000, target: float = 0.99, sample: int = 300, parts: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", report: list | None = None) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    ``parts`` is the most centroids that are fitted at once. Audits (overlap, true links, found
    links; a link of two sampled vectors counts for either) are appended to ``report`` and logged;
    where the links were taken from an exact comparison of all vectors, a last entry has overlap 0.
    """
    rows, classes = classes_of(vectors, id_col, vector_col, label_col)
    n, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    picked = classes.select("v").orderBy(F.xxhash64("cls")).limit(fit_rows).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    most = max(by_dim.values(), key=len, default=[])
    exact, whole = truth(classes, n, radius=radius, sample=sample, block=block)
    links = None
    for k in range(0 if whole else 4):
        wide = overlap + 2 * k
        count = int(np.clip(n * wide / (max(1, labels) * shard), 1, parts))
        centroids = k_means(np.array(most), count) if most else None
        if links is not None:
            release(links)
        used: list[DataFrame] = []
        links = stored(find_links(classes, radius=radius, centroids=centroids, overlap=wide, beam=beam << k, degree=degree << k, block=block, candidates=48 << k, shard=shard, fit_rows=fit_rows, parts=parts, made=used), "links")
        release(*used)
        true, hit, mean = audit(exact, links)
        _LOG.info("overlap %d: %d of %d audited links found, %.4f of a vector's on average", wide, hit, true, mean)
        if report is not None:
            report.append((wide, true, hit))
        if hit >= target * true and mean >= target:
            break
    else:
        if not whole:
            _LOG.warning("recall stayed under %s: all vectors are compared", target)
            exact = stored(compare(classes, classes, radius=radius, block=block), "links")
        links = exact
        if report is not None:
            true = exact.agg(F.sum("links")).first()[0] or 0
            report.append((0, true, true))
    near = links.groupBy("cls").agg(F.sum("near").alias("_near"))
    group = components(links, "cls", "root").withColumnRenamed("node", "cls")
    known = classes.drop("v", "label").join(near, "cls", "left").join(group, "cls", "left").withColumn("_c", F.coalesce("component", "cls"))
    least = known.groupBy("_c").agg(F.min("class_id").alias("component_id"))
    per = known.join(least, "_c").select("high", "low", (F.col("class_size") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(per, ["high", "low"], "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
