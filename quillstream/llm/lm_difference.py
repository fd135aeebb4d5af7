"""Cross-entropy difference: a target and a background bigram model over one vocabulary.

Tokens are ids of a public tokenizer (the shared vocabulary) and a begin sign. Both models are
bigrams smoothed by their own unigrams::

    P(w)     = (c(w) + delta) / (N + delta * V)
    P(w | h) = (c(h, w) + mu * P(w)) / (c(h) + mu)

The background model counts all documents, the target model those marked as target, with equal
order, smoothing and vocabulary. A document's score is the mean over its tokens of
loss_target - loss_background (nats): the lower, the more it is like the target.

A document is scored by both models without its own counts (a target document's own are taken out
of either, any other's out of the background), so being part of a model doesn't favour it; its
copies, being other documents, stay.

Counts are exact 64-bit sums and cover every document. Documents are counted in runs of about
``run_tokens`` tokens, each within one task; a run's distinct n-grams leave it once, however
frequent they are, are summed by n-gram in a window (which spills) and go back with the totals to
the runs that asked. So no table of the whole model exists anywhere, no group grows with the corpus
but that of an n-gram, which has one short row a run, and what is moved grows with the corpus.
Documents meet their totals in a cogroup by run, whose size ``run_tokens`` bounds.

Null and empty texts have no tokens: n_tokens 0, both losses and the score null. Documents with
equal ids are separate; a document is target if its id is among the target ids (nulls aren't).
Without target documents the target model is its smoothing alone. An empty table gives no rows.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import shuffle_partitions, stored
from quillstream.llm.tokens import encoder

BEGIN, CONTEXT, SINGLE = 0xFFFD, 0xFFFE, 0xFFFF  # high halves of keys that aren't ids
_ROW = "run long, doc_id long, target boolean, n long, data binary"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Sorted keys (as differences) and counts within one run of documents, compressed.

    Keys are below 2^32, and so are a run's counts: it ends with the document that fills it.
    """
    keys, *counts = arrays
    if any(len(c) and c.max() >= 1 << 32 for c in counts):
        raise OverflowError("a run's count needs more than 32 bits")
    raw = np.diff(keys.astype("<i8"), prepend=0).astype("<u4").tobytes() + b"".join(c.astype("<u4").tobytes() for c in counts)
    return zstandard.ZstdCompressor(level=1).compress(_planes(raw))


def unpack(data: bytes, parts: int) -> list[np.ndarray]:
    """Inverse of :func:`pack` for keys and ``parts`` - 1 arrays of counts."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    a = np.frombuffer(_planes(raw, True), dtype="<u4").reshape(parts, -1).astype(np.int64)
    return [np.cumsum(a[0]), *a[1:]]


def _planes(raw: bytes, back: bool = False) -> bytes:
    a = np.frombuffer(raw, dtype=np.uint8)
    return (a.reshape(4, -1) if back else a.reshape(-1, 4)).T.tobytes()


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Bigram keys of a document: context in the high half, token in the low."""
    ids = ids.astype(np.uint32)
    return np.concatenate([[np.uint32(BEGIN)], ids[:-1]]).astype(np.uint32) << np.uint32(16) | ids


def add_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[edge], np.add.reduceat(c, edge) if len(edge) else c


def with_lower(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram counts and, with them, those of single tokens and of contexts."""
    low, high = keys & np.uint32(0xFFFF), keys >> np.uint32(16)
    extra, sums = [keys.astype(np.int64)], [counts]
    for mark, part in ((CONTEXT, high), (SINGLE, low)):
        total = np.bincount(part, weights=counts, minlength=1).astype(np.int64)
        at = np.flatnonzero(total)
        extra.append(at | mark << 16)
        sums.append(total[at])
    return np.concatenate(extra), np.concatenate(sums)


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of longs."""
    h = np.full(x.shape, 42, np.uint32)
    for k in (x.astype(np.uint64) & np.uint64(0xFFFFFFFF), x.astype(np.uint64) >> np.uint64(32)):
        k = k.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = h ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).astype(np.int32)


def run_number(task: int, k: int, partitions: int) -> int:
    """A number for run ``k`` of a task that no other run has and that hashes to an even share.

    Runs are few and large beside shuffle partitions: left to chance, several would meet in one.
    """
    base = task << 41 | k << 21
    tries = np.arange(base, base + min(1 << 21, 16 * partitions))
    hits = np.flatnonzero(spark_hash(tries).astype(np.int64) % partitions == (task + 7919 * k) % partitions)
    return int(tries[hits[0]]) if len(hits) else base


def gather(docs: DataFrame, target_ids: DataFrame, tokenizer: str, run_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows of documents (their tokens) and, with null ``n``, of runs (their counts).

    The target ids are joined by sorting at every size: they grow with the corpus, so a broadcast
    that a small table would allow says nothing of a large one.
    """
    marked = target_ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(marked.hint("merge"), "doc_id", "left")

    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or shuffle_partitions(spark))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("target", pa.bool_()), ("n", pa.int64()), ("data", pa.binary())])
        task, zip_, done = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1), 0
        at = run_number(task, 0, partitions)
        held: list[tuple[list, list]] = [([], []), ([], [])]  # all documents, target documents
        waiting: list[list] = [[], []]
        tokens = 0

        def settle() -> None:
            for (ks, cs), new in zip(held, waiting):
                if new:
                    k, c = np.unique(np.concatenate(new), return_counts=True)
                    k, c = add_counts([*ks, k], [*cs, c])
                    ks[:], cs[:], new[:] = [k], [c], []

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

        def counts_of_run():
            settle()
            keys, counts = with_lower(held[0][0][0], held[0][1][0])
            order = np.argsort(keys)
            keys, counts, own = keys[order], counts[order], np.zeros(len(keys), np.int64)
            if held[1][0]:
                k, c = with_lower(held[1][0][0], held[1][1][0])
                own[np.searchsorted(keys, k)] = c
            for ks, cs in held:
                ks.clear()
                cs.clear()
            return batch_of([(at, None, None, None, pack([keys, counts, own]))])

        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows: list[tuple] = []
                for doc_id, target, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), encoder(tokenizer).encode(part.column(1).to_pylist())):
                    if tokens >= run_tokens:  # the run is full
                        if rows:
                            yield batch_of(rows)
                        yield counts_of_run()
                        rows, tokens, done = [], 0, done + 1
                        at = run_number(task, done, partitions)
                    rows.append((at, doc_id, bool(target), len(ids), zip_.compress(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())))
                    tokens += len(ids)
                    if len(ids):
                        waiting[0].append(keys_of(ids))
                        if target:
                            waiting[1].append(waiting[0][-1])
                if sum(map(len, waiting[0])) > 1_500_000:
                    settle()
                yield batch_of(rows)
        if tokens:
            yield counts_of_run()

    return stored(base.select("doc_id", "text", "target").mapInArrow(run, _ROW), "lm")


def exploded(blocks: DataFrame) -> DataFrame:
    """run, key, c, t: a row for each distinct n-gram of a run, from its packed counts."""

    def flat(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for run, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, every, target = unpack(data, 3)
                for a in range(0, len(keys), 100_000):
                    part = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), run)), pa.array(keys[part]), pa.array(every[part]), pa.array(target[part])], names=["run", "key", "c", "t"])

    return blocks.mapInArrow(flat, "run long, key long, c long, t long")


def total_counts(counts: DataFrame) -> DataFrame:
    """run, key and the key's totals in both models, for rows of :func:`exploded`."""
    by = Window.partitionBy("key")
    return counts.select("run", "key", F.sum("c").over(by).alias("c"), F.sum("t").over(by).alias("t"))


def losses(ids: np.ndarray, target: bool, model: tuple[np.ndarray, np.ndarray, np.ndarray], n: tuple[int, int], vocab: int, delta: float, mu: float) -> list[np.ndarray]:
    """-log P of each bigram of a document in the background and in the target model, both without it."""
    known, *counts = model
    keys = keys_of(ids).astype(np.int64)
    high, low = keys >> 16, keys & 0xFFFF
    which = (keys, high | CONTEXT << 16, low | SINGLE << 16)
    at = [np.searchsorted(known, k) for k in which]
    own = []
    for k in which:
        _, back, times = np.unique(k, return_inverse=True, return_counts=True)
        own.append(times[back])
    out = []
    for c, total, mine in zip(counts, n, (True, target)):
        pair, context, single = ((c[a] - o if mine else c[a]).astype(float) for a, o in zip(at, own))
        uni = (single + delta) / (total - len(ids) * mine + delta * vocab)
        out.append(-np.log((pair + mu * uni) / (context + mu)))
    return out


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, tokenizer: str, *, vocab: int = 50257, delta: float = 0.5, mu: float = 100.0, run_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, loss_target, loss_background (means), score."""
    if vocab > BEGIN:
        raise ValueError("ids must fit 16 bits beside three marks")
    rows = gather(docs, target_ids, tokenizer, run_tokens, id_col, text_col)
    tokens = rows.filter("n is not null")
    sums = tokens.agg(F.sum("n"), F.sum(F.when(F.col("target"), F.col("n")))).first()
    n = (sums[0] or 0, sums[1] or 0)
    totals = total_counts(exploded(rows.filter("n is null").select("run", "data")))

    def score(left, right):
        import pyarrow as pa

        order = np.argsort(right.column("key").to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        model = tuple(right.column(c).to_numpy()[order] if len(order) else order for c in ("key", "c", "t"))
        unzip = zstandard.ZstdDecompressor()
        means: list[list] = [[], []]
        for data, size, target in zip(left.column("data").to_pylist(), left.column("n").to_pylist(), left.column("target").to_pylist()):
            if not size:
                got = (None, None)
            else:
                ids = np.frombuffer(np.frombuffer(unzip.decompress(data), dtype=np.uint8).reshape(2, -1).T.tobytes(), dtype="<u2")
                got = [float(x.mean()) for x in losses(ids, target, model, n, vocab + 1, delta, mu)]
            for values, x in zip(means, got):
                values.append(x)
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": left.column("n"), "loss_target": pa.array(means[1], pa.float64()), "loss_background": pa.array(means[0], pa.float64())})

    got = tokens.select("run", "doc_id", "target", "n", "data").groupBy("run").cogroup(totals.groupBy("run")).applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double")
    return got.withColumn("score", F.col("loss_target") - F.col("loss_background"))
