"""Best-fit packing by patterns: non-negative least squares over length histograms.

Whether documents are packed well depends on the histogram of their lengths alone, and that has
at most ``size`` bins at any scale. So the plan is made on the driver from those bins:

1. candidate patterns (multisets of at most ``most`` lengths that fill a sequence well) are
   enumerated from the bins by best fit, several for each length;
2. non-negative least squares fits repeat counts of the patterns to the histogram;
3. counts are rounded down to what the bins can pay for;
4. the residual is packed by best-fit decreasing, run on (length, count) pairs.

The result is a table of slots (length, rank from, rank to, first sequence, offset), and pieces
find their place by their rank among those of equal length. Ranks are counted in salted groups,
so a length that holds a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillstream.llm.common import stored
from quillstream.llm.tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and cut those longer than ``size``; only the first piece is short.

    A null text is empty; every document has at least its end id. Documents with null or equal
    ids are pieces of their own. Narrow: no shuffle.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist())):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                first = n % size or size
                at = 0
                for k, b in enumerate(range(first, n + 1, size)):
                    rows.append((doc_id, k, at, b - at, zlib.crc32(data[4 * at : 4 * b])))
                    at = b
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return base.mapInArrow(cut, PIECE)


def nnls(rows: np.ndarray, weight: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes ||W (A x - b)|| small: accelerated projected gradient.

    Column j of A counts the bins that ``rows[j]`` names (the last bin is a stand-in of weight 0),
    so A is never formed.
    """
    n = len(weight)
    times = lambda x: weight * np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=n)
    back = lambda r: (weight * r)[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue gives the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step, goal = 1 / max(1.05 * top, 1e-12), weight * b
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - goal))
        if (y - new) @ (new - x) > 0:  # restart where momentum points uphill
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def enumerate_patterns(lengths: list[int], counts: dict[int, int], size: int, most: int) -> list[tuple[int, ...]]:
    """Patterns of 1 to ``most`` lengths, each begun by every length: exact fills where they exist.

    For two lengths the complement is the longest that fits; for more, the middle ones are taken
    at several fractions of the space left, and the last is the longest that fits.
    """
    rows = sorted(lengths)
    found: set[tuple[int, ...]] = set()

    def longest(space: int) -> int | None:
        k = bisect_right(rows, space) - 1
        return rows[k] if k >= 0 else None

    def grow(have: tuple[int, ...], space: int) -> None:
        found.add(tuple(sorted(have, reverse=True)))
        if len(have) >= most or space < rows[0]:
            return
        picks = {longest(space)}
        if len(have) + 1 < most:
            picks |= {longest(int(space * f)) for f in (0.75, 0.5, 0.34)} - {None}
        for x in picks:
            grow((*have, x), space - x)

    for x in rows:
        grow((x,), size - x)
    return sorted(p for p in found if sum(p) >= 0.97 * size or len(p) == 1)


def pack_histogram(histogram: dict[int, int], size: int, *, most: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly; sums of patterns are <= size.

    The number of patterns is bounded by ``size`` and ``most`` alone, so all of them are fitted.
    """
    left = {int(x): int(n) for x, n in histogram.items() if n > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if size in left:
        plan.append(((size,), left.pop(size)))
    if left:
        patterns = [p for p in enumerate_patterns(list(left), left, size, most) if sum(p) >= 0.97 * size]
        patterns.sort(key=lambda p: (size - sum(p), len(p), p))
        if patterns:
            bins = sorted(left)
            row = {x: k for k, x in enumerate(bins)}
            rows = np.array([[row[v] for v in p] + [len(bins)] * (most - len(p)) for p in patterns])
            have = np.array([left[v] for v in bins], dtype=float)
            weight = np.append(1 / np.sqrt(have), 0.0)  # as a Poisson count's error
            x = nnls(rows, weight, np.append(have, 0.0))
            for j in np.argsort(-x, kind="stable").tolist():
                p = patterns[j]
                need: dict[int, int] = {}
                for v in p:
                    need[v] = need.get(v, 0) + 1
                n = min(int(x[j]), *(left[v] // k for v, k in need.items()))
                if n > 0:
                    plan.append((p, n))
                    for v, k in need.items():
                        left[v] -= n * k
    plan += best_fit({x: n for x, n in left.items() if n}, size)
    return plan


def best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on (length, count) pairs: equal sequences are opened and filled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # space left -> pattern -> how many
    spaces: list[int] = []

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in bins:
            spaces.insert(bisect_left(spaces, space), space)
            bins[space] = {}
        bins[space][pattern] = bins[space].get(pattern, 0) + n

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            k = bisect_left(spaces, x)
            if k == len(spaces):
                each = size // x  # open sequences, each filled with x alone as far as it goes
                if n >= each:
                    put(size - each * x, (x,) * each, n // each)
                    n %= each
                if n:
                    put(size - n * x, (x,) * n, 1)
                break
            space = spaces[k]
            pattern, have = next(iter(bins[space].items()))
            take = min(n, have)
            if have == take:
                del bins[space][pattern]
                if not bins[space]:
                    del bins[space]
                    spaces.pop(k)
            else:
                bins[space][pattern] = have - take
            put(space - x, (*pattern, x), take)
            n -= take
    return [(p, n) for space in spaces for p, n in bins[space].items()]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to (excluded), first sequence, offset) of every slot of the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan:
        at = 0
        for x in pattern:
            rank = used.get(x, 0)
            out.append((x, rank, rank + n, sequence, at))
            used[x] = rank + n
            at += x
        sequence += n
    return out


def pack_pieces(pieces: DataFrame, size: int, *, most: int = 4, group: int = 200_000) -> DataFrame:
    """Give every piece a sequence_id and an offset; ``pieces`` must be a stored table.

    The driver sees one row a length (at most ``size`` rows). Ranks among equal lengths come from
    salted groups of about ``group`` rows; the counts of groups are summed before them.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(pack_histogram(histogram, size, most=most))
    salts = max(1, -(-max(histogram.values(), default=1) // group))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    by = ["length", "_salt"]
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    if salts > 1:
        before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
        counts = salted.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
        ranked = ranked.join(counts, by).withColumn("_k", F.col("_k") + F.col("_before")).drop("_before")
    per: dict[int, tuple[list, list, list, list]] = {}
    for x, a, b, sequence, at in table:
        for col, v in zip(per.setdefault(x, ([], [], [], [])), (a, b, sequence, at)):
            col.append(v)

    columns = pieces.columns

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrays = {x: tuple(map(np.array, cols)) for x, cols in per.items()}
        for batch in batches:
            lengths, ranks = batch.column(columns.index("length")).to_numpy(), batch.column(len(columns)).to_numpy()
            sequence, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for x in np.unique(lengths):
                mine = lengths == x
                begin, _, first, offset = arrays[int(x)]
                k = np.searchsorted(begin, ranks[mine], side="right") - 1
                sequence[mine], at[mine] = first[k] + ranks[mine] - begin[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(at)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns, F.col("_k").cast("long")).mapInArrow(place, kinds + ", sequence_id long, offset long")


def pattern_packing(docs: DataFrame, tokenizer: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """Pack whole documents into as few sequences of ``size`` tokens as the patterns allow.

    Null texts are empty documents of one id; repeated rows are packed one by one; an empty table
    gives no rows; other columns are ignored.
    """
    pieces = stored(cut_pieces(docs, tokenizer, end_id, size, id_col=id_col, text_col=text_col), "pieces")
    return pack_pieces(pieces, size, most=most)
