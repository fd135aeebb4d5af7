"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is the ``size`` most frequent character n-grams (n = 1..3) with their ranks. A
language's profile counts all training texts of that language; a document's counts its whole
text; the predicted language has the least sum of rank differences, where an n-gram that the
language's profile lacks counts ``size``.

Texts are lower-cased; every run of characters that aren't letters becomes one space, so words
have a space at both ends. The lone space is no n-gram. An n-gram is an exact 63-bit code of its
code points. Ties in frequency go to the lesser code, ties in distance to the language first in
alphabetical order.

Null texts and texts without a letter get ``und`` and score 0.0. Training ignores rows whose
text or language is null and languages without a letter; with nothing to learn from every
document gets ``und``. Repeated rows count each time. The prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import fold

UNKNOWN = "und"
_POINTS = 0x110000


def _letter_table() -> np.ndarray:
    import sys
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


_LETTER: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space (0) before, between and after words."""
    if not _LETTER:
        _LETTER.append(_letter_table())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[0][points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 0).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a word stays, as its end
    points = points[keep]
    head = [0] if points[0] else []
    return np.concatenate([head, points, [0] if points[-1] else []]).astype(np.int64)


def gram_codes(points: np.ndarray, most: int = 3) -> np.ndarray:
    """Codes of all n-grams with n = 1..most (not the lone space), sorted.

    A code packs code points in 21 bits each; n-grams across a space other than at their ends
    don't arise for n <= 2 and are left out for n = 3.
    """
    out = [points[points > 0]]
    if most >= 2 and len(points) > 1:
        out.append((points[:-1] << 21 | points[1:]) + (1 << 62))
    if most >= 3 and len(points) > 2:
        inner = points[1:-1] > 0
        tri = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        out.append((tri[inner].view(np.uint64) | np.uint64(1 << 63)).view(np.int64))
    codes = np.concatenate(out)
    codes.sort()
    return codes


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each comes."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edge], np.diff(np.append(edge, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first; ties to the lesser code."""
    if len(codes) > 4 * size:  # only counts of at least the size-th largest can matter
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, *, size: int = 300, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles of all languages from every training text.

    Partial counts leave each task once (distinct n-grams of a language), are summed by key, and
    the driver gets ``size`` codes a language.
    """
    base = docs.filter((fold(F.col(id_col), folds) != held_out) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    base = base.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        held: dict[str, list] = {}  # language -> [codes, counts], merged as it grows
        size_of: dict[str, int] = {}

        def merge(lang: str) -> None:
            codes, counts = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            held[lang] = [(codes[edge], np.add.reduceat(counts, edge) if len(edge) else counts)]
            size_of[lang] = len(edge)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = counted(gram_codes(letters_of(text)))
                held.setdefault(lang, []).append(got)
                size_of[lang] = size_of.get(lang, 0) + len(got[0])
                if size_of[lang] > 1_000_000:
                    merge(lang)
                    if size_of[lang] > 500_000:  # hand on what is counted so far
                        codes, counts = held.pop(lang)[0]
                        size_of.pop(lang)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], schema=schema)
        for lang in list(held):
            merge(lang)
            codes, counts = held.pop(lang)[0]
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], schema=schema)

    sums = base.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = sums.withColumn("rank", rank).filter(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in profiles.items()}


def distances(profile: np.ndarray, table: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Out-of-place distance of a document's profile to each language."""
    codes, ranks = table  # all codes of all profiles, sorted; rank of each in each language
    at = np.minimum(np.searchsorted(codes, profile), len(codes) - 1)
    known = codes[at] == profile
    place = np.where(known[:, None], ranks[at], -1)
    apart = np.where(place >= 0, np.abs(place - np.arange(len(profile))[:, None]), size)
    return apart.sum(axis=0)


def rank_table(profiles: dict[str, np.ndarray]) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[x] for x in langs]))
    ranks = np.full((len(codes), len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(codes, profiles[lang]), j] = np.arange(len(profiles[lang]))
    return langs, (codes, ranks)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, size: int = 300, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score = 1 - distance / the largest distance possible."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        langs, table = rank_table(profiles) if profiles else ([], None)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(len(keep)).to_pylist():
                points = letters_of(text) if text and langs else ()
                if not len(points):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = top(*counted(gram_codes(points)), size)
                far = distances(own, table, size)
                best = int(far.argmin())
                found.append(langs[best])
                scores.append(1 - float(far[best]) / (size * len(own)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def identify(docs: DataFrame, *, size: int = 300, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the training folds and predict every row: id, held_out, lang_pred, score."""
    profiles = learn(docs, size=size, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    got = predict(docs.select(id_col, text_col), profiles, size=size, text_col=text_col, keep=(id_col,))
    return got.select(id_col, (fold(F.col(id_col), folds) == held_out).alias("held_out"), "lang_pred", "score")
