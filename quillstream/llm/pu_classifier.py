"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1, the unlabelled set is text of any row, and the class
prior is estimated from these two alone: rows labelled 0 play no part. The model is additive over
a fixed set of surface features that Spark's built-in expressions compute, so scoring is one
projection: no Python sees a text.

The prior is the share of positives among unlabelled rows. First models are fitted to tell positives
from unlabelled text, each on four fifths of the sample, and score the fifth that they haven't seen.
The share of unlabelled rows above a score is at least prior x the share of positives above it, with
equality where only positives lie. The estimate is the ratio of the two at the threshold where it is
least once both shares' errors are added (best-bin estimation).

Training reads a bounded sample (a documented bound, the same at every size): at most ``sample``
positive rows and ``sample`` unlabelled rows, those with the least hash of id and text. Rows of the
held-out fold are never sampled, and positives are the only thing taken from the label table.

Null texts count as empty; an empty text has a score as well. Repeated ids are scored row by
row. Rows labelled null are unlabelled. Where there is nothing to learn from (no positive text in
the training folds, or an empty table) the model is constant and scores 0.5. Input columns named
like a result are replaced; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import fold
from quillstream.llm.rules import SPACES, STOP_WORDS

FOLDS = 5


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _count(text: Column, pattern: str) -> Column:
    """How many matches of a one-character pattern."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("double")


#: name -> column of one double, from the parts of a text (see features()).
FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "marks", "exclaims", "stops", "distinct", "adjacent",
    "dup_lines", "words_per_line", "commas", "stops_only", "long_words", "punct_words",
)


def features(text: Column) -> Column:
    """An array of doubles, one for each of FEATURES, from the whole text."""
    stop = sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())})

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACES, -1), "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

        def parts(s: Column) -> Column:
            w, ls = s["words"], s["lines"]
            n = F.greatest(F.size(w), F.lit(1)).cast("double")
            chars = F.greatest(F.length(t), F.lit(1)).cast("double")
            n_lines = F.greatest(F.size(ls), F.lit(1)).cast("double")
            same = F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("double")
            return F.array(
                F.log1p(F.size(w).cast("double")),
                F.length(F.array_join(w, "")) / n,
                _count(t, "\\p{Lu}") / chars,
                _count(t, "[0-9]") / chars,
                F.least(_count(t, "[#*$%&|<>]") / n, F.lit(3.0)),
                F.least(_count(t, "[{}\\[\\]()=_/\\\\;:@^~\"]") / n, F.lit(3.0)),
                F.least(_count(t, "[!?]") / n, F.lit(3.0)),
                F.size(F.filter(w, lambda x: x.isin(stop))) / n,
                F.size(F.array_distinct(w)) / n,
                same / n,
                (F.size(ls) - F.size(F.array_distinct(ls))) / n_lines,
                F.log1p(F.size(w) / n_lines),
                F.least(_count(t, "[.,]") / n, F.lit(3.0)),
                F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                F.size(F.filter(w, lambda x: F.length(x) > 14)) / n,
                F.size(F.filter(w, lambda x: x.rlike("[^\\p{L}\\p{N}]{2}"))) / n,
            )

        return _let(F.struct(words.alias("words"), lines.alias("lines")), parts)

    return _let(F.coalesce(text, F.lit("")), of)


@dataclass(frozen=True)
class Model:
    """Hat functions of each feature on its knots, and their weights."""

    knots: tuple[tuple[float, ...], ...]
    weights: tuple[tuple[float, ...], ...]
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (k, w) in enumerate(zip(self.knots, self.weights)):
            total += np.interp(x[:, j], k, w) if len(k) > 1 else 0
        return total

    def column(self, f: Column) -> Column:
        """The margin as a Spark expression: piecewise linear in each feature."""
        total = F.lit(self.bias)
        for j, (k, w) in enumerate(zip(self.knots, self.weights)):
            if len(k) < 2:
                continue
            x = F.greatest(F.lit(k[0]), F.least(F.lit(k[-1]), f[j]))
            value = F.lit(w[-1])
            for a, b, wa, wb in reversed(list(zip(k, k[1:], w, w[1:]))):
                value = F.when(x <= b, F.lit(wa) + (x - a) * F.lit((wb - wa) / (b - a))).otherwise(value)
            total = total + value
        return total


def hats(x: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """Design matrix of hat functions; each row has two neighbouring hats a feature."""
    out = []
    for j, k in enumerate(knots):
        if len(k) > 1:
            out.append(np.stack([np.interp(x[:, j], k, np.eye(len(k))[i]) for i in range(len(k))], axis=1))
    return np.concatenate(out, axis=1) if out else np.zeros((len(x), 0))


def choose_knots(x: np.ndarray, n: int = 7) -> list[np.ndarray]:
    """Quantiles with the range's ends, distinct."""
    q = np.concatenate([[0, 0.005, 0.02], np.linspace(0.1, 0.9, n), [0.98, 0.995, 1]])
    return [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, size: int, *, rounds: int, rate: float, settled: float) -> np.ndarray:
    """Adam on full batches until no weight moves more than ``settled`` in 25 rounds.

    ``gradient(w, t)``; the rate falls with the root of the rounds so that moves die out.
    """
    w = last = np.zeros(size)
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate / np.sqrt(1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        if t % 25 == 0:
            if np.abs(w - last).max() < settled:
                break
            last = w
    return w


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 1500, rate: float = 0.1, decay: float = 1e-4, settled: float = 0.02) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss.

    risk = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part is negative
    its gradient is followed upwards instead, which keeps the model from fitting positives as
    negatives. The risk leaves the margin's zero open where the classes part well, so it is then
    moved up until all but 0.2 % of the trusted positives have a margin of at least 1.
    """
    knots = choose_knots(np.concatenate([positive, unlabelled]))
    p, u = (np.column_stack([hats(x, knots), np.ones(len(x))]) for x in (positive, unlabelled))
    loss = np.append(np.full(p.shape[1] - 1, decay), 0.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, down = (_sigmoid(zp) - 1) / len(p), _sigmoid(zp) / len(p)
        gu = _sigmoid(zu) / len(u)
        a, b = (prior * (up - down), gu) if negative >= 0 else (prior * down, -gu)
        return p.T @ a + u.T @ b + loss * w

    w = _descend(gradient, p.shape[1], rounds=rounds, rate=rate, settled=settled)
    bias = float(w[-1]) - max(0.0, float(np.quantile(p @ w, 0.002)) - 1.0)  # nearly all trusted positives stay above 0.7
    weights, at = [], 0
    for k in knots:
        n = len(k) if len(k) > 1 else 0
        weights.append(tuple(w[at : at + n].tolist()))
        at += n
    return Model(tuple(tuple(k.tolist()) for k in knots), tuple(weights), bias, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, keys: tuple[np.ndarray, np.ndarray] | None = None, parts: int = 5) -> float:
    """Share of positives among unlabelled rows, from features of both, within [0.05, 0.999].

    ``keys`` numbers the rows of both: a row that is in both must not score itself, so rows of one
    number fall in one part.
    """
    if min(len(positive), len(unlabelled)) < 5 * parts:
        return 0.5  # too few rows to tell
    knots = choose_knots(np.concatenate([positive, unlabelled]))
    p, u = (np.column_stack([hats(x, knots), np.ones(len(x))]) for x in (positive, unlabelled))
    part_p, part_u = (k % parts for k in keys or (np.arange(len(p)), np.arange(len(u))))
    loss = np.append(np.full(p.shape[1] - 1, 1e-3), 0.0)
    zp, zu = np.zeros(len(p)), np.zeros(len(u))
    for k in range(parts):  # each row is scored by a model that hasn't seen it
        fit_p, fit_u = p[part_p != k], u[part_u != k]
        if not len(fit_p) or not len(fit_u):
            return 0.5

        def gradient(w: np.ndarray) -> np.ndarray:
            a, b = (_sigmoid(fit_p @ w) - 1) / len(fit_p) / 2, _sigmoid(fit_u @ w) / len(fit_u) / 2  # noqa: B023
            return fit_p.T @ a + fit_u.T @ b + loss * w  # noqa: B023

        w = _descend(gradient, p.shape[1], rounds=300, rate=0.1, settled=0.02)
        zp[part_p == k], zu[part_u == k] = p[part_p == k] @ w, u[part_u == k] @ w
    zp, zu = np.sort(zp), np.sort(zu)
    cuts = np.unique(np.quantile(zp, np.linspace(0, 0.9, 181)))
    above_p, above_u = 1 - np.searchsorted(zp, cuts) / len(zp), 1 - np.searchsorted(zu, cuts) / len(zu)
    error = sum(np.sqrt(np.log(40) / 2 / n) for n in (len(zp), len(zu)))  # Hoeffding's bound for either share
    best = int(((above_u + error) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.999))


#: What scores where there is nothing to learn from.
CONSTANT = Model(((),) * len(FEATURES), ((),) * len(FEATURES), 0.0, 0.5)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, folds: int = FOLDS, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` positive rows and ``sample`` unlabelled rows of the training folds."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(fold(F.col("doc_id"), folds) != held_out)
    good = labels.filter(F.col(label_col).cast("int") == 1).select(F.col(id_col).alias("doc_id"))
    good = good.join(base.select("doc_id"), "doc_id", "left_semi").distinct()  # of the rows at hand
    ids = [r[0] for r in good.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(sample).collect()]
    n = base.count()
    if not ids or not n:
        return CONSTANT
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {dict(base.dtypes)['doc_id']}")
    order = F.xxhash64("doc_id", "text", F.lit(11))
    share = min(1.0, 1.2 * (sample + 500) / n)  # rows of a hash range: more than the sample, by little
    some = base.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    x, y, keys = [], [], []
    for mark, rows in ((1, base.join(F.broadcast(few), "doc_id")), (0, some)):
        got = rows.select(features(F.col("text")).alias("f"), order.alias("h")).orderBy("h").limit(sample).collect()
        x += [r["f"] for r in got]
        keys += [r["h"] for r in got]
        y += [mark] * len(got)
    x, y = np.array(x, dtype=float).reshape(-1, len(FEATURES)), np.array(y, dtype=int)
    positive, unlabelled = x[y == 1], x[y == 0]
    if not len(positive) or not len(unlabelled):
        return CONSTANT
    keys = np.array(keys, dtype=np.int64)
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled, (keys[y == 1], keys[y == 0])))


def score_of(text: Column, model: Model) -> Column:
    """A text's score, 0 to 1, as one expression."""
    return _let(features(text), lambda f: 1 / (1 + F.exp(-model.column(f))))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, folds: int = FOLDS, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold)."""
    own = ["held_out", "score", "predicted"]
    rest = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in own]
    scored = docs.select(*rest, (fold(F.col(id_col), folds) == held_out).alias("held_out"), score_of(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
