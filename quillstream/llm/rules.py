"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), and
lines are what line feeds part. Everything is built-in expressions on the text column; hot or
long texts stay within their row, and no step is worse than n log n in the words of a text.

Null texts count as empty. Texts without words have 0 for every count and 0.0 for every ratio.
Repeated rows each get their own result. An input column named like a metric is replaced; all others
stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import unused

WINDOW = 8
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the languages the table is meant for.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on as with by at from this are or be an have he not",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au avec ne se pas plus il ce",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o es",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a bound that is None isn't tested."""

    metric: str
    low: float | None = None
    high: float | None = None


#: length, symbol, stop-word and line ratios. Short documents pass what their length can't show.
DEFAULT_RULES = (
    Rule("n_words", low=20),
    Rule("repeat_word_ratio", high=0.3),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_word_ratio", high=0.1),
    Rule("exclaim_word_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.04),
    Rule("dup_line_ratio", high=0.5),
    Rule("words_per_line", low=2.0),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_stop_words")
RATIOS = ("mean_word_chars", "symbol_word_ratio", "exclaim_word_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio", "words_per_line")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the text has more than once.

    Windows are compared by a chained 64-bit hash. Texts without a repeat leave after a hash-set
    pass; others sort (hash, position), so that equal windows are neighbours.
    """
    n = F.size(words) - (window - 1)

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = F.transform(
                p,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))),
                    x["i"],
                ),
            )
            at = F.array_sort(F.array_compact(same))
            return _let(
                at,
                lambda a: F.aggregate(
                    F.transform(a, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(a, i + 1) - x, F.lit(window)))),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))

    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n < 2, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def metrics(text: Column) -> Column:
    """All counts of a text as one struct (see METRICS); texts and words are each formed once."""
    stop = sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())})

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        words = F.array_remove(F.split(t, SPACES, -1), "")
        return _let(
            F.struct(words.alias("words"), lines.alias("lines")),
            lambda s: F.struct(
                F.size(s["words"]).cast("long").alias("n_words"),
                F.length(F.array_join(s["words"], "")).cast("long").alias("word_chars"),
                (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
                (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).cast("long").alias("n_dup_lines"),
                _repeat_words(s["words"]).alias("n_repeat_words"),
                F.size(s["lines"]).cast("long").alias("n_lines"),
                (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
                F.size(F.filter(s["words"], lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def ratio_columns(m) -> dict[str, Column]:
    """The ratios of counts; ``m(name)`` is the column of a count."""
    return {
        "mean_word_chars": _ratio(m("word_chars"), m("n_words")),
        "symbol_word_ratio": _ratio(m("n_symbols"), m("n_words")),
        "exclaim_word_ratio": _ratio(m("n_exclaims"), m("n_words")),
        "stop_word_ratio": _ratio(m("n_stop_words"), m("n_words")),
        "dup_line_ratio": _ratio(m("n_dup_lines"), m("n_lines")),
        "repeat_word_ratio": _ratio(m("n_repeat_words"), m("n_words")),
        "words_per_line": _ratio(m("n_words"), m("n_lines")),
    }


def compile_rules(rules: tuple[Rule, ...], m) -> Column:
    """One boolean expression: does a document pass every rule?"""
    ratios, passed = ratio_columns(m), F.lit(True)
    for rule in rules:
        value = ratios[rule.metric] if rule.metric in ratios else m(rule.metric)
        if rule.low is not None:
            passed = passed & (value >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (value <= F.lit(rule.high))
    return passed


def _base_failed(m, min_words: int, max_repeat_percent: int) -> Column:
    return (m("n_words") < min_words) | (100 * m("n_repeat_words") > max_repeat_percent * m("n_words"))


def passes(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES, *, min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Whether a text is kept, as one expression."""
    return _let(metrics(text), lambda s: ~_base_failed(lambda x: s[x], min_words, max_repeat_percent) & compile_rules(rules, lambda x: s[x]))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, *, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; narrow, no shuffle, no Python."""
    at = unused(docs, "quality")
    with_m = docs.withColumn(at, metrics(F.col(text_col)))
    m = lambda name: F.col(f"{at}.{name}")
    base = _base_failed(m, min_words, max_repeat_percent)
    own = [*METRICS, "base_failed", "kept"]
    return with_m.select(
        *[with_m[f"`{c}`"] for c in docs.columns if c.lower() not in own],
        *[m(x).alias(x) for x in METRICS],
        base.alias("base_failed"),
        (~base & compile_rules(rules, m)).alias("kept"),
    )


def oracle_sql(rules: tuple[Rule, ...] = DEFAULT_RULES) -> str:
    """DuckDB SQL of the query's rows, on the table ``documents``."""
    stop = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())}))
    ratios = {
        "mean_word_chars": "word_chars / n_words", "symbol_word_ratio": "n_symbols / n_words", "exclaim_word_ratio": "n_exclaims / n_words",
        "stop_word_ratio": "n_stop_words / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_word_ratio": "n_repeat_words / n_words", "words_per_line": "n_words / n_lines",
    }
    tests = []
    for r in rules:
        value = f"coalesce(CAST({ratios[r.metric].replace(' / ', ' AS DOUBLE) / nullif(')}, 0), 0.0)" if r.metric in ratios else r.metric
        tests += [f"{value} >= {r.low}"] if r.low is not None else []
        tests += [f"{value} <= {r.high}"] if r.high is not None else []
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, {WINDOW}) AS s(k) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
             CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b
"""
