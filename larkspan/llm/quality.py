"""Quality rules: a threshold table compiled into one projection of built-in functions.

The metrics need no user function.  Words are the runs of ``[^\\x20\\x09-\\x0D]``.  Repeated 8-word windows are
found inside the row: window hashes are compared as an array, and only texts with a repeat pay for the positions.

Cases: a null text has no words, no symbols and no lines (all counts 0, ``base_failed`` true, ``kept`` false); an
empty text likewise.  Every input row gives one output row, equal rows included; columns that clash with a metric's
name are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine "
    "le la les des est un une que qui dans en du pour pas au sur "
    "el los las del que por una con no su para es al lo"
).split()

#: (rule, metric, lowest allowed, highest allowed); None is open.  A text keeps if every rule holds.
RULES = (
    ("length", "n_words", 20, None),
    ("word_length", "mean_word_chars", 2.0, 20.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.3),
    ("repeats", "repeat_ratio", None, 0.3),
)


def _repeat_words(words: Column, n: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more in the text, the first occurrence included."""

    def covered(h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            at = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            return let(
                F.array_sort(F.transform(at, lambda x: x["i"])),
                lambda p: F.aggregate(
                    F.transform(
                        p,
                        lambda v, i: F.when(i + 1 < F.size(p), F.least(F.lit(window), F.get(p, i + 1) - v))
                        .otherwise(F.lit(window))
                        .cast("long"),
                    ),
                    F.lit(0).cast("long"),
                    lambda a, v: a + F.coalesce(v, F.lit(0)),
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(order, repeated))

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))
    )
    return F.when(n < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def metrics(text: Column, stop_words=STOP_WORDS, window: int = WINDOW) -> Column:
    """One struct of all metrics of a text, computed from one word array."""
    text = F.coalesce(text, F.lit(""))
    word = f"[^{SPACE}]+"
    stops = F.array(*[F.lit(w) for w in stop_words])

    def lines(t):
        return let(
            F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        )

    def per_words(t):
        return let(
            F.regexp_extract_all(t, F.lit(word), F.lit(0)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                lines(t).alias("lines"),
                _repeat_words(w, F.size(w), window).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.array_contains(stops, F.lower(x)))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(text, per_words)


def compile_rules(rules=RULES) -> Column:
    """The rule table as one boolean expression."""
    verdict = F.lit(True)
    for _, metric, low, high in rules:
        if low is not None:
            verdict = verdict & (F.col(metric) >= F.lit(low))
        if high is not None:
            verdict = verdict & (F.col(metric) <= F.lit(high))
    return verdict


def quality(docs: DataFrame, text_col: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with the metrics, the ratios the rules use, ``base_failed`` and ``kept``.

    The base rule is fixed: fewer than 20 words, or over 30 per cent of the words in repeated 8-word windows.
    """
    own = {
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
        "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio", "base_failed", "kept",
    }
    base = docs.select(*[c for c in docs.columns if c not in own], metrics(docs[text_col], stop_words).alias("_m"))
    keep = [c for c in base.columns if c != "_m"]
    m = F.col("_m")
    flat = base.select(
        *keep,
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["n"].cast("long").alias("n_lines"),
        m["lines"]["dup"].cast("long").alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        m["n_stop_words"].alias("n_stop_words"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    flat = flat.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("n_stop_words") / words).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    return flat.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
