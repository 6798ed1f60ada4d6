"""Quality rules: a table of thresholds compiled into one projection without user functions.

``measures`` adds the counts, ``RULES`` bounds ratios of them, ``verdict`` turns the table into
a Boolean column and ``failed_rules`` into the names of the rules a text breaks.

Words are runs of characters other than ASCII white space; lines are cut at ``\\n`` and count
only with a word in them.  A null text counts as empty: no words, so it fails the base rule.
Repeated rows get equal verdicts; an empty table gives an empty one; columns named like a
measure are replaced.  Work per text is proportional to its words, and to words times their
logarithm where five-word windows repeat.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, whole_text, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on this are from or the at an not "
    "la le les de des et un une que qui pour par sur avec dans est du au "
    "der die das und ist in den von zu mit ein eine auf im für dem sich "
    "el los las y del en por con una se lo su"
)

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5  # words in a window that counts as repeated

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


@dataclass(frozen=True)
class Rule:
    """``low <= part / whole <= high`` for texts of ``at_least`` words or more."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0


#: Production thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, at_least=50),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Hashes decide only that nothing repeats; windows that may repeat are compared as texts:
    sorted, so that equal ones are neighbours, and the covered words added up in text order."""
    n = F.size(tokens)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[_at(tokens, i + k) for k in range(window)]))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, window), " ").alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda j, k: F.coalesce(_at(s, j)["w"] == _at(s, k)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: (F.when(j > 0, same(j, j - 1)).otherwise(False)) | same(j, j + 1))
        places = F.array_sort(F.transform(twice, lambda j: _at(s, j)["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        add = lambda acc, p: F.struct((p + window).alias("end"), (acc["n"] + F.least(F.lit(window), p + window - acc["end"])).alias("n"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    exact = _at(F.transform(F.array(windows), covered), F.lit(0))
    repeats = F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.coalesce(_at(repeats, F.lit(0)), F.lit(False)), exact).otherwise(0).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the counts of :data:`MEASURES` (long)."""
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    stop = sorted(set(STOP_WORDS.split()))
    return (
        df.drop(*MEASURES)
        .withColumn("__text", whole_text(text))
        .withColumns({"__words": words(t), "__lines": lines})
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__words")),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(*stop))).cast("long"),
        })
        .drop("__text", "__words", "__lines")
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _breaks(rule: Rule) -> Column:
    part, whole = F.col(rule.part), F.col(rule.whole)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (part < rule.low * whole)
    if rule.high is not None:
        out = out | (part > rule.high * whole)
    return (F.col("n_words") >= rule.at_least) & out


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """True for texts that pass the base rule and every rule of the table."""
    bad = base_failed()
    for r in rules:
        bad = bad | _breaks(r)
    return ~bad


def failed_rules(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules a text breaks, in the order of the table."""
    hits: Mapping[str, Column] = {"base": base_failed(), **{r.name: _breaks(r) for r in rules}}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in hits.items()]), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Only the rows that pass, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    measured = measures(df.select(row.alias("__row"), F.col(f"`{text}`").alias("text")))
    # a generator instead of a filter: the optimizer would copy the measures into each use of
    # them on the way down to the scan
    passed = F.explode(F.filter(F.array(verdict(rules)), lambda x: x))
    return measured.select("__row", passed.alias("__kept")).select("__row.*")
