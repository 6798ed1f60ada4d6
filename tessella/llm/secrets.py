"""Secret scans: fixed patterns, and two character Markov models compared by likelihood.

The fixed patterns find assignments to secret names, access keys and long hexadecimal strings
(:data:`KINDS`).  For everything else, strings of 20 or more characters of :data:`ALPHABET` are
scored by two first-order Markov models, one of random strings and one of ordinary identifiers
and words: the score is the sum over the characters of the logarithm of the ratio of their
probabilities given the character before (:func:`score`).  Strings whose score and mean score
exceed their thresholds, and that no fixed pattern overlaps, become spans of kind ``random``.

The models are counted from labelled strings (:func:`train`): transitions per label, smoothed
towards even draws for random strings and towards the characters' frequencies for ordinary ones.  :func:`labelled` takes them from a bounded sample of documents (``max_docs``, by hash):
values of the fixed patterns are secrets, long words of documents without any match are ordinary.
Without samples of both labels no string is flagged beyond the patterns.

Positions are code points, ends exclusive; matches are leftmost and do not overlap within a kind.
A null text counts as empty: no spans.  Repeated rows get equal spans; an empty table gives an
empty one.  Everything is built-in expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import whole_text

# The patterns, in the order that breaks ties of start.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> pattern, group whose length counts, least length
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: shortest text that can hold a match worth keeping, as a cheap test before positions are made
_MAY = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_STATES = len(ALPHABET) + 1  # 0 stands for the start
CANDIDATE, _CANDIDATE_MAY = r"[A-Za-z0-9+/_.=-]+", r"[A-Za-z0-9+/_.=-]{20}"
MIN_LENGTH, MIN_SCORE, MIN_MEAN = 20, 12.0, 0.6
PRIOR = 32.0  # transitions that the prior of a row weighs
ORDINARY = r"[A-Za-z0-9+/_.=-]{6,}"


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans (start, rank, end, kind, value) of the matches whose group is long enough.

    The parts between matches and the matches themselves give the positions."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.transform(F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: x)
    none = "CAST(ARRAY() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING, value: STRING>>)"

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
        found = F.when(F.length(m["value"]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), F.expr(none).alias("found")), step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind as listed."""
    none = F.expr("CAST(ARRAY() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING, value: STRING>>)")
    each = [
        F.when(text.rlike(_MAY[kind]), _spans(text, pattern, group, least, kind, k)).otherwise(none)
        for k, (kind, (pattern, group, least)) in enumerate(KINDS.items())
    ]
    return F.array_sort(F.concat(*each))


def candidate_spans(text: Column) -> Column:
    none = F.expr("CAST(ARRAY() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING, value: STRING>>)")
    return F.when(text.rlike(_CANDIDATE_MAY), _spans(text, CANDIDATE, 0, MIN_LENGTH, "random", len(KINDS))).otherwise(none)


def states(value: Column) -> Column:
    """Character numbers of a string, 0 in front."""
    codes = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))))
    return F.concat(F.array(F.lit(0)), F.when(F.length(value) > 0, codes).otherwise(F.expr("CAST(ARRAY() AS ARRAY<INT>)")))


def labelled(docs: DataFrame, text: str = "text", max_docs: int = 100_000) -> DataFrame:
    """(value, secret): strings labelled by the fixed patterns, of at most about ``max_docs``
    documents, chosen by hash."""
    every = max(1, math.ceil(docs.count() / max_docs))
    sample = docs.select(whole_text(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    found = sample.withColumn("spans", base_spans(F.col("t")))
    secret = found.select(F.explode("spans.value").alias("value"), F.lit(1).alias("secret"))
    plain = found.where(F.size("spans") == 0).select(F.explode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("value"), F.lit(0).alias("secret"))
    return secret.unionByName(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row, from (value, secret).

    The counts are summed by the cluster; at most one row per label and transition returns."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.get("s", i) * _STATES + F.get("s", i + 1))
    coded = samples.where(F.length("value") > 0).groupBy("value", "secret").agg(F.count(F.lit(1)).alias("n")).withColumn("s", states(F.col("value")))
    # a value counts once: repeated words say nothing new about what strings look like
    counted = coded.select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count()
    counts = [[0] * _STATES * _STATES for _ in range(2)]
    for r in counted.collect():  # bounded by the alphabet
        counts[r["secret"]][r["pair"]] = r["count"]
    if not any(counts[0]) or not any(counts[1]):
        return [0.0] * (_STATES * _STATES)
    # transitions never seen: random strings draw evenly, ordinary ones as their characters do
    seen = [[sum(c[b::_STATES]) for b in range(_STATES)] for c in counts]
    even = [1 / (_STATES - 1)] * _STATES
    usual = [(n + 1) / (sum(seen[0]) + _STATES) for n in seen[0]]

    def probability(c: list[int], prior: list[float], a: int, b: int) -> float:
        return (c[a * _STATES + b] + PRIOR * prior[b]) / (sum(c[a * _STATES : (a + 1) * _STATES]) + PRIOR)

    return [math.log(probability(counts[1], even, a, b) / probability(counts[0], usual, a, b)) for a in range(_STATES) for b in range(_STATES)]


def score(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string: random over ordinary."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    steps = lambda s: F.aggregate(
        F.sequence(F.lit(0), F.size(s) - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(s, i) * _STATES + F.get(s, i + 1)))
    return F.get(F.transform(F.array(states(value)), steps), F.lit(0))


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """All columns, ``base_spans`` and ``spans`` (start, rank, end, kind, value)."""
    found = docs.withColumn("__t", whole_text(text)).withColumn("base_spans", base_spans(F.col("__t")))
    free = lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    def random(c: Column) -> Column:
        s = score(c["value"], ratios)
        return F.get(F.transform(F.array(s), lambda x: (x >= MIN_SCORE) & (x >= MIN_MEAN * F.length(c["value"]))), F.lit(0))

    more = F.filter(F.filter(candidate_spans(F.col("__t")), free), random)
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", more))).drop("__t")


def listing(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(kind: str, spans: str = "base_spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
