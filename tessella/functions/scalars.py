"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.frames import col

# Exchange suffixes removed from a symbol.
EXCHANGE_SUFFIXES = (
    ".TO", ".V", ".CN", ".NE", ".HK", ".SS", ".SZ", ".L", ".DE", ".F", ".BE", ".SW", ".PA", ".AS", ".MI",
    ".BR", ".CO", ".HE", ".OL", ".MC", ".VI", ".VX", ".SG", ".KS", ".KQ", ".ST", ".IS", ".TW", ".TWO",
)
# Share-class and preferred suffixes, removed one after the other.
SHARE_CLASS_PATTERNS = (r"\.[A-Z]$", r"-[A-Z]$", r"\.PR[A-Z]$", r"-PR[A-Z]$", r"\.P[A-Z]$", r"-P[A-Z]$")
# Fixed value: endings of warrants and units.
WARRANT_OR_UNIT = r"(-WS|-WT|-W|-U|\.WS|\.WT|\.U|/WS|/WT|/U)$"
# Bounds and wording of the probability descriptions.
BULLISH_WORDING = (
    (0.70, "strong bullish research signal"),
    (0.60, "bullish research signal"),
    (0.55, "modest bullish lean"),
)
BEARISH_BOUND, BEARISH_WORDING, NEUTRAL_WORDING = 0.40, "bearish/avoid signal", "neutral / watch only"


def norm_ticker(c: str | Column) -> Column:
    return F.upper(F.trim(F.coalesce(col(c), F.lit(""))))


def is_warrant_or_unit(c: str | Column) -> Column:
    return F.upper(col(c)).rlike(WARRANT_OR_UNIT)


def canonical_base(c: str | Column) -> Column:
    """Symbol without exchange suffix (longest match first), share class and separators."""
    s = F.upper(F.trim(col(c)))
    longest = sorted(EXCHANGE_SUFFIXES, key=len, reverse=True)
    s = F.regexp_replace(s, "(" + "|".join(x.replace(".", r"\.") for x in longest) + ")$", "")
    for p in SHARE_CLASS_PATTERNS:
        s = F.regexp_replace(s, p, "")
    return F.regexp_replace(s, "[.\\-/]", "")


def hash_id(cols: Sequence[str | Column], n: int = 24, sep: str = "|") -> Column:
    """First ``n`` hex digits of the SHA-256 of the joined fields."""
    text = F.concat_ws(sep, *[col(c).cast("string") for c in cols])
    return F.substring(F.sha2(text, 256), 1, n)


def hash_coord(c: str | Column, part: int = 0) -> Column:
    """Deterministic coordinate in +-1.1 from the ``part``-th four bytes of the SHA-256."""
    hexed = F.substring(F.sha2(col(c), 256), 1 + 8 * part, 8)
    return (F.conv(hexed, 16, 10).cast("double") / F.lit(4294967296.0) - 0.5) * 2.2


def describe_probability(c: str | Column) -> Column:
    x = col(c)
    out = F
    for bound, words in BULLISH_WORDING:
        out = out.when(x >= bound, words)
    return out.when(x <= BEARISH_BOUND, BEARISH_WORDING).otherwise(NEUTRAL_WORDING)


def sigmoid(c: str | Column, bound: float = 30.0) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))))


def logit(c: str | Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(c)))
    return F.when(col(c).isNotNull(), F.ln(p / (1 - p)))


def week_start(c: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", col(c)))


def epoch_ms_date(c: str | Column) -> Column:
    """UTC day of an epoch-millisecond stamp, independent of the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(c) / 86_400_000).cast("int"))


def is_iso_date(c: str | Column) -> Column:
    return col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & col(c).try_cast("date").isNotNull()


def coalesce_dates(cols: Sequence[str]) -> Column:
    """First column that parses as a date."""
    return F.coalesce(*[F.col(c).try_cast("date") for c in cols])


def truthy(c: str | Column) -> Column:
    return F.when(F.lower(col(c).cast("string")).isin("true", "1", "yes"), 1).otherwise(0)


def exact_hundredths(c: Column) -> Column:
    """A value that prints with two digits as the exact binary value of ``c`` rounds, halves to even.

    Java rounds the shortest decimal form half up: 1.005 lies below 1.005 and printed 1.01.  Only
    doubles next to an odd number of half hundredths are concerned; ``past`` is their exact
    distance from it, as both halves of a split double times 1000 are exact."""
    a = F.abs(c)
    t = F.rint(a * 1000)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    past = (high * 1000 - t) + (a - high) * 1000
    down = F.floor(t / 10).cast("double")
    up = (past > 0) | ((past == 0) & (down % 2 == 1))
    near = F.when(up, down + 1).otherwise(down) / 100
    return F.when((t / 1000 == a) & (t % 10 == 5), F.when(c < 0, -1.0).otherwise(1.0) * near).otherwise(c)


def driver_text(contributions: str | Column, positive: bool = True, limit: int = 3) -> Column:
    """``name (+0.12); ...`` for the strongest contributions of one sign.

    ``contributions`` is an array of struct(value, name)."""
    arr = col(contributions)
    kept = F.filter(arr, lambda x: x["value"] > 0 if positive else x["value"] < 0)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["value"] > b["value"], -1 if positive else 1)
                           .when(a["value"] < b["value"], 1 if positive else -1).otherwise(0))
    return F.array_join(F.transform(F.slice(ordered, 1, limit), lambda x: F.format_string("%s (%+.2f)", x["name"], exact_hundredths(x["value"]))), "; ")


def entity_key(share_figi: str, comp_figi: str, cik: str, ticker: str) -> Column:
    """Share-class FIGI, else composite FIGI, else CIK, else ticker; blanks count as missing."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(blank(share_figi), blank(comp_figi), F.concat(F.lit("CIK:"), blank(cik)), F.concat(F.lit("TICKER:"), F.col(ticker)))


def parse_holdings(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``TICKER, quantity`` lines to rows summed per ticker; blank and ``#`` lines are skipped."""
    lines = df.select(*keep, F.explode(F.split(F.col(text), r"\r?\n")).alias("_l"))
    lines = lines.withColumn("_l", F.trim("_l")).where((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    parts = lines.withColumn("_p", F.filter(F.split("_l", r"[,\s]+"), lambda x: x != ""))
    rows = parts.select(*keep, F.upper(F.get("_p", F.lit(0))).alias("ticker"), F.get("_p", F.lit(1)).try_cast("double").alias("quantity"))
    return rows.where(F.col("quantity") > 0).groupBy(*keep, "ticker").agg(F.sum("quantity").alias("quantity"))


DRAW_BITS = 52


def draw_number(seed: int, *cols: str) -> Column:
    """A pseudo-random integer below 2**DRAW_BITS from the texts of columns, the same in any
    engine: the leading 13 digits of the MD5 of seed and values joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")
