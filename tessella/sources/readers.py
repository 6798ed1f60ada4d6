"""Scans and payload parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import epoch_ms_date, norm_ticker

# Names under which the four price columns arrive, in order of preference.
PRICE_ALIASES = {
    "ticker": ("ticker", "symbol", "Ticker", "Symbol"),
    "date": ("date", "begins_at", "Date", "timestamp", "as_of_date"),
    "close_price": ("close_price", "close", "Close", "adj_close"),
    "volume": ("volume", "Volume", "vol"),
}


def resolve_columns(df: DataFrame, spec: Mapping[str, Sequence[str]] = PRICE_ALIASES) -> DataFrame:
    """Select the first present alias of every wanted column under its canonical name."""
    picked = []
    for name, aliases in spec.items():
        found = next((a for a in aliases if a in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}; tried {list(aliases)}")
        picked.append(F.col(f"`{found}`").alias(name))
    return df.select(*picked)


def clean_prices(df: DataFrame, aliases: Mapping[str, Sequence[str]] = PRICE_ALIASES, cutoff: str | None = None) -> DataFrame:
    """Canonical typed prices: trimmed upper tickers, day dates, positive closes, non-negative volume."""
    p = resolve_columns(df, aliases)
    p = p.select(
        norm_ticker("ticker").alias("ticker"),
        F.coalesce(F.col("date").try_cast("date"), F.substring(F.col("date").cast("string"), 1, 10).try_cast("date")).alias("date"),
        F.col("close_price").cast("string").try_cast("double").alias("close_price"),
        F.col("volume").cast("string").try_cast("double").alias("volume"),
    )
    good = (F.col("ticker") != "") & F.col("date").isNotNull() & (F.col("close_price") > 0) & ~F.isnan("close_price")
    p = p.where(good & (F.col("volume") >= 0))
    return p if cutoff is None else p.where(F.col("date") < F.lit(cutoff).cast("date"))


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", aliases=PRICE_ALIASES, cutoff: str | None = None) -> DataFrame:
    """Scan parquet, CSV or JSON prices and clean them."""
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    return clean_prices(reader.format(fmt).load(path), aliases, cutoff)


def read_runs(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv") -> DataFrame:
    """Union of the files of several runs with the run's id; columns may differ per run."""
    out = None
    for run, path in paths.items():
        reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
        df = reader.format(fmt).load(path).withColumn("run_id", F.lit(run))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def union_runs(frames: Mapping[str, DataFrame]) -> DataFrame:
    """The same for frames already loaded."""
    out = None
    for run, df in frames.items():
        df = df.withColumn("run_id", F.lit(run))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


BARS = "struct<status:string,results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>>>"


def explode_bars(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Provider payload ``{"results": [{t,o,h,l,c,v,vw,n}]}`` to typed daily bars."""
    bars = df.select("ticker", F.explode(F.from_json(payload, BARS)["results"]).alias("b")).where(F.col("b.t").isNotNull())
    return bars.select(
        "ticker", epoch_ms_date("b.t").alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"), F.col("b.n").alias("transactions"))


EVENTS = "struct<results:struct<events:array<struct<type:string,date:string,ticker_change:struct<ticker:string>>>>>"


def explode_ticker_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Ticker-change events of ``results.events[]``."""
    e = df.select("entity_id", F.explode(F.from_json(payload, EVENTS)["results"]["events"]).alias("e"))
    e = e.select("entity_id", F.col("e.type").alias("type"), F.col("e.date").alias("date"), norm_ticker("e.ticker_change.ticker").alias("ticker"))
    return e.where((F.col("type") == "ticker_change") & (F.col("ticker") != "") & F.col("date").isNotNull())


def read_columnar_json(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """``{"fields": [...], "data": [[...]]}`` documents to rows, matched by field name."""
    doc = df.withColumn("_d", F.from_json(payload, "struct<fields:array<string>,data:array<array<string>>>"))
    rows = doc.select(F.col("_d.fields").alias("_f"), F.explode("_d.data").alias("_r"))
    pick = lambda f: F.get("_r", (F.array_position("_f", F.lit(f)) - 1).cast("int"))
    return rows.select(*[pick(f).alias(f) for f in fields])


def parse_pipe(lines: DataFrame, columns: Sequence[str], symbol: str) -> DataFrame:
    """Pipe-delimited directory lines to trimmed columns; header, footer and blank symbols are dropped."""
    parts = lines.where(F.col("value").contains("|") & ~F.col("value").startswith("File Creation Time"))
    parts = parts.withColumn("_p", F.split("value", r"\|"))
    rows = parts.select(*[F.trim(F.coalesce(F.get("_p", F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(columns)])
    return rows.where((F.col(symbol) != "") & (F.col(symbol) != symbol))


def read_pipe(spark: SparkSession, path: str, columns: Sequence[str], symbol: str) -> DataFrame:
    return parse_pipe(spark.read.text(path), columns, symbol)


# The columns of the two layouts of listed symbols, and where a common column comes from.
LISTED_COLUMNS = {
    "nasdaqlisted": ("Symbol", "Security Name", "Market Category", "Test Issue", "Financial Status", "Round Lot Size", "ETF", "NextShares"),
    "otherlisted": ("ACT Symbol", "Security Name", "Exchange", "CQS Symbol", "ETF", "Round Lot Size", "Test Issue", "NASDAQ Symbol"),
}
LISTED_EXCHANGE = {"nasdaqlisted": "Q"}


def listed_symbols(lines: DataFrame, layout: str) -> DataFrame:
    """(source, symbol, security_name, exchange, etf, test_issue, financial_status, raw) of a directory
    of listed symbols in either layout; columns that a layout lacks are empty, ``raw`` is the whole
    line as JSON with sorted names."""
    names = LISTED_COLUMNS[layout]
    rows = parse_pipe(lines, names, names[0])
    of = lambda c: F.col(f"`{c}`") if c in names else F.lit("")
    exchange = F.lit(LISTED_EXCHANGE[layout]) if layout in LISTED_EXCHANGE else of("Exchange")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(names)]))
    return rows.select(
        F.lit(layout).alias("source"), F.col(f"`{names[0]}`").alias("symbol"), of("Security Name").alias("security_name"), exchange.alias("exchange"),
        of("ETF").alias("etf"), of("Test Issue").alias("test_issue"), of("Financial Status").alias("financial_status"), raw.alias("raw"))


def flatten_profiles(df: DataFrame, payload: str) -> DataFrame:
    """Sector and industry per ticker from a profile list or a ticker-keyed map, with the
    document's first as-of field."""
    row = "struct<ticker:string,symbol:string,stock_symbol:string,sector:string,sector_name:string,industry:string,industry_name:string>"
    listed = F.from_json(payload, f"struct<profiles:array<{row}>>")["profiles"]
    keyed = F.from_json(F.get_json_object(payload, "$.profiles"), f"map<string,{row}>")
    top = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("as_of", "as_of_date", "generated_at", "snapshot_date")])
    none = F.lit(None).cast("string")
    entries = F.concat(
        F.transform(F.coalesce(listed, F.array().cast(f"array<{row}>")), lambda x: F.struct(none.alias("key"), x.alias("value"))),
        F.coalesce(F.map_entries(keyed), F.array().cast(f"array<struct<key:string,value:{row}>>")))
    e = df.select(F.coalesce(top, F.lit("")).alias("as_of"), F.explode(entries).alias("e"))
    v = "e.value"
    out = e.select(
        F.upper(F.coalesce(f"{v}.ticker", f"{v}.symbol", f"{v}.stock_symbol", "e.key")).alias("ticker"),
        F.trim(F.coalesce(f"{v}.sector", f"{v}.sector_name", F.lit(""))).alias("sector"),
        F.trim(F.coalesce(f"{v}.industry", f"{v}.industry_name", F.lit(""))).alias("industry"), "as_of")
    return out.where(F.col("ticker").isNotNull() & ((F.col("sector") != "") | (F.col("industry") != "")))
