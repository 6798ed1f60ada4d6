"""Scans, cleaning, sinks, filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import scalars as sc
from tessella.operators import clean as cl
from tessella.operators import screens as sn
from tessella.operators import splits as sp
from tessella.plans.registry import query
from tessella.session import stage, work_dir
from tessella.sources import readers as rd
from tessella.sources import sinks as sk

W = "OVER (PARTITION BY ticker ORDER BY date)"


@query("A01_clean_prices", "ticker date:d close_price:r volume:r",
       """SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice - 1000 AS close_price, l_quantity AS volume
       FROM lineitem WHERE l_extendedprice - 1000 > 0 AND CAST(l_shipdate AS DATE) < DATE '2001-01-01'""")
def _(t):
    raw = t.table("lineitem").select(
        F.concat(F.lit(" s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(" ")).alias("symbol"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("begins_at"),
        F.when(F.col("l_extendedprice") < 1000, "n/a").otherwise((F.col("l_extendedprice") - 1000).cast("string")).alias("close"),
        F.col("l_quantity").cast("string").alias("vol"))
    return rd.clean_prices(raw, cutoff="2001-01-01")


@query("A02_resolve_columns", "ticker date:d close_price:r volume:r",
       "SELECT l_suppkey AS ticker, l_shipdate AS date, l_extendedprice AS close_price, l_quantity AS volume FROM lineitem")
def _(t):
    l = t.table("lineitem").select(F.col("l_suppkey").alias("Symbol"), F.col("l_shipdate").alias("timestamp"),
                                   F.col("l_extendedprice").alias("Close"), F.col("l_quantity").alias("Volume"), F.lit("x").alias("extra"))
    return rd.resolve_columns(l)


def _dedup_sql(direction):
    return f"""SELECT ticker, date, close_price, volume, seq FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq {direction}, transactions {direction}, close_price {direction}, volume {direction}) AS k FROM raw_bars) WHERE k = 1"""


@query("A03_dedup_last", "ticker date:d close_price:r volume:r seq:i", _dedup_sql("DESC"))
def _(t):
    return cl.dedup(t.raw_bars(), ["ticker", "date"], ["seq", "transactions", "close_price", "volume"])


@query("A03_dedup_first", "ticker date:d close_price:r volume:r seq:i", _dedup_sql("ASC"))
def _(t):
    return cl.dedup(t.raw_bars(), ["ticker", "date"], ["seq", "transactions", "close_price", "volume"], "first")


@query("A04_dedup_best", "ticker date:d transactions:i volume:r seq:i",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY coalesce(transactions, -1) DESC, coalesce(volume, -1) DESC, seq) AS k FROM raw_bars) WHERE k = 1""")
def _(t):
    return cl.dedup_best(t.raw_bars().select("ticker", "date", "transactions", "volume", "seq"), ["ticker", "date"], ["transactions", "volume"], ["seq"])


@query("A05_collapse_daily", "ticker date:d close_price:r volume:r",
       """SELECT ticker, date, max(CASE WHEN k = 1 THEN close_price END) AS close_price, sum(volume) AS volume FROM
       (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC, transactions DESC, close_price DESC) AS k FROM raw_bars) GROUP BY 1, 2""")
def _(t):
    return cl.collapse_daily(t.raw_bars(), ["seq", "transactions"])


@query("A06_explode_bars", "ticker date:d open:r close:r volume:r transactions:i",
       "SELECT ticker, date, close_price AS open, close_price AS close, volume, transactions FROM raw_bars")
def _(t):
    bar = F.struct((F.unix_date("date").cast("long") * 86_400_000 + 3_600_000).alias("t"), F.col("close_price").alias("o"),
                   F.col("close_price").alias("c"), F.col("volume").alias("v"), F.col("transactions").alias("n"))
    docs = t.raw_bars().groupBy("ticker", "date", "seq").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.collect_list(bar).alias("results"))).alias("payload"))
    return rd.explode_bars(docs)


@query("A07_explode_ticker_events", "entity_id date:d ticker",
       """SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(ts AS DATE) AS date, 'U' || CAST(event_id AS VARCHAR) AS ticker FROM events WHERE event_type = 'click'""")
def _(t):
    e = t.table("events")
    change = F.struct(F.when(F.col("event_type") == "click", "ticker_change").otherwise(F.col("event_type")).alias("type"),
                      F.date_format("ts", "yyyy-MM-dd").alias("date"),
                      F.struct(F.concat(F.lit(" u"), F.col("event_id").cast("string")).alias("ticker")).alias("ticker_change"))
    docs = e.groupBy(F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("d")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(change).alias("events")).alias("results"))).alias("payload"))
    return rd.explode_ticker_events(docs).withColumn("date", F.to_date("date"))


@query("A08_columnar_json", "cik name ticker", "SELECT CAST(s_suppkey AS VARCHAR) AS cik, s_name AS name, 'T' || CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier")
def _(t):
    s = t.table("supplier")
    row = F.array(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")), F.col("s_suppkey").cast("string"), F.col("s_name"))
    docs = s.groupBy("s_nationkey").agg(F.to_json(F.struct(
        F.array(F.lit("ticker"), F.lit("cik"), F.lit("name")).alias("fields"), F.collect_list(row).alias("data"))).alias("payload"))
    return rd.read_columnar_json(docs, "payload", ["cik", "name", "ticker"])


@query("A08_pipe_directory", "Symbol Name Market", "SELECT trim(ticker) AS \"Symbol\", name AS \"Name\", security_type AS \"Market\" FROM symbols WHERE acctbal > 0")
def _(t):
    s = t.symbols().select(F.concat_ws("|", F.when(F.col("acctbal") > 0, F.col("ticker")).otherwise(" "), F.concat(F.lit(" "), "name"), "security_type").alias("value"))
    extra = t.table("region").select(F.when(F.col("r_regionkey") == 0, "Symbol|Name|Market").otherwise("File Creation Time: 0101|x").alias("value"))
    return rd.parse_pipe(s.unionByName(extra), ["Symbol", "Name", "Market"], "Symbol")


@query("A09_write_read", "ticker date:d close_price:r volume:r", "SELECT * FROM prices", digits=5)
def _(t):
    path = f"{work_dir(t.spark)}/out-{uuid.uuid4().hex}"
    sk.write(t.prices(), path, "csv")
    return rd.read_prices(t.spark, path, "csv")


@query("A10_upsert", "user_id:i event_type n:i last_id:i",
       """SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2""")
def _(t):
    e = t.table("events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    agg = lambda d: d.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    return sk.upsert(agg(e.where(F.col("ts") < cut)), agg(e), ["user_id", "event_type"])


@query("A11_upsert_coalesce", "ticker as_of_date:d rank:i entry_price:r fwd_return_5d:r",
       """WITH o AS (SELECT ticker, date, min(seq) AS rank, max(close_price) AS entry_price, max(CASE WHEN volume > 25 THEN volume END) AS f FROM raw_bars WHERE returnflag <> 'R' GROUP BY 1, 2),
       n AS (SELECT ticker, date, max(seq) AS rank, min(close_price) AS entry_price, max(CASE WHEN volume > 40 THEN -volume END) AS f FROM raw_bars WHERE returnflag <> 'A' GROUP BY 1, 2)
       SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.date, n.date) AS as_of_date, CASE WHEN n.ticker IS NOT NULL THEN n.rank ELSE o.rank END AS rank,
       coalesce(o.entry_price, n.entry_price) AS entry_price, coalesce(n.f, o.f) AS fwd_return_5d FROM o FULL OUTER JOIN n ON o.ticker = n.ticker AND o.date = n.date""")
def _(t):
    b = t.raw_bars()
    side = lambda d, rank, price, ret: d.groupBy("ticker", F.col("date").alias("as_of_date")).agg(
        rank("seq").alias("rank"), price("close_price").alias("entry_price"), F.max(ret).alias("fwd_return_5d"))
    old = side(b.where("returnflag <> 'R'"), F.min, F.max, F.when(F.col("volume") > 25, F.col("volume")))
    new = side(b.where("returnflag <> 'A'"), F.max, F.min, F.when(F.col("volume") > 40, -F.col("volume")))
    return sk.upsert_coalesce(old, new, ["ticker", "as_of_date"], ["entry_price"], ["fwd_return_5d"])


@query("A12_append_run", "run_id ticker n:i best:r run_created_at",
       """SELECT 'r' || CAST(year(date) AS VARCHAR) AS run_id, ticker, count(*) AS n, NULL AS best, CAST(year(date) AS VARCHAR) || '-12-31' AS run_created_at FROM prices WHERE year(date) >= 1998 AND year(date) <> 2000 GROUP BY ticker, year(date)
       UNION ALL SELECT 'r2000', ticker, count(*), max(close_price), '2000-12-31' FROM prices WHERE year(date) = 2000 GROUP BY ticker""")
def _(t):
    p = t.prices().withColumn("y", F.year("date"))
    base = p.groupBy("ticker", "y").agg(F.count(F.lit(1)).alias("n"))
    base = base.select(F.concat(F.lit("r"), F.col("y").cast("string")).alias("run_id"), "ticker", "n", F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("run_created_at"))
    frame = p.where(F.col("y") == 2000).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("close_price").alias("best"))
    return sk.append_run(base, frame, {"run_id": "r2000", "run_created_at": "2000-12-31"}, 800)


@query("A13_append_ledger", "decision_id event_type user_id:i d:d",
       "SELECT DISTINCT substr(sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)), 1, 24) AS decision_id, event_type, user_id, CAST(ts AS DATE) AS d FROM events")
def _(t):
    e = t.table("events").select("user_id", "event_type", F.to_date("ts").alias("d"))
    ids = ["user_id", "event_type", "d"]
    first = e.where(F.col("d") < F.lit("2024-01-10").cast("date"))
    base = first.withColumn("decision_id", sc.hash_id(ids, 24)).dropDuplicates(["decision_id"])
    return sk.append_ledger(base, e, ids, 24)


@query("A14_union_runs", "run_id ticker n:i top:r",
       "SELECT 'main' AS run_id, ticker, count(*) AS n, NULL AS top FROM prices GROUP BY ticker UNION ALL SELECT 'alt', ticker, count(*), max(close_price) FROM prices_alt GROUP BY ticker")
def _(t):
    a = t.prices().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    b = t.prices_alt().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("close_price").alias("top"))
    return rd.union_runs({"main": a, "alt": b})


@query("A15_ensure_columns", "ticker date:d close_price:r confidence:r note", "SELECT *, 0.5 AS confidence, 'none' AS note FROM prices", digits=5)
def _(t):
    return sk.ensure_columns(t.prices(), {"close_price": 0.0, "confidence": 0.5, "note": "none"})


@query("A16_prune_span", "span ticker date:d",
       """SELECT span, ticker, date FROM (SELECT CASE returnflag WHEN 'A' THEN 'year' WHEN 'N' THEN '3month' ELSE '5year' END AS span, ticker, date FROM raw_bars)
       WHERE date >= DATE '2001-06-30' - CASE span WHEN 'year' THEN 366 WHEN '3month' THEN 93 ELSE 1827 END""")
def _(t):
    span = F.when(F.col("returnflag") == "A", "year").when(F.col("returnflag") == "N", "3month").otherwise("5year")
    return sk.prune_span(t.raw_bars().withColumn("span", span), {"year": 366, "3month": 93, "5year": 1827}, "2001-06-30")


@query("A17_trading_window", "date:d", "SELECT DISTINCT date FROM prices WHERE date <= DATE '1998-06-15' ORDER BY date DESC LIMIT 20")
def _(t):
    return cl.trading_window(t.prices(), "1998-06-15", 20)


@query("A18_load_snapshot", "run_id previous_run_id cik entity_id name",
       """SELECT '2001-02' AS run_id, '2001-01' AS previous_run_id, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'SEC-CIK-' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS entity_id, max(o_orderpriority) AS name
       FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '2001-02' GROUP BY o_custkey""")
def _(t):
    o = t.table("orders").withColumn("observation_date", F.date_format("o_orderdate", "yyyy-MM"))
    runs = o.where(F.col("observation_date") < "2001-02").select("observation_date").distinct()
    new = o.where(F.col("observation_date") == "2001-02").groupBy(F.col("o_custkey").alias("cik")).agg(F.max("o_orderpriority").alias("name"))
    return sk.load_snapshot(runs, new, "2001-02")


@query("A18_listed_symbols", "source symbol security_name exchange etf test_issue financial_status", """
SELECT 'nasdaqlisted' AS source, 'S' || s_suppkey AS symbol, s_name AS security_name, 'Q' AS exchange,
    CASE WHEN s_nationkey % 4 = 0 THEN 'Y' ELSE 'N' END AS etf, CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS test_issue, 'D' AS financial_status
FROM supplier
WHERE s_nationkey % 2 = 0
UNION ALL
SELECT 'otherlisted', 'S' || s_suppkey, s_name, CASE WHEN s_nationkey % 3 = 0 THEN 'N' ELSE 'A' END,
    CASE WHEN s_nationkey % 5 = 0 THEN 'Y' ELSE 'N' END, CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END, ''
FROM supplier
WHERE s_nationkey % 2 = 1""")
def _(t):
    s = t.table("supplier")
    flag_of = lambda c: F.when(c, "Y").otherwise("N")
    nation, symbol, test = F.col("s_nationkey"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), flag_of(F.col("s_acctbal") < 0)

    def lines(rows, layout, cells):
        body = rows.select(F.concat_ws("|", *cells).alias("value"))
        ends = [("|".join(rd.LISTED_COLUMNS[layout]),), ("File Creation Time: 0101200121:30|||||||",)]
        return rd.listed_symbols(body.unionByName(t.spark.createDataFrame(ends, "value string")), layout)

    n = lines(s.where(nation % 2 == 0), "nasdaqlisted", [symbol, F.concat(F.lit(" "), "s_name"), F.lit("G"), test, F.lit("D"), F.lit("100"), flag_of(nation % 4 == 0), F.lit("N")])
    o = lines(s.where(nation % 2 == 1), "otherlisted", [symbol, "s_name", F.when(nation % 3 == 0, "N").otherwise("A"), symbol, flag_of(nation % 5 == 0), F.lit("100"), test, symbol])
    return n.unionByName(o)


@query("A19_clean_pairs", "A B similarity:r winner",
       """WITH p AS (SELECT 'S' || l_suppkey AS "A", 'S' || (l_partkey % 100) AS "B", l_discount AS similarity, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS seq, l_shipdate AS sd FROM lineitem)
       SELECT * FROM (SELECT "A", "B", similarity, "A" AS winner, row_number() OVER (PARTITION BY "A", "B" ORDER BY seq, similarity) AS k FROM p WHERE "A" <> "B") WHERE k = 1""")
def _(t):
    p = t.table("lineitem").select(
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("A"), F.concat(F.lit("s"), (F.col("l_partkey") % 100).cast("string"), F.lit(" ")).alias("B"),
        F.col("l_discount").alias("similarity"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("winner"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return cl.clean_pairs(p)


@query("A19_clean_families", "Family ticker variant_family_size:i variant_is_chosen:i",
       """SELECT nation AS "Family", upper(trim(symbol)) AS ticker, count(*) OVER (PARTITION BY nation) AS variant_family_size, CASE WHEN acctbal > 5000 THEN 1 ELSE 0 END AS variant_is_chosen FROM symbols""")
def _(t):
    return cl.clean_families(t.symbols().select(F.col("nation").alias("Family"), F.col("symbol").alias("Member"),
                                                F.when(F.col("acctbal") > 5000, "Yes").otherwise("no").alias("Chosen")))


RULES = sn.ScreenRules(min_price=30.0, min_volume=20.0, min_dollar_volume=60_000.0, max_std=12.0, min_trades_per_minute=0.000215)


@query("B04_screen", "ticker price:r bars:i avg_volume:r avg_dollar_volume:r return_std:r reason",
       """SELECT *, CASE WHEN bars = 0 THEN 'No history' WHEN price < 30 THEN 'Price < $30' WHEN NOT (bars >= 3 AND avg_volume >= 20 AND avg_dollar_volume >= 60000) THEN 'Liquidity fail'
       WHEN avg_volume / 300.0 / 390.0 < 0.000215 THEN 'Trade frequency fail' WHEN coalesce(return_std > 12, true) THEN 'Volatility fail' END AS reason
       FROM (SELECT ticker, price, coalesce(bars, 0) AS bars, avg_volume, avg_dollar_volume, return_std
             FROM (SELECT ticker FROM symbols UNION SELECT 'without bars') LEFT JOIN
                  (SELECT ticker, arg_max(close_price, date) AS price, count(*) AS bars, avg(volume) AS avg_volume,
                          avg(close_price * volume) AS avg_dollar_volume, stddev_samp(ret_1d) AS return_std FROM rets GROUP BY ticker) USING (ticker))""", digits=4)
def _(t):
    listed = t.symbols().select("ticker").unionByName(t.symbols().select(F.lit("without bars").alias("ticker")))
    return sn.screen(t.prices(), RULES, listed)


@query("B05_momentum_ok", "ticker one_year_return:r momentum_ok:i",
       f"""SELECT ticker, r AS one_year_return, CASE WHEN r >= 0.05 THEN 1 ELSE 0 END AS momentum_ok FROM
       (SELECT ticker, close_price / nullif(lag(close_price, 251) {W}, 0) - 1 AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM prices) WHERE k = 1""")
def _(t):
    return sn.momentum_ok(t.prices())


ENRICHED_SQL = """WITH liq AS (SELECT ticker, avg(volume) AS avg_volume, avg(close_price * volume) AS avg_dollar_vol, count(volume) AS days FROM prices WHERE date >= (SELECT max(date) FROM prices) - 120 GROUP BY ticker)
       SELECT s.*, r.ret_60d, l.avg_volume, l.avg_dollar_vol, l.days FROM summary s LEFT JOIN (SELECT ticker, arg_max(ret_60d, date) AS ret_60d FROM rolled GROUP BY ticker) r USING (ticker) LEFT JOIN liq l USING (ticker)"""


def enriched(t):
    from tessella.operators.joins import enrich, latest_rows

    last = latest_rows(t.feats().select("ticker", "date", "ret_60d"), ["ticker"], ["date"]).select("ticker", "ret_60d")
    return enrich(t.summary(), (last, ["ticker"]), (sn.liquidity(t.prices(), 120), ["ticker"]))


@query("B06_shortlist", "ticker trend_slope_60d:r ret_60d:r avg_volume:r avg_dollar_vol:r days:i",
       f"""SELECT * FROM ({ENRICHED_SQL}) WHERE days >= 20 AND avg_volume >= 10 AND avg_dollar_vol >= 10000 AND trend_slope_60d > 0 AND vol_60d <= 12 ORDER BY trend_slope_60d DESC, ret_60d DESC, avg_dollar_vol DESC, ticker LIMIT 25""", digits=4)
def _(t):
    return sn.shortlist(enriched(t), 25, 20, 10.0, 10_000.0, 12.0)


@query("B07_opportunity_map", "ticker leader_score:r trend_score:r vol_60d:r dollar_vol_20d:r",
       "SELECT * FROM summary WHERE trend_score IS NOT NULL AND vol_60d IS NOT NULL AND dollar_vol_20d IS NOT NULL ORDER BY leader_score DESC, ticker LIMIT 40", digits=4)
def _(t):
    return sn.opportunity_map(t.summary(), 40)


@query("B08_warrant_or_unit", "ticker symbol", "SELECT ticker, trim(symbol) AS symbol FROM symbols WHERE regexp_matches(upper(trim(symbol)), '(-WS|-WT|-W|-U|\\.WS|\\.WT|\\.U|/WS|/WT|/U)$')")
def _(t):
    s = t.symbols().withColumn("symbol", F.trim("symbol"))
    return s.where(sc.is_warrant_or_unit("symbol"))


@query("B09_flag_in", "ticker date:d is_member:i",
       "SELECT ticker, date, CASE WHEN ticker IN (SELECT ticker FROM watch) THEN 1 ELSE 0 END AS is_member FROM prices")
def _(t):
    from tessella.operators.joins import flag_in

    return flag_in(t.prices(), t.watch())


@query("B10_latest_context", "run_id:i ticker as_of_date:d probability_up:r",
       "SELECT * FROM preds WHERE as_of_date = (SELECT max(as_of_date) FROM preds) AND run_id = (SELECT max(run_id) FROM preds) ")
def _(t):
    return cl.latest_context(t.staged("preds").withColumn("model_as_of_date", F.lit(None).cast("string")), ["model_as_of_date", "as_of_date"])


@query("B11_probe_dates", "date:d",
       """WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prices))
       SELECT date FROM d WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 16.0, 0) AS BIGINT) FROM (SELECT max(n) AS n FROM d), (SELECT unnest(range(0, 17)) AS k))""")
def _(t):
    return cl.probe_dates(t.prices(), 17)


CHAMPS = """champs AS (SELECT horizon_days, model_name FROM (SELECT horizon_days, model_name, row_number() OVER (PARTITION BY horizon_days ORDER BY avg((probability_up - label) * (probability_up - label)), model_name) AS k
       FROM preds GROUP BY 1, 2) WHERE k = 1)"""


def champions(t):
    from tessella.functions.ranking import first_rows

    e = t.predicted().groupBy("horizon_days", "model_name").agg(F.avg(F.pow(F.col("probability_up") - F.col("label"), 2)).alias("brier"))
    return stage(first_rows(e, ["horizon_days"], [F.col("brier"), F.col("model_name")], 1))


@query("B12_filter_champions", "as_of_date:d ticker horizon_days:i model_name probability_up:r",
       f"WITH {CHAMPS} SELECT p.* FROM preds p JOIN champs USING (horizon_days, model_name)")
def _(t):
    return cl.filter_champions(t.predicted(), champions(t))


@query("B12_flag_champions", "as_of_date:d ticker horizon_days:i model_name model_rank:i is_champion:i",
       f"""WITH {CHAMPS} SELECT p.*, CASE WHEN c.model_name IS NOT NULL THEN 1 ELSE 0 END AS is_champion FROM (SELECT *, row_number() OVER (PARTITION BY horizon_days, model_name ORDER BY model_rank, ticker, as_of_date) AS k FROM preds) p
       LEFT JOIN champs c ON c.horizon_days = p.horizon_days AND c.model_name = p.model_name WHERE k <= 25""")
def _(t):
    return cl.flag_champions(t.staged("preds"), champions(t), 25)


@query("B13_select_universe", "ticker observations:i median_dollar_volume:r",
       """WITH d AS (SELECT DISTINCT date FROM prices), o AS (SELECT ticker, count(*) AS observations FROM prices GROUP BY ticker),
       l AS (SELECT ticker, median(close_price * volume) AS median_dollar_volume FROM prices WHERE date >= (SELECT min(date) FROM (SELECT date FROM d ORDER BY date DESC LIMIT 60)) GROUP BY ticker)
       SELECT * FROM o JOIN l USING (ticker) WHERE observations >= greatest(180, floor((SELECT count(*) FROM d) * 0.2)) ORDER BY median_dollar_volume DESC, ticker LIMIT 60""", digits=3)
def _(t):
    return cl.select_universe(t.prices(), 60, 180, 0.2)


@query("B14_covered_dates", "date:d members:i coverage:r",
       """SELECT * FROM (SELECT date, count(*) AS members, count(*) / (SELECT count(DISTINCT ticker) FROM prices)::DOUBLE AS coverage, row_number() OVER (ORDER BY date) AS i FROM prices GROUP BY date)
       WHERE i > 80 AND coverage >= 0.25 ORDER BY date DESC LIMIT 100""")
def _(t):
    return cl.covered_dates(t.prices(), 0.25, 100, 80)


@query("B15_health_like", "metric value:i",
       "SELECT * FROM (SELECT 'price_rows' AS metric, count(*) AS value FROM prices UNION ALL SELECT 'price_dates', count(DISTINCT date) FROM prices UNION ALL SELECT 'alt_rows', count(*) FROM prices_alt) WHERE metric LIKE '%\\_rows' ESCAPE '\\'")
def _(t):
    p = t.prices().agg(F.count(F.lit(1)).alias("price_rows"), F.countDistinct("date").alias("price_dates"))
    a = t.prices_alt().agg(F.count(F.lit(1)).alias("alt_rows"))
    stacked = p.select(F.expr("stack(2, 'price_rows', price_rows, 'price_dates', price_dates) AS (metric, value)")).unionByName(
        a.select(F.lit("alt_rows").alias("metric"), F.col("alt_rows").alias("value")))
    return cl.health_like(stacked, r"%\_rows")


@query("I01_norm_ticker", "ticker norm", "SELECT ticker, upper(trim(coalesce(symbol, ''))) AS norm FROM symbols")
def _(t):
    return t.symbols().withColumn("norm", sc.norm_ticker("symbol"))


@query("I02_canonical_base", "ticker base",
       r"""SELECT ticker, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(symbol)), '(\.TO|\.V)$', ''), '\.[A-Z]$', ''), '-[A-Z]$', ''), '(\.PR[A-Z]|-PR[A-Z]|\.P[A-Z]|-P[A-Z])$', ''), '[-./]', '', 'g') AS base FROM symbols""")
def _(t):
    return t.symbols().withColumn("base", sc.canonical_base("symbol"))


@query("I03_hash_id", "ticker date:d id", "SELECT ticker, date, substr(sha256(ticker || '|' || CAST(date AS VARCHAR)), 1, 20) AS id FROM prices")
def _(t):
    return t.prices().withColumn("id", sc.hash_id(["ticker", "date"], 20))


@query("I04_hash_coord", "ticker y:r z:r",
       "SELECT ticker, (CAST('0x' || substr(sha256(ticker), 1, 8) AS BIGINT) / 4294967296.0 - 0.5) * 2.2 AS y, (CAST('0x' || substr(sha256(ticker), 9, 8) AS BIGINT) / 4294967296.0 - 0.5) * 2.2 AS z FROM symbols")
def _(t):
    return t.symbols().withColumns({"y": sc.hash_coord("ticker", 0), "z": sc.hash_coord("ticker", 1)})


@query("I05_describe_probability", "ticker as_of_date:d words",
       """SELECT ticker, as_of_date, CASE WHEN probability_up >= 0.7 THEN 'strong bullish research signal' WHEN probability_up >= 0.6 THEN 'bullish research signal' WHEN probability_up >= 0.55 THEN 'modest bullish lean'
       WHEN probability_up <= 0.4 THEN 'bearish/avoid signal' ELSE 'neutral / watch only' END AS words FROM preds""")
def _(t):
    return t.preds().withColumn("words", sc.describe_probability("probability_up"))


@query("I06_squash", "ticker date:d clipped:r sig:r lg:r sgn:i l1p:r",
       """SELECT ticker, date, greatest(-0.5, least(0.5, ret_20d)) AS clipped, 1 / (1 + exp(-greatest(-30, least(30, ret_20d)))) AS sig,
       ln(p / (1 - p)) AS lg, sign(ret_20d) AS sgn, ln(1 + sqrt(volume)) AS l1p FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, abs(drawdown_60d))) AS p FROM panel)""")
def _(t):
    from tessella.functions.frames import clip

    return t.panel().withColumns({
        "clipped": clip("ret_20d", -0.5, 0.5), "sig": sc.sigmoid("ret_20d"), "lg": sc.logit(F.abs("drawdown_60d")),
        "sgn": F.signum("ret_20d"), "l1p": F.log1p(F.sqrt("volume"))})


@query("I06_winsorize", "ticker date:d w:r",
       """WITH b AS (SELECT quantile_cont(ret_20d, 0.01) AS lo, quantile_cont(ret_20d, 0.99) AS hi FROM panel WHERE date < DATE '1999-01-01') SELECT ticker, date, greatest(lo, least(hi, ret_20d)) AS w FROM panel, b""")
def _(t):
    from tessella.operators.models import winsorize

    p = t.staged("panel")
    return winsorize(p, p.where(F.col("date") < F.lit("1999-01-01").cast("date")), "ret_20d", "w")


@query("I07_dates", "ticker date:d week:d month:d days:i ms_date:d iso:i",
       """SELECT ticker, date, date_trunc('week', date) AS week, date_trunc('month', date) AS month, date_diff('day', DATE '1995-01-01', date) AS days, date AS ms_date,
       CASE WHEN day(date) > 12 THEN 0 ELSE 1 END AS iso FROM prices""")
def _(t):
    odd = F.when(F.dayofmonth("date") > 12, F.date_format("date", "yyyy-dd-MM")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    return t.prices().withColumns({
        "week": sc.week_start("date"), "month": F.trunc("date", "month"), "days": F.datediff("date", F.lit("1995-01-01").cast("date")),
        "ms_date": sc.epoch_ms_date(F.unix_date("date").cast("long") * 86_400_000 + 5), "iso": F.when(sc.is_iso_date(odd), 1).otherwise(0)})


@query("I08_coalesce_dates", "ticker date:d found:d",
       "SELECT ticker, date, CASE WHEN returnflag = 'A' THEN date WHEN returnflag = 'N' THEN date + 1 ELSE NULL END AS found FROM raw_bars")
def _(t):
    b = t.raw_bars().withColumns({
        "d1": F.when(F.col("returnflag") == "A", F.col("date").cast("string")).otherwise("unknown"),
        "d2": F.when(F.col("returnflag") == "N", F.date_add("date", 1).cast("string"))})
    return b.withColumn("found", sc.coalesce_dates(["d1", "d2"]))


@query("I09_truthy", "ticker date:d seq:i t:i", "SELECT ticker, date, seq, CASE WHEN returnflag <> 'R' THEN 1 ELSE 0 END AS t FROM raw_bars")
def _(t):
    words = F.when(F.col("returnflag") == "A", "True").when(F.col("returnflag") == "N", "YES").otherwise("0")
    return t.raw_bars().withColumn("t", sc.truthy(words))


_DRIVERS = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "drawdown_60d")


def _driver_sql(name, sign, order):
    each = " UNION ALL ".join(f"SELECT ticker, date, {k} AS k, '{c}' AS name, {c} AS v FROM panel" for k, c in enumerate(_DRIVERS))
    return f"""{name} AS (SELECT ticker, date, string_agg(printf('%s (%+.2f)', name, v), '; ' ORDER BY r) AS text
       FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY v {order}, k) AS r FROM ({each}) WHERE v {sign} 0) WHERE r <= 3 GROUP BY 1, 2)"""


@query("I10_driver_text", "ticker date:d up down",
       f"""WITH {_driver_sql('pos', '>', 'DESC')}, {_driver_sql('neg', '<', 'ASC')}
       SELECT p.ticker, p.date, coalesce(pos.text, '') AS up, coalesce(neg.text, '') AS down
       FROM panel p LEFT JOIN pos ON pos.ticker = p.ticker AND pos.date = p.date LEFT JOIN neg ON neg.ticker = p.ticker AND neg.date = p.date""")
def _(t):
    arr = F.array(*[F.struct(F.col(c).alias("value"), F.lit(c).alias("name")) for c in _DRIVERS])
    return t.panel().withColumns({"up": sc.driver_text(arr), "down": sc.driver_text(arr, False)})


@query("I11_parse_holdings", "date:d ticker quantity:r",
       "SELECT date, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ticker, sum(l_quantity) AS quantity FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, l_quantity FROM lineitem) GROUP BY 1, 2")
def _(t):
    line = F.concat(F.lit("  "), F.lower("ticker"), F.lit(", "), F.col("volume").cast("string"))
    docs = t.raw_bars().groupBy("date", "returnflag").agg(F.concat(F.lit("# holdings\n\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    out = sc.parse_holdings(docs, "text", ["date", "returnflag"])
    return out.groupBy("date", "ticker").agg(F.sum("quantity").alias("quantity"))


@query("I12_entity_key", "ticker entity",
       "SELECT ticker, coalesce(share_class_figi, composite_figi, CASE WHEN cik <> '' THEN 'CIK:' || cik END, 'TICKER:' || ticker) AS entity FROM symbols")
def _(t):
    return t.symbols().withColumn("entity", sc.entity_key("share_class_figi", "composite_figi", "cik", "ticker"))


@query("I13_flatten_profiles", "ticker sector industry as_of",
       """SELECT upper(trim(symbol)) AS ticker, security_type AS sector, CASE WHEN acctbal < 0 THEN '' ELSE 'IND' || CAST(nation AS VARCHAR) END AS industry, '2001-01-0' || CASE WHEN nation % 2 = 0 THEN '1' ELSE '2' END AS as_of FROM symbols""")
def _(t):
    s = t.symbols().withColumns({"sym": F.trim("symbol"), "ind": F.when(F.col("acctbal") < 0, "").otherwise(F.concat(F.lit("IND"), F.col("nation").cast("string")))})
    row = F.struct(F.col("sym").alias("symbol"), F.col("security_type").alias("sector"), F.col("ind").alias("industry"))
    listed = s.where("nation % 2 = 0").groupBy("nation").agg(F.to_json(F.struct(F.lit("2001-01-01").alias("as_of"), F.collect_list(row).alias("profiles"))).alias("payload"))
    body = F.struct(F.col("security_type").alias("sector_name"), F.col("ind").alias("industry"))
    keyed = s.where("nation % 2 = 1").groupBy("nation").agg(F.to_json(F.struct(
        F.lit("2001-01-02").alias("generated_at"), F.map_from_entries(F.collect_list(F.struct("sym", body))).alias("profiles"))).alias("payload"))
    return rd.flatten_profiles(listed.unionByName(keyed), "payload")
