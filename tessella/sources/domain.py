"""Domain tables derived from the test tables.

Each method is a lazy DataFrame; ``plans/domain_sql.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.frames import clip, flag
from tessella.functions.scalars import hash_id
from tessella.operators import features, graph, metrics, portfolio, screens, targets, tracking
from tessella.operators.splits import walk_forward
from tessella.session import file_system, stage, work_dir

HOLDOUT = "2001-01-01"
_STAGED: dict[tuple, DataFrame] = {}


def forget_staged() -> None:
    """Make every later query stage its inputs anew (honest timings)."""
    _STAGED.clear()


def code(c: str):
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 6, "0"))


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._source: tuple | None = None

    def source(self) -> tuple:
        """Names, sizes and times of the source tables: staged tables hold for these only."""
        if self._source is None:
            store, at = file_system(self.spark, self.dir)
            self._source = tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in store.listStatus(at)))
        return self._source

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw_bars(self) -> DataFrame:
        """Duplicate-bearing bars: one per line item."""
        return self.table("lineitem").select(
            code("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"),
            F.try_divide("l_extendedprice", "l_quantity").alias("close_price"), F.col("l_quantity").alias("volume"),
            F.col("l_linenumber").cast("long").alias("transactions"), F.col("l_orderkey").alias("seq"),
            F.col("l_returnflag").alias("returnflag"), F.col("l_extendedprice").alias("amount"))

    def _collapse(self, bars: DataFrame) -> DataFrame:
        return bars.groupBy("ticker", "date").agg(
            (F.sum("amount") / F.sum("volume")).alias("close_price"), F.sum("volume").alias("volume"))

    def prices(self) -> DataFrame:
        return self._collapse(self.raw_bars())

    def prices_alt(self) -> DataFrame:
        """Second source that knows only unreturned items."""
        return self._collapse(self.raw_bars().where(F.col("returnflag") != "R"))

    def cust_prices(self) -> DataFrame:
        """Another source: customers as entities, orders as bars."""
        return self.table("orders").select(
            F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("ticker"),
            F.to_date("o_orderdate").alias("date"), "o_totalprice",
        ).groupBy("ticker", "date").agg(
            F.avg("o_totalprice").alias("close_price"), F.count(F.lit(1)).cast("double").alias("volume"))

    def sectors(self) -> DataFrame:
        """Two half-open sector intervals per entity; the second one is absent for accounts in debt."""
        s = (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        change = F.lit("1998-07-01").cast("date")
        first = F.struct(F.col("r_name").alias("sector"), F.lit("1995-01-01").cast("date").alias("valid_from"), change.alias("valid_to"))
        second = F.struct(F.concat(F.lit("GROUP"), (F.col("n_nationkey") % 5).cast("string")).alias("sector"),
                          change.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        spans = F.when(F.col("s_acctbal") < 0, F.array(first)).otherwise(F.array(first, second))
        return s.select(code("s_suppkey").alias("ticker"), F.explode(spans).alias("iv")).select("ticker", "iv.*")

    def symbols(self) -> DataFrame:
        """Listing symbols with suffixes of every kind and the identifiers of the entity."""
        n = F.col("s_nationkey") % 5
        suffix = F.when(n == 0, ".TO").when(n == 1, "-A").when(n == 2, "-WS").when(n == 3, ".PRB").otherwise("")
        return self.table("supplier").select(
            code("s_suppkey").alias("ticker"),
            F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), suffix, F.lit(" ")).alias("symbol"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_nationkey") % 4 != 0, "CS").otherwise("ETF").alias("security_type"),
            F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("FIGI"), F.col("s_suppkey").cast("string"))).alias("share_class_figi"),
            F.when(F.col("s_acctbal") > 2500, F.concat(F.lit("COMP"), F.col("s_suppkey").cast("string"))).alias("composite_figi"),
            F.when(F.col("s_acctbal") > 0, F.col("s_suppkey").cast("string")).otherwise("").alias("cik"),
            F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("acctbal"))

    def staged(self, name: str) -> DataFrame:
        """A domain table written once per session, run and state of its source, for queries that
        pass over it repeatedly."""
        key = (self.spark.sparkContext.applicationId, work_dir(self.spark), self.dir, self.source(), name)
        if key not in _STAGED:
            _STAGED[key] = stage(getattr(self, name)())
        return _STAGED[key]

    def feats(self) -> DataFrame:
        return features.research_features(self.prices())

    def panel(self) -> DataFrame:
        """Residual features with the five-row target, sealed at the holdout."""
        return self.horizon_panel(5)

    def horizon_panel(self, h: int) -> DataFrame:
        """Residual features with the target ``h`` rows ahead, sealed at the holdout."""
        df = targets.forward_target(features.residual_features(self.prices()), h)
        return targets.seal(targets.scrub(df, [*targets.FEATURES, "future_return"]), HOLDOUT)

    def labelled(self) -> DataFrame:
        """Complete residual panel with sector and leave-one-out targets."""
        return self._residuals()

    def labels(self) -> DataFrame:
        """The rows of :meth:`labelled` without their features, for queries that pass over them once."""
        return self._residuals(["evaluation_date"])

    def _residuals(self, keep: list[str] | None = None) -> DataFrame:
        return targets.residual_panel(self.prices(), self.sectors(), HOLDOUT, 5, 100_000, 1_000_000, 2, keep)

    def splits(self, by: str = "date") -> DataFrame:
        """Five expanding walk-forward windows with an embargo of five dates."""
        return walk_forward(self.staged("panel"), n_splits=5, test_dates=120, embargo=5, min_train=200)

    def scored(self) -> DataFrame:
        """Test rows of two deterministic models in every split."""
        test = self.staged("splits").where(F.col("role") == "test").select("split", "date")
        prob = lambda c: 1 / (1 + F.exp(-4 * clip(c, -7.5, 7.5)))
        both = F.array(
            F.struct(F.lit("slow").alias("model"), prob("ret_20d").alias("probability")),
            F.struct(F.lit("fast").alias("model"), prob("ret_5d").alias("probability")))
        return (
            self.staged("panel").join(test, "date").withColumn("_m", F.explode(both))
            .select("split", "date", "ticker", "evaluation_date", "ret_5d", "ret_20d", "vol_20d",
                    "drawdown_60d", "dollar_vol_20d_log", "future_return", F.col("_m.model").alias("model"),
                    F.col("_m.probability").alias("probability"),
                    flag(F.col("future_return") > 0).alias("label"))
        )

    def predicted(self) -> DataFrame:
        """Predictions of both models for three horizons on every test date, without ranks."""
        k = F.create_map(*[F.lit(x) for x in (5, 1.0, 20, 2.0, 60, 3.0)])
        p = self.staged("scored").withColumn("horizon_days", F.explode(F.array(F.lit(5), F.lit(20), F.lit(60))))
        signal = F.when(F.col("model") == "slow", F.col("ret_20d")).otherwise(F.col("ret_5d"))
        return p.select(
            F.col("split").cast("long").alias("run_id"), F.col("date").alias("as_of_date"), "ticker", F.col("model").alias("model_name"),
            F.col("horizon_days").cast("long").alias("horizon_days"),
            (1 / (1 + F.exp(-4 * clip(signal, -7.5, 7.5) / k[F.col("horizon_days")]))).alias("probability_up"),
            "future_return", "label")

    def preds(self) -> DataFrame:
        """:meth:`predicted`, ranked per date."""
        # nine digits, so that equal probabilities tie whatever the order of the sums behind them
        w = Window.partitionBy("as_of_date", "horizon_days", "model_name").orderBy(F.round("probability_up", 9).desc(), "ticker")
        return self.predicted().withColumn("model_rank", F.row_number().over(w).cast("long"))

    def summary(self) -> DataFrame:
        return screens.price_summary(self.prices())

    def watch(self) -> DataFrame:
        return screens.watchlist(self.staged("summary"), None, 50)

    def decisions(self) -> DataFrame:
        """One decision for every panel row on whose day the entity had returns."""
        returned = self.raw_bars().where(F.col("returnflag") == "R").select("ticker", "date").distinct()
        p = self.staged("panel").join(returned, ["ticker", "date"])
        h = F.element_at(F.array(F.lit(5), F.lit(20), F.lit(60)), F.dayofmonth("date") % 3 + 1)
        prob = 1 / (1 + F.exp(-4 * clip("ret_20d", -7.5, 7.5)))
        d = p.select("ticker", F.col("date").alias("source_date"), F.col("close_price").alias("reference_price"),
                     (F.col("close_price") * 0.92).alias("stop_loss"), (F.col("close_price") * 1.16).alias("target_price"),
                     h.cast("long").alias("horizon_days"), prob.alias("probability_up"))
        d = d.withColumn("action", F.when(F.col("probability_up") >= 0.6, "paper buy candidate").when(F.col("probability_up") >= 0.5, "watch").otherwise("avoid for now"))
        return d.withColumn("decision_id", hash_id(["source_date", "ticker", "action", "horizon_days"], 24))

    def outcomes(self) -> DataFrame:
        return tracking.evaluate_outcomes(self.staged("decisions"), self.prices())

    def evals(self) -> DataFrame:
        """Evaluation row of every run, horizon and model on the predictions."""
        by = ["run_id", "horizon_days", "model_name"]
        days = self.staged("panel").groupBy("date").agg(F.sum(flag(F.col("future_return") > 0)).alias("up"), F.count(F.lit(1)).alias("n"))
        s = self.staged("splits").join(days, "date")
        d = s.groupBy(F.col("split").cast("long").alias("run_id")).agg(
            *[f(F.when(F.col("role") == r, F.col("date"))).alias(f"{o}_{e}") for r, o in (("train", "training"), ("test", "test")) for f, e in ((F.min, "start"), (F.max, "end"))],
            (F.sum(F.when(F.col("role") == "train", F.col("up"))) / F.sum(F.when(F.col("role") == "train", F.col("n")))).alias("train_positive_rate"),
            F.sum(F.when(F.col("role") == "train", F.col("n"))).alias("training_rows"))
        d = stage(d)  # a row per run: the join knows its size and predictions stay where they are
        p = self.predicted().join(d.select("run_id", "train_positive_rate"), "run_id")
        e = metrics.evaluate(p, by, "probability_up", "future_return", "label", "train_positive_rate").join(d, "run_id")
        e = metrics.champion_score(e.withColumns({"fit_status": F.lit("ok"), "embargo_dates": F.lit(5)}))
        e = metrics.wf_blend(e, metrics.walk_forward_summary(e))
        best = Window.partitionBy("run_id", "horizon_days").orderBy(F.desc("champion_score"), "model_name")
        return e.withColumn("is_champion", flag(F.row_number().over(best) == 1).cast("string"))

    def gscored(self) -> DataFrame:
        """Scored rows of both models with their graph columns and a cluster id."""
        c = F.col
        cluster = self.symbols().select("ticker", F.when(c("nation") % 5 == 0, -1).otherwise(c("nation") % 5).alias("cluster"))
        return self.staged("scored").join(cluster, "ticker").join(self.staged("gcols"), ["ticker", "date"]).select(
            "model", "split", "date", "ticker", "probability", "label", c("future_return").alias("forward_return"), "ret_20d", "dollar_vol_20d_log",
            "graph_similarity_mean", "neighbor_confirmation", "graph_degree", "cluster")

    def train_tail(self) -> DataFrame:
        """The last 1,600 dates before 2000."""
        return targets.last_n_dates(self.staged("panel").where(F.col("date") < F.lit("2000-01-01").cast("date")), 1600)

    def knn_edges(self) -> DataFrame:
        return graph.knn_corr_graph(self.train_tail(), 8, 40, degree_at=0.10)[0]

    def gcols(self) -> DataFrame:
        """Graph columns of the panel on test dates, from the training graph; 0 for entities without
        neighbours that day."""
        # every row meets its neighbours' rows of the same date
        test = self.staged("splits").where(F.col("role") == "test").select("date").distinct()
        rows = self.staged("panel").select("ticker", "date", "ret_20d", "vol_20d").join(test, "date", "left_semi")
        p = graph.neighbor_features(rows, self.staged("knn_edges"), ["ret_20d"], "plain")
        p = features.interactions(p).select("ticker", "date", "graph_similarity_mean", "neighbor_confirmation", F.col("graph_degree").cast("double").alias("graph_degree"))
        p = p.fillna(0.0, ["graph_similarity_mean", "neighbor_confirmation", "graph_degree"])
        # nine digits, so that equal means tie whatever the order of their sums
        return p.withColumns({c: F.round(c, 9) for c in ("graph_similarity_mean", "neighbor_confirmation")})

    def ret1d(self) -> DataFrame:
        return portfolio.one_day_residuals(self.prices(), self.staged("panel"))
