"""Similarity, graphs and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import features as ft
from tessella.operators import graph as gr
from tessella.operators import screens
from tessella.operators import sets as st
from tessella.operators import temporal as tp
from tessella.plans.registry import query
from tessella.session import stage

W = "OVER (PARTITION BY ticker ORDER BY date)"

# Pair sums of integer signs: the same exact arithmetic on both sides.
DIR_SQL = """dirs AS (SELECT ticker, date, sign(ret_1d) AS dir FROM rets WHERE ret_1d IS NOT NULL AND date >= (SELECT max(date) FROM prices) - 1008),
       ps AS (SELECT a.ticker AS a, b.ticker AS b, count(*)::DOUBLE AS n, sum(a.dir)::DOUBLE AS sx, sum(b.dir)::DOUBLE AS sy, sum(a.dir * a.dir)::DOUBLE AS sxx, sum(b.dir * b.dir)::DOUBLE AS syy, sum(a.dir * b.dir)::DOUBLE AS sxy FROM dirs a JOIN dirs b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2),
       fc AS (SELECT a, b, n, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS c FROM ps),
       fl AS (SELECT a AS "A", b AS "B", n, c AS similarity FROM fc WHERE n >= 60 AND c >= 0.10 AND c < 0.88)"""


def flips(t):
    return gr.flip_corr(t.prices(), 1008, 60, 0.10, 0.88)


@query("G01_flip_corr", "A B n:i similarity:r", f"WITH {DIR_SQL} SELECT * FROM fl")
def _(t):
    return flips(t)


def snap(t):
    return stage(screens.newest_features(t.prices(), ["trend_slope_60d", "ret_60d", "vol_60d", "dollar_vol_20d"]))


PAIRS_SQL = DIR_SQL + """, bi AS (SELECT "A" AS ticker, "B" AS neighbor, similarity FROM fl UNION ALL SELECT "B", "A", similarity FROM fl), tk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, neighbor) AS k FROM bi QUALIFY k <= 3),
       up AS (SELECT least(ticker, neighbor) AS "A", greatest(ticker, neighbor) AS "B", max(similarity) AS similarity FROM tk GROUP BY 1, 2), sn AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
       pairs AS (SELECT up.*, x.trend_slope_60d AS a1, y.trend_slope_60d AS b1, x.ret_60d AS a2, y.ret_60d AS b2, x.dollar_vol_20d AS a3, y.dollar_vol_20d AS b3, x.vol_60d AS a4, y.vol_60d AS b4,
       CASE WHEN a1 <> b1 THEN CASE WHEN a1 > b1 THEN "A" ELSE "B" END WHEN a2 <> b2 THEN CASE WHEN a2 > b2 THEN "A" ELSE "B" END WHEN a3 <> b3 THEN CASE WHEN a3 > b3 THEN "A" ELSE "B" END WHEN a4 <> b4 THEN CASE WHEN a4 < b4 THEN "A" ELSE "B" END ELSE "A" END AS winner
       FROM up LEFT JOIN sn x ON x.ticker = "A" LEFT JOIN sn y ON y.ticker = "B")"""


def pairs(t):
    return gr.build_pairs(gr.flip_neighbors(t.prices(), 3, 1008, 60, 0.10, 0.88), snap(t))


@query("G02_build_pairs", "A B similarity:r A_slope:r B_slope:r winner", f"WITH {PAIRS_SQL} SELECT *, a1 AS \"A_slope\", b1 AS \"B_slope\" FROM pairs", digits=4)
def _(t):
    return pairs(t)


@query("G02_winners", "ticker", f"WITH {PAIRS_SQL} SELECT DISTINCT winner AS ticker FROM pairs")
def _(t):
    return gr.winners(pairs(t))


@query("H03_pair_view", "ticker neighbor similarity:r ticker_slope:r neighbor_slope:r winner",
       f"WITH {PAIRS_SQL} SELECT \"A\" AS ticker, \"B\" AS neighbor, similarity, a1 AS ticker_slope, b1 AS neighbor_slope, winner FROM pairs UNION ALL SELECT \"B\", \"A\", similarity, b1, a1, winner FROM pairs", digits=4)
def _(t):
    return st.pair_view(pairs(t), sided=("slope",))


@query("G12_neighbor_map", "ticker neighbor similarity:r rank:i", f"WITH {DIR_SQL}, bi AS (SELECT \"A\" AS ticker, \"B\" AS neighbor, similarity FROM fl UNION ALL SELECT \"B\", \"A\", similarity FROM fl) SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, neighbor) AS rank FROM bi QUALIFY rank <= 8")
def _(t):
    return gr.neighbor_map(gr.flip_neighbors(t.prices(), 8, 1008, 60, 0.10, 0.88))


TRAIN_SQL = "tr AS (SELECT * FROM panel WHERE date < DATE '2000-01-01' AND date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM panel WHERE date < DATE '2000-01-01' ORDER BY date DESC LIMIT 1600)))"
KNN_SQL = TRAIN_SQL + """, pc AS (SELECT a.ticker, b.ticker AS neighbor, CASE WHEN count(*) >= 40 THEN corr(a.ret_1d, b.ret_1d) END AS similarity FROM tr a JOIN tr b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2),
       kn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, neighbor) AS place FROM pc WHERE similarity > 0 QUALIFY place <= 8), edges AS (SELECT *, similarity / sum(similarity) OVER (PARTITION BY ticker) AS weight FROM kn)"""


def edges(t):
    return gr.knn_corr_graph(t.train_tail(), 8, 40, degree_at=0.10)


@query("G03_knn_corr_graph", "ticker neighbor similarity:r place:i weight:r", f"WITH {KNN_SQL} SELECT * FROM edges", digits=5)
def _(t):
    return edges(t)[0]


@query("G03_knn_standardized", "ticker neighbor similarity:r place:i",
       f"""WITH {TRAIN_SQL}, z AS (SELECT ticker, date, (ret_1d - avg(ret_1d) OVER t) / CASE WHEN stddev_pop(ret_1d) OVER t < 1e-12 THEN 1 ELSE stddev_pop(ret_1d) OVER t END AS z FROM tr WINDOW t AS (PARTITION BY ticker) QUALIFY count(*) OVER t >= 40),
       pc AS (SELECT a.ticker, b.ticker AS neighbor, sum(a.z * b.z) / count(*) AS similarity FROM z a JOIN z b ON a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2 HAVING count(*) >= 40)
       SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, neighbor) AS place FROM pc WHERE similarity > 0 QUALIFY place <= 8""", digits=5)
def _(t):
    return gr.knn_corr_graph(t.train_tail(), 8, 40, "standardized")[0]


# The graph of every one of the last 40 dates, each window correlated anew.
FRAMES, LOOKBACK, LEAST = 40, 504, 20
TEMPORAL_SQL = f"""dy AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel)),
fr AS (SELECT date, i FROM dy ORDER BY i DESC LIMIT {FRAMES}),
pt AS (SELECT ticker, dy.i, ret_1d, ret_20d FROM panel JOIN dy USING (date)),
wc AS (
    SELECT fr.i, a.ticker, b.ticker AS neighbor, count(*) AS n,
        CASE WHEN stddev_pop(a.ret_1d) > 0 AND stddev_pop(b.ret_1d) > 0 THEN corr(a.ret_1d, b.ret_1d) END AS c
    FROM fr JOIN pt a ON a.i > fr.i - {LOOKBACK} AND a.i <= fr.i
        JOIN pt b ON b.i = a.i AND a.ticker <> b.ticker
    WHERE a.ret_1d IS NOT NULL AND b.ret_1d IS NOT NULL
    GROUP BY 1, 2, 3),
ps AS (SELECT * FROM wc WHERE n >= {LEAST} AND c > 0),
dg AS (SELECT i, ticker, count(*) AS degree FROM ps WHERE c >= 0.15 GROUP BY 1, 2),
bk AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY i, ticker ORDER BY c DESC, neighbor) <= 8),
nb AS (
    SELECT bk.i, bk.ticker, avg(c) AS s, sum(c * ret_20d) / sum(c) AS r
    FROM bk JOIN pt ON pt.i = bk.i AND pt.ticker = bk.neighbor
    WHERE ret_20d IS NOT NULL
    GROUP BY 1, 2),
tg AS (
    SELECT p.*, coalesce(degree, 0) AS graph_degree, coalesce(s, 0) AS graph_similarity_mean, r AS neighbor_ret_20d, r - p.ret_20d AS neighbor_divergence
    FROM panel p JOIN fr USING (date) LEFT JOIN dg ON dg.i = fr.i AND dg.ticker = p.ticker LEFT JOIN nb ON nb.i = fr.i AND nb.ticker = p.ticker)"""


def temporal(t):
    from tessella.operators.targets import last_n_dates

    p = t.staged("panel")
    frames = last_n_dates(p.select("date"), FRAMES).distinct()
    return tp.temporal_graph(p, frames, LOOKBACK, 8, LEAST, degree_at=0.15)


@query("G03_temporal_graph", "ticker date:d graph_degree:i graph_similarity_mean:r neighbor_ret_20d:r neighbor_divergence:r",
       f"WITH {TEMPORAL_SQL} SELECT * FROM tg", digits=5)
def _(t):
    return temporal(t)


LATENT_COLS = ("ret_5d", "ret_20d", "ret_60d", "vol_20d", "vol_60d", "drawdown_60d", "dollar_vol_20d_log",
               "graph_degree", "graph_similarity_mean", "neighbor_ret_20d", "neighbor_divergence")


def latent(t):
    axes, found = tp.latent_axes(stage(temporal(t)), LATENT_COLS)
    return stage(axes), found


# Robust columns, their covariance, and its axes by squaring the matrix until one direction is left;
# the next axis comes from the matrix without the ones before.
def _power_sql(name, source, squarings=14):
    return f"""{name}_p AS (
    SELECT 0 AS step, i, j, v / (SELECT sum(v) FROM {source} WHERE i = j) AS v FROM {source}
    UNION ALL
    SELECT step, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v
    FROM (
        SELECT a.step + 1 AS step, a.i, b.j, sum(a.v * b.v) AS v
        FROM {name}_p a JOIN {name}_p b ON a.j = b.i
        WHERE a.step < {squarings}
        GROUP BY 1, 2, 3)),
{name}_c AS (SELECT i, v FROM {name}_p WHERE step = {squarings} AND j = (SELECT j FROM {name}_p WHERE step = {squarings} AND i = j ORDER BY v DESC LIMIT 1)),
{name}_n AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {name}_c),
{name} AS (SELECT i, CASE WHEN arg_max(v, abs(v)) OVER () < 0 THEN -v ELSE v END AS v FROM {name}_n),
{name}_l AS (SELECT sum(s.v * a.v * b.v) AS l FROM {source} s JOIN {name} a ON a.i = s.i JOIN {name} b ON b.i = s.j),
{name}_d AS (SELECT s.i, s.j, s.v - l * a.v * b.v AS v FROM {source} s JOIN {name} a ON a.i = s.i JOIN {name} b ON b.i = s.j, {name}_l)"""


_LONG = " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS m, CAST({c} AS DOUBLE) AS v FROM tg" for c in LATENT_COLS)
LATENT_SQL = f"""{TEMPORAL_SQL},
lg AS ({_LONG}),
md AS (SELECT date, m, median(v) AS med, stddev_samp(v) AS sd FROM lg GROUP BY 1, 2),
ma AS (SELECT date, m, any_value(med) AS med, any_value(sd) AS sd, 1.4826 * median(abs(v - med)) AS mad FROM lg JOIN md USING (date, m) WHERE v IS NOT NULL GROUP BY 1, 2),
zs AS (
    SELECT ticker, date, m AS i,
        CASE WHEN v IS NOT NULL AND sc IS NOT NULL THEN greatest(-4, least(4, (v - med) / sc)) ELSE 0 END AS z
    FROM (SELECT *, CASE WHEN mad >= 1e-9 THEN mad WHEN sd >= 1e-9 THEN sd END AS sc FROM lg LEFT JOIN ma USING (date, m))),
mu AS (SELECT i, avg(z) AS mu FROM zs GROUP BY 1),
zc AS (SELECT ticker, date, i, z - mu AS z FROM zs JOIN mu USING (i)),
cv AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM zc a JOIN zc b USING (ticker, date) GROUP BY 1, 2),
{_power_sql("ax", "cv")},
{_power_sql("ay", "ax_d")},
{_power_sql("az", "ay_d")},
la AS (
    SELECT ticker, date, sum(z * ax.v) AS latent_x, sum(z * ay.v) AS latent_y, sum(z * az.v) AS latent_z
    FROM zc JOIN ax USING (i) JOIN ay USING (i) JOIN az USING (i)
    GROUP BY 1, 2)"""


@query("G13_latent_axes", "ticker date:d latent_x:r latent_y:r latent_z:r", f"WITH RECURSIVE {LATENT_SQL} SELECT * FROM la", digits=4)
def _(t):
    return latent(t)[0]


@query("G13_latent_residuals", "axis:i variance:r explained:r small_residual:i", f"""
WITH RECURSIVE {LATENT_SQL}, t AS (SELECT sum(v) AS t FROM cv WHERE i = j)
SELECT axis, l AS variance, l / t AS explained, 1 AS small_residual
FROM (SELECT 1 AS axis, l FROM ax_l UNION ALL SELECT 2, l FROM ay_l UNION ALL SELECT 3, l FROM az_l), t""")
def _(t):
    found = latent(t)[1]
    rows = [(k + 1, float(v), float(e), int(r <= 1e-9 * max(1.0, float(found.variances[0])))) for k, (v, e, r) in enumerate(zip(found.variances, found.explained, found.residuals))]
    return t.spark.createDataFrame(rows, "axis int, variance double, explained double, small_residual int")


def states(t):
    rows, cost = tp.latent_states(latent(t)[0], 6)
    costs = F.create_map(*[F.lit(x) for s, c in cost.items() for x in (s, c)])
    return rows.withColumn("objectives", costs)


@query("G14_latent_states", "ticker date:d state_cluster:i state_distance2:r best_start:i objective:r worst_objective:r")
def _(t):
    c = F.map_values("objectives")
    return states(t).withColumns({"objective": F.array_min(c), "worst_objective": F.array_max(c), "best_start": F.array_position(c, F.array_min(c)) - 1})


@query("E27_latent_motion", "ticker date:d latent_velocity:r latent_acceleration:r latent_path_curvature:r latent_radius:r latent_radial_expansion:r neighbor_convergence_velocity:r", f"""
WITH RECURSIVE {LATENT_SQL},
d AS (
    SELECT la.*, abs(neighbor_divergence) AS gap,
        latent_x - lag(latent_x) OVER w AS dx, latent_y - lag(latent_y) OVER w AS dy, latent_z - lag(latent_z) OVER w AS dz
    FROM la JOIN tg USING (ticker, date) WINDOW w AS (PARTITION BY la.ticker ORDER BY la.date)),
v AS (
    SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS latent_velocity, sqrt(latent_x * latent_x + latent_y * latent_y + latent_z * latent_z) AS latent_radius,
        dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w AS dot
    FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, latent_velocity, latent_velocity - lag(latent_velocity) OVER w AS latent_acceleration,
    CASE WHEN latent_velocity * lag(latent_velocity) OVER w > 1e-12
        THEN degrees(acos(greatest(-1, least(1, dot / (latent_velocity * lag(latent_velocity) OVER w))))) ELSE 0 END AS latent_path_curvature,
    latent_radius, latent_radius - lag(latent_radius) OVER w AS latent_radial_expansion, -(gap - lag(gap) OVER w) AS neighbor_convergence_velocity
FROM v WINDOW w AS (PARTITION BY ticker ORDER BY date)""", digits=3)
def _(t):
    names = {"velocity": "latent_velocity", "acceleration": "latent_acceleration", "curvature_deg": "latent_path_curvature", "radius": "latent_radius", "radial_expansion": "latent_radial_expansion"}
    return ft.motion(latent(t)[0], tp.LATENT, "neighbor_divergence").withColumnsRenamed(names)


@query("E28_latent_states", "ticker date:d state_cluster:i graph_cluster_switch_count_20d:i graph_regime_residence_days:i crowding_change_5d:i")
def _(t):
    out = ft.state_runs(stage(states(t)), "state_cluster", crowding="graph_degree")
    return out.withColumnsRenamed({"state_switches": "graph_cluster_switch_count_20d", "residence_length": "graph_regime_residence_days", "crowding_change": "crowding_change_5d"})


@query("G04_neighbor_weighted", "ticker date:d neighbor_ret_20d:r neighbor_vol_20d:r divergence_ret_20d:r",
       f"""WITH {KNN_SQL}, n AS (SELECT e.ticker, p.date, sum(weight * ret_20d) / sum(weight) AS r, sum(weight * vol_20d) / sum(weight) AS v FROM edges e JOIN panel p ON p.ticker = e.neighbor GROUP BY 1, 2)
       SELECT p.ticker, p.date, coalesce(r, 0) AS neighbor_ret_20d, coalesce(v, 0) AS neighbor_vol_20d, coalesce(r, 0) - ret_20d AS divergence_ret_20d FROM panel p LEFT JOIN n ON n.ticker = p.ticker AND n.date = p.date""", digits=5)
def _(t):
    return gr.neighbor_features(t.staged("panel"), edges(t)[0], ["ret_20d", "vol_20d"])


@query("G04_neighbor_plain", "ticker date:d neighbor_ret_20d:r graph_similarity_mean:r graph_degree:i",
       f"WITH {KNN_SQL}, n AS (SELECT e.ticker, p.date, avg(ret_20d) AS r, avg(similarity) AS s, count(*) AS d FROM edges e JOIN panel p ON p.ticker = e.neighbor GROUP BY 1, 2) SELECT p.ticker, p.date, r AS neighbor_ret_20d, s AS graph_similarity_mean, d AS graph_degree FROM panel p LEFT JOIN n ON n.ticker = p.ticker AND n.date = p.date", digits=5)
def _(t):
    return gr.neighbor_features(t.staged("panel"), edges(t)[0], ["ret_20d"], "plain")


@query("E30_interactions", "ticker date:d neighbor_confirmation:r neighbor_divergence:r similarity_weighted_momentum:r risk_adjusted_momentum:r crowding_risk:r",
       f"""WITH {KNN_SQL}, n AS (SELECT e.ticker, p.date, avg(ret_20d) AS r, avg(similarity) AS s, count(*) AS d FROM edges e JOIN panel p ON p.ticker = e.neighbor GROUP BY 1, 2)
       SELECT p.ticker, p.date, ret_20d * r AS neighbor_confirmation, ret_20d - r AS neighbor_divergence, ret_20d * s AS similarity_weighted_momentum, ret_20d / (abs(vol_20d) + 1e-4) AS risk_adjusted_momentum, d * vol_20d AS crowding_risk FROM panel p LEFT JOIN n ON n.ticker = p.ticker AND n.date = p.date""", digits=4)
def _(t):
    return ft.interactions(gr.neighbor_features(t.staged("panel"), edges(t)[0], ["ret_20d"], "plain"))


@query("G05_degree", "ticker strong_neighbors:i graph_degree:r", f"WITH {KNN_SQL} SELECT s.ticker, count(CASE WHEN similarity >= 0.10 THEN 1 END) AS strong_neighbors, count(CASE WHEN similarity >= 0.10 THEN 1 END) / ((SELECT count(DISTINCT ticker) FROM tr) - 1)::DOUBLE AS graph_degree FROM (SELECT DISTINCT ticker FROM tr) s LEFT JOIN pc ON pc.ticker = s.ticker GROUP BY 1")
def _(t):
    return edges(t)[1]


@query("G06_components", "node component",
       f"""WITH RECURSIVE {KNN_SQL}, l AS (SELECT ticker AS u, neighbor AS v FROM edges WHERE similarity >= 0.40), b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
       r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v) SELECT node, min(root) AS component FROM r GROUP BY node""")
def _(t):
    return gr.components(edges(t)[0].where(F.col("similarity") >= 0.40), "ticker", "neighbor")


@query("G06_near_bases", "base family",
       """WITH RECURSIVE b AS (SELECT DISTINCT 'S' || s_suppkey AS base FROM supplier), r AS (SELECT base, base AS family FROM b UNION ALL SELECT x.base, r.family FROM r JOIN b x ON substr(x.base, 1, length(x.base) - 1) = r.base) SELECT base, min(family) AS family FROM r GROUP BY 1""")
def _(t):
    from tessella.functions.scalars import canonical_base

    return gr.near_bases(t.symbols().select(canonical_base(F.regexp_replace(F.trim("symbol"), "-WS$", "")).alias("base")))


NODE_COLS = ("ret_20d", "vol_20d", "drawdown_60d")
LATEST_SQL = "lt AS (SELECT * EXCLUDE (dollar_vol_20d_log), exp(dollar_vol_20d_log) - 1 AS dollar_vol_20d FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"
FKNN_SQL = f"""{LATEST_SQL}, z AS (SELECT ticker, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in NODE_COLS)} FROM lt),
       ds AS (SELECT a.ticker, b.ticker AS neighbor, sqrt({' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in NODE_COLS)}) AS d FROM z a JOIN z b ON a.ticker <> b.ticker QUALIFY row_number() OVER (PARTITION BY a.ticker ORDER BY d, b.ticker) <= 6),
       sc AS (SELECT median(d) AS s FROM ds WHERE d > 0), w AS (SELECT ticker, neighbor, exp(-d * d / (2 * s * s)) AS w FROM ds, sc WHERE exp(-d * d / (2 * s * s)) > 0), fe AS (SELECT ticker, neighbor, max(w) AS weight FROM (SELECT * FROM w UNION ALL SELECT neighbor, ticker, w FROM w) GROUP BY 1, 2)"""


def latest(t):
    from tessella.operators.joins import latest_rows

    p = t.staged("panel").select("ticker", "date", *NODE_COLS, "ret_60d", "vol_60d", F.expm1("dollar_vol_20d_log").alias("dollar_vol_20d"))
    return stage(latest_rows(p, ["ticker"], ["date"]))


@query("G07_feature_knn_edges", "ticker neighbor weight:r", f"WITH {FKNN_SQL} SELECT * FROM fe")
def _(t):
    return gr.feature_knn_graph(latest(t), NODE_COLS, 6)[0]


def _pct(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("G07_feature_knn_nodes", "ticker graph_strength:r graph_degree:i graph_strength_rank:r graph_degree_rank:r liquidity_rank:r bubble_size:r",
       f"""WITH {FKNN_SQL}, n AS (SELECT fe.ticker, sum(weight) AS graph_strength, count(*) AS graph_degree, max(ln(1 + dollar_vol_20d)) AS l FROM fe JOIN lt ON lt.ticker = fe.ticker GROUP BY 1),
       r AS (SELECT *, {_pct('graph_strength')} AS graph_strength_rank, {_pct('graph_degree')} AS graph_degree_rank, {_pct('l')} AS liquidity_rank FROM n) SELECT *, 8 + 32 * (0.6 * liquidity_rank + 0.4 * graph_strength_rank) AS bubble_size FROM r""")
def _(t):
    return gr.feature_knn_graph(latest(t), NODE_COLS, 6)[1]


@query("G08_diffuse", "ticker date:d diffused_ret_20d:r diffused_vol_20d:r",
       f"""WITH {FKNN_SQL}, tw AS (SELECT ticker, neighbor, weight / sum(weight) OVER (PARTITION BY ticker) AS w FROM fe), md AS (SELECT date, median(ret_20d) AS m1, median(vol_20d) AS m2 FROM panel WHERE ticker IN (SELECT ticker FROM fe) GROUP BY 1),
       g AS (SELECT tw.ticker, md.date, sum(w * coalesce(p.ret_20d, m1)) AS a, sum(w * coalesce(p.vol_20d, m2)) AS b FROM tw, md LEFT JOIN panel p ON p.ticker = tw.neighbor AND p.date = md.date GROUP BY 1, 2)
       SELECT p.ticker, p.date, coalesce(a, 0) AS diffused_ret_20d, coalesce(b, 0) AS diffused_vol_20d FROM panel p LEFT JOIN g ON g.ticker = p.ticker AND g.date = p.date""", digits=5)
def _(t):
    return gr.diffuse(t.staged("panel"), gr.feature_knn_graph(latest(t), NODE_COLS, 6)[0], ["ret_20d", "vol_20d"])


@query("G09_spectral", "ticker graph_x:r graph_y:r graph_z:r residual_x:r residual_y:r residual_z:r")
def _(t):
    return gr.spectral(gr.feature_knn_graph(latest(t), NODE_COLS, 6)[0])


@query("G10_knn_adjust", "id consensus:r confidence:r adjusted:r", """
WITH e AS (
    SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS x, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y
    FROM embeddings),
d AS (
    SELECT a.id, list_distance(a.x, b.x) AS d, b.y
    FROM e a JOIN e b ON a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) <= 20),
s AS (SELECT median(m) AS s FROM (SELECT avg(d) AS m FROM d GROUP BY id)),
g AS (
    SELECT id, sum(exp(-d / s) * y) / sum(exp(-d / s)) AS consensus, exp(-avg(d) / max(s)) AS confidence
    FROM d, s
    GROUP BY 1)
SELECT *, greatest(1e-6, least(1 - 1e-6, 0.5 + 0.25 * confidence * (consensus - 0.5))) AS adjusted
FROM g""", digits=5)
def _(t):
    # every vector is predicted from all others
    e = t.table("embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("payload"))
    test = e.select("id", "x", F.lit(0.5).alias("p"))
    return gr.knn_adjust(test, e.select(F.col("id").alias("ref"), "x", "payload"), 20, 0.25, same=True)


@query("G11_variant_families", "family ticker members:i chosen:i reason",
       f"""WITH RECURSIVE m0 AS (SELECT ticker, 'S' || CAST(CAST(substr(ticker, 2) AS INT) AS VARCHAR) AS base FROM symbols WHERE nation % 5 <> 2), b AS (SELECT DISTINCT base FROM m0), rb AS (SELECT base, base AS family FROM b UNION ALL SELECT x.base, rb.family FROM rb JOIN b x ON substr(x.base, 1, length(x.base) - 1) = rb.base),
       m AS (SELECT ticker, f.family FROM m0 JOIN (SELECT base, min(family) AS family FROM rb GROUP BY 1) f USING (base)), {DIR_SQL}, lk AS (SELECT a, b FROM fc JOIN m x ON x.ticker = a JOIN m y ON y.ticker = b WHERE x.family = y.family AND n >= 60 AND abs(c) >= 0.05),
       acc AS (SELECT family, min(ticker) AS ticker FROM m GROUP BY 1 UNION SELECT acc.family, lk.b FROM acc JOIN lk ON lk.a = acc.ticker), sn AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
       s AS (SELECT family, ticker, count(*) OVER f AS members, {' + '.join(f"{w} * (rank() OVER (PARTITION BY family ORDER BY {c}) / count(*) OVER f::DOUBLE)" for w, c in ((0.4, 'dollar_vol_20d'), (0.3, 'trend_slope_60d'), (0.2, 'ret_60d')))} + 0.1 * (1 - rank() OVER (PARTITION BY family ORDER BY vol_60d) / count(*) OVER f::DOUBLE) AS score
             FROM acc JOIN sn USING (ticker) WINDOW f AS (PARTITION BY family)), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(score, 12) DESC, ticker) AS r FROM s)
       SELECT family, ticker, members, CASE WHEN r = 1 THEN 1 ELSE 0 END AS chosen, CASE WHEN members = 1 THEN 'only member' WHEN r = 1 THEN 'best score' ELSE 'variant' END AS reason FROM k""")
def _(t):
    return gr.variant_families(t.symbols().select("ticker", "symbol"), gr.signs(t.prices(), 1008), snap(t), 0.05, 60)


@query("G13_pca3", "id x_pc:r y_pc:r z_pc:r")
def _(t):
    return gr.pca3(latest(t), "ticker", [*NODE_COLS, "ret_60d", "vol_60d"])


@query("G13_pca3_train", "id role x_pc:r y_pc:r z_pc:r latent_radius:r")
def _(t):
    p = t.staged("panel").withColumn("key", F.concat_ws("|", "ticker", "date"))
    cut = F.lit("1999-01-01").cast("date")
    return gr.pca3_train(p.where(F.col("date") < cut), p.where(F.col("date") >= cut), "key", [*NODE_COLS, "ret_60d", "vol_60d"])


@query("G14_kmeans_features", "ticker date:d role cluster:i crowding:r graph_degree:r")
def _(t):
    p = t.staged("panel")
    cut = F.lit("1999-01-01").cast("date")
    return gr.kmeans_features(p.where(F.col("date") < cut), p.where(F.col("date") >= cut), ["ticker", "date"], list(NODE_COLS), 6)


@query("G15_universe_map", "ticker status reason x:r y:r z:r")
def _(t):
    from tessella.operators.screens import screen
    from tessella.plans.q_clean import RULES

    r = screen(t.prices(), RULES)
    ok = latest(t).join(r.where(F.col("reason").isNull()), "ticker", "left_semi")
    return gr.universe_map(stage(ok), r.where(F.col("reason").isNotNull()).select("ticker", "reason"), [*NODE_COLS, "ret_60d"])
