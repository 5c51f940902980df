"""Queries for folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import folds as fd
from tickloom.operators import oof
from tickloom.operators import signals as sg
from tickloom.operators import stats as st
from tickloom.plans.registry import query
from tickloom.plans.stats_base import rank_sql
from tickloom.plans.stats_signal import PRED, class_sql, predictions
from tickloom.plans.views import HOUR

N, FIRST, PURGE = 12, 4, 25 * HOUR
EDGES = f"SELECT list_transform(range(0, {N + 1}), lambda i: a + floor(i * (b - a) / {N})::BIGINT) AS edges FROM (SELECT min(g_us) AS a, max(g_us) + 1 AS b FROM marks)"


@query(
    "chrono_blocks",
    f"SELECT block, count(*) AS n, min(g_us) AS first_us, max(g_us) AS last_us FROM (SELECT g_us, greatest(least(len(list_filter(edges, lambda e: e <= g_us)) - 1, {N - 1}), 0) AS block FROM marks, ({EDGES})) GROUP BY 1",
)
def chrono_blocks(v):
    d = fd.assign_blocks(v.marks, "g_us", N)
    return d.groupBy("block").agg(F.count("*").alias("n"), F.min("g_us").alias("first_us"), F.max("g_us").alias("last_us"))


FOLDS = f"SELECT b - {FIRST} AS fold, b AS block, edges[b + 1] - {PURGE} AS train_end, edges[b + 1] AS val_start, edges[b + 2] AS val_end FROM ({EDGES}), range({FIRST}, {N}) t(b)"


def folds(v):
    return fd.fold_dimension(v.marks, "g_us", N, FIRST, PURGE)


@query(
    "purged_folds",
    f"SELECT f.*, (SELECT count(*) FROM marks WHERE g_us <= train_end) AS train_rows, (SELECT count(*) FROM marks WHERE g_us >= val_start AND g_us < val_end) AS val_rows FROM ({FOLDS}) f",
)
def purged_folds(v):
    return fd.fold_table(v.marks, folds(v), "g_us")


@query(
    "horizon_purge",
    f"""SELECT fold, label, count(*) AS n, min(g_us) AS first_us FROM (SELECT f.fold, f.val_start, m.g_us, unnest(['m1', 'm6', 'm24']) AS label, unnest([{HOUR}, {6 * HOUR}, {24 * HOUR}])::BIGINT AS horizon, unnest([m1, m6, m24]) AS y
        FROM marks m JOIN ({FOLDS}) f ON m.g_us >= f.val_start AND m.g_us < f.val_end) WHERE y IS NOT NULL AND g_us >= val_start + horizon + 60000000 GROUP BY 1, 2""",
)
def horizon_purge(v):
    d = fd.purged_population(v.marks, folds(v), "g_us", {"m1": HOUR, "m6": 6 * HOUR, "m24": 24 * HOUR}, 60_000_000)
    return d.groupBy("fold", "label").agg(F.count("*").alias("n"), F.min("g_us").alias("first_us"))


@query(
    "walk_forward_splits",
    """WITH s AS (SELECT i AS fold, a + i * 90 AS train_start, a + i * 90 + 365 AS val_start, a + i * 90 + 455 AS test_start, a + i * 90 + 545 AS test_end, b FROM (SELECT min(day) AS a, max(day) AS b FROM bars), range(0, 200) t(i))
       SELECT fold, train_start, val_start, test_start, test_end, (SELECT count(*) FROM bars WHERE day >= train_start AND day < val_start - 7) AS train_rows, (SELECT count(*) FROM bars WHERE day >= val_start AND day < test_start - 7) AS val_rows,
              (SELECT count(*) FROM bars WHERE day >= test_start AND day < test_end) AS test_rows FROM s WHERE test_end <= b + 1""",
)
def walk_forward_splits(v):
    s = fd.calendar_splits(v.bars, "day", 365, 90, 90, 90)
    day = F.col("day")
    inside = {
        "train_rows": (day >= F.col("train_start")) & (day < F.col("val_start") - 7), "val_rows": (day >= F.col("val_start")) & (day < F.col("test_start") - 7),
        "test_rows": (day >= F.col("test_start")) & (day < F.col("test_end")),
    }
    d = v.bars.select("day").crossJoin(F.broadcast(s))
    return d.groupBy(*s.columns).agg(*[F.count_if(c).alias(o) for o, c in inside.items()])


SC = """
    WITH l AS (SELECT unnest(['x1', 'x2', 'y']) AS name, unnest([x1, x2, y])::DOUBLE AS value FROM wide WHERE blk < 15),
    b AS (SELECT name, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM l GROUP BY 1), c AS (SELECT l.name, low, high, CASE WHEN value IS NOT NULL THEN greatest(least(value, high), low) END AS value FROM l JOIN b USING (name)),
    m AS (SELECT name, quantile_cont(value, 0.5) AS median FROM c GROUP BY 1)
    SELECT name, max(low) AS low, max(high) AS high, max(median) AS median, avg(coalesce(value, median)) AS mean, CASE WHEN stddev_pop(coalesce(value, median)) > 0 THEN stddev_pop(coalesce(value, median)) ELSE 1 END AS scale FROM c JOIN m USING (name) GROUP BY 1"""


@query("fit_scaler", SC, dbl="low high median mean scale")
def fit_scaler(v):
    return scaler(v)


def scaler(v):
    train = v.wide.where("blk < 15")
    return fd.fit_scaler(train, ["x1", "x2", "y"], 0.01, 0.99, v.cut(st.long_columns(train, [], ["x1", "x2", "y"]), "lineitem", 3))


@query(
    "apply_scaler",
    f"SELECT id, (coalesce(CASE WHEN x1 IS NOT NULL THEN greatest(least(x1, a.high), a.low) END, a.median) - a.mean) / a.scale AS x1_z, (coalesce(CASE WHEN y IS NOT NULL THEN greatest(least(y, b.high), b.low) END, b.median) - b.mean) / b.scale AS y_z FROM wide, (SELECT * FROM ({SC}) WHERE name = 'x1') a, (SELECT * FROM ({SC}) WHERE name = 'y') b",
    dbl="x1_z y_z",
)
def apply_scaler(v):
    return fd.apply_scaler(v.wide, scaler(v), ["x1", "y"]).select("id", "x1_z", "y_z")


@query(
    "frozen_transforms",
    "SELECT name, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS population_std, " + ", ".join(f"quantile_cont(value, {i / 10}) AS d{i}" for i in range(1, 10))
    + ", quantile_cont(value, 0.5) AS median FROM (SELECT unnest(['x1', 'x2', 'x3']) AS name, unnest([x1, x2, x3])::DOUBLE AS value FROM wide WHERE blk < 15) GROUP BY 1",
    dbl="mean population_std median " + " ".join(f"d{i}" for i in range(1, 10)),
)
def frozen_transforms(v):
    train = v.wide.where("blk < 15")
    return fd.frozen_transforms(train, ["x1", "x2", "x3"], v.cut(st.long_columns(train, [], ["x1", "x2", "x3"]), "lineitem", 3))


Z = "SELECT id, y, blk, (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS z1, (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS z2 FROM wide"
COEF = f"""
    SELECT c1, c2, my - c1 * m1 - c2 * m2 AS c0 FROM (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c2, my, m1, m2 FROM (
      SELECT covar_pop(z1, y) AS s1y, covar_pop(z2, y) AS s2y, var_pop(z1) AS s11, var_pop(z2) AS s22, covar_pop(z1, z2) AS s12, avg(y) AS my, avg(z1) AS m1, avg(z2) AS m2 FROM z WHERE y IS NOT NULL))"""


def standardised(v):
    return st.add_standard_scores(v.wide, {"x1": "z1", "x2": "z2"}, blocks=v.value_blocks(v.wide, "x1"))


@query("ols_fit", f"WITH z AS ({Z}), c AS ({COEF}) SELECT unnest(['intercept', 'z1', 'z2']) AS name, unnest([c0, c1, c2]) AS value FROM c", dbl="value")
def ols_fit(v):
    return fd.ols_fit(standardised(v), ["z1", "z2"], "y")


@query(
    "linear_score",
    f"""WITH z AS ({Z}), c AS ({COEF}), s AS (SELECT blk, y, c0 + z1 * c1 + z2 * c2 AS f FROM z, c WHERE y IS NOT NULL)
        SELECT blk, count(*) AS n, avg(f) AS mean_score, corr(f, y) AS ic, 1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - f)) AS mae, avg((sign(f) = sign(y))::INT) AS direction_accuracy FROM s GROUP BY 1""",
    dbl="mean_score ic r2 mae direction_accuracy",
)
def linear_score(v):
    z = standardised(v)
    s = fd.linear_score(z, fd.ols_fit(z, ["z1", "z2"], "y"), ["z1", "z2"], "f").where("y IS NOT NULL")
    e = F.col("y") - F.col("f")
    return s.groupBy("blk").agg(
        F.count("*").alias("n"), F.avg("f").alias("mean_score"), st.safe_corr("f", "y").alias("ic"), (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"), F.avg((F.signum("f") == F.signum("y")).cast("int")).alias("direction_accuracy"),
    )


def oof_rows(v):
    d = v.marks.where("sig IS NOT NULL AND m6 IS NOT NULL").withColumn("up", (F.col("m6") > 0).cast("int"))
    return d, fd.fold_dimension(v.marks, "g_us", N, 2, PURGE)


#: The boosting schedule is the whole one but for its rounds, so that eight folds take minutes.
FEW_ROUNDS = {"maxIter": 20}


@query("oof_models")
def oof_models(v):
    d, ten = oof_rows(v)
    p = oof.out_of_fold(d, ten, "g_us", ["seg", "g_us"], ["sig", "mid_x2"], "up", boosted=FEW_ROUNDS)
    return sg.classification_scores(p, ["model", "fold"], "up", "prediction")


RIDGE = f"""
    WITH f AS (SELECT b - 2 AS fold, edges[b + 1] - {PURGE} AS train_end, edges[b + 1] AS val_start, edges[b + 2] AS val_end FROM ({EDGES}), range(2, {N}) t(b)),
    d AS (SELECT * FROM marks WHERE sig IS NOT NULL AND m6 IS NOT NULL),
    m AS (SELECT fold, count(*) AS n, quantile_cont(m6, 0.5) AS mid, avg(sig) AS a1, avg(mid_x2) AS a2, avg(m6) AS ay, stddev_pop(sig) AS s1, stddev_pop(mid_x2) AS s2,
                 count(*) * covar_pop(sig, m6) / stddev_pop(sig) AS b1, count(*) * covar_pop(mid_x2, m6) / stddev_pop(mid_x2) AS b2, count(*) * covar_pop(sig, mid_x2) / (stddev_pop(sig) * stddev_pop(mid_x2)) AS r
          FROM d JOIN f ON d.g_us <= f.train_end GROUP BY 1 HAVING count(*) >= 1000),
    w AS (SELECT *, (b1 * (n + 1) - b2 * r) / ((n + 1) * (n + 1) - r * r) AS w1, (b2 * (n + 1) - b1 * r) / ((n + 1) * (n + 1) - r * r) AS w2 FROM m),
    p AS (SELECT fold, m6, mid AS naive, ay + w1 * (sig - a1) / s1 + w2 * (mid_x2 - a2) / s2 AS ridge FROM d JOIN f ON d.g_us >= f.val_start AND d.g_us < f.val_end JOIN w USING (fold)),
    l AS (SELECT fold, 'naive' AS model, m6 AS y, round(naive, 4) AS f FROM p UNION ALL SELECT fold, 'ridge', m6, round(ridge, 4) FROM p)
    SELECT model, fold, count(*) AS n, avg(abs(f - y)) AS mae, sqrt(avg((f - y) * (f - y))) AS rmse, CASE WHEN max(f) > min(f) THEN corr(rf, ry) END AS spearman, avg(((f > 0) = (y > 0))::INT) AS sign_accuracy,
           1 - sum((f - y) * (f - y)) / nullif(var_pop(y) * count(*), 0) AS r2, quantile_cont(abs(f - y), 0.5) AS median_ae
    FROM (SELECT *, {rank_sql('f', 'model, fold')} AS rf, {rank_sql('y', 'model, fold')} AS ry FROM l) GROUP BY 1, 2"""


@query("oof_regressions", RIDGE, dbl="mae rmse spearman sign_accuracy r2 median_ae")
def oof_regressions(v):
    """Naive and ridge, in closed form from one pass; rounded so that equal predictions tie in every engine."""
    d, ten = oof_rows(v)
    values = v.value_blocks(d, "m6", "events")
    p = oof.out_of_fold(d, ten, "g_us", ["seg", "g_us"], ["sig", "mid_x2"], "m6", ("naive", "ridge"), blocks=values)
    return sg.regression_scores(p.withColumn("prediction", F.round("prediction", 4)), ["model", "fold"], "m6", "prediction")


@query("oof_boosted")
def oof_boosted(v):
    d, ten = oof_rows(v)
    p = oof.out_of_fold(d, ten, "g_us", ["seg", "g_us"], ["sig", "mid_x2"], "m6", ("naive", "ridge", "boosted"), boosted=FEW_ROUNDS)
    return sg.regression_scores(p, ["model", "fold"], "m6", "prediction")


@query(
    "coefficient_summary",
    """WITH c AS (SELECT grp, unnest(['x1', 'x2', 'x3']) AS feature, unnest([regr_slope(y, x1), regr_slope(y, x2), regr_slope(y, x3)]) AS value FROM wide WHERE y IS NOT NULL GROUP BY 1),
       s AS (SELECT feature, count(*) AS folds, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max, avg((value > 0)::INT) AS share_positive, avg(abs(value)) AS g FROM c GROUP BY 1)
       SELECT * EXCLUDE (g), g / (SELECT sum(g) FROM s) AS gain_share FROM s""",
    dbl="mean median min max share_positive gain_share",
)
def coefficient_summary(v):
    slopes = v.wide.where("y IS NOT NULL").groupBy("grp").agg(*[F.regr_slope("y", c).alias(c) for c in ("x1", "x2", "x3")])
    c = st.long_columns(slopes, ["grp"], ["x1", "x2", "x3"], "feature", "value")
    return fd.coefficient_summary(c, ["feature"])


P2 = PRED.replace("(x1 * 7 + x2 * 3) % 97 / 97.0 AS p", "(y + 1000 + (x1 * 7 + x2 * 3) % 997 * 3) / 4991.0 AS p")


def auc(src, keys):
    return f"({class_sql(src, keys)})"


@query(
    "nested_delta",
    f"""WITH a AS {auc(PRED, [])}, b AS {auc(P2, [])}, k AS (SELECT y.roc_auc - x.roc_auc AS ch FROM {auc(PRED, ['blk'])} x JOIN {auc(P2, ['blk'])} y USING (blk) WHERE x.n >= 20 AND y.roc_auc - x.roc_auc IS NOT NULL)
        SELECT a.roc_auc AS roc_auc_base, a.log_loss AS log_loss_base, a.brier AS brier_base, b.n, b.roc_auc AS roc_auc_extended, b.log_loss AS log_loss_extended, b.brier AS brier_extended,
               (SELECT count(*) FROM k) AS blocks, (SELECT avg(ch) FROM k) AS block_mean, (SELECT min(ch) FROM k) AS block_worst, (SELECT avg((ch > 0)::INT) FROM k) AS share_positive,
               b.roc_auc - a.roc_auc AS delta_roc_auc, b.log_loss - a.log_loss AS delta_log_loss, b.brier - a.brier AS delta_brier FROM a, b""",
    dbl="roc_auc_base log_loss_base brier_base roc_auc_extended log_loss_extended brier_extended block_mean block_worst share_positive delta_roc_auc delta_log_loss delta_brier",
)
def nested_delta(v):
    base = predictions(v)
    better = v.wide.where("y IS NOT NULL").selectExpr("id", "cast(y + 1000 + (x1 * 7 + x2 * 3) % 997 * 3 as double) / 4991 AS p")
    return fd.nested_delta(base, better, ["id"], "t", "p", "blk", 20, lambda c: v.blocks(base, "p", "lineitem"))


@query(
    "residual_diagnostic",
    """WITH m AS (SELECT covar_pop(x2, x1) AS s1y, covar_pop(x3, x1) AS s2y, var_pop(x2) AS s11, var_pop(x3) AS s22, covar_pop(x2, x3) AS s12, avg(x1) AS my, avg(x2) AS m1, avg(x3) AS m2 FROM wide),
       c AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c2 FROM m), f AS (SELECT w.*, my + c1 * (x2 - m1) + c2 * (x3 - m2) AS fit FROM wide w, c)
       SELECT count(*) AS n, 1 - sum((x1 - fit) * (x1 - fit)) / (var_pop(x1) * count(*)) AS r2, corr(x1, fit) AS corr_fit, corr(x1 - fit, y) AS corr_residual, corr(x1, y) AS corr_signal FROM f""",
    dbl="r2 corr_fit corr_residual corr_signal",
)
def residual_diagnostic(v):
    return fd.residual_diagnostic(v.wide, "x1", ["x2", "x3"], "y")
