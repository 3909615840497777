"""Registered queries: one per operator of the inventory, each on the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL over
the raw tables) are what ``__spark_entry__`` exposes. Doubles are rounded to 6
digits on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebird.oracle import with_ev
from rarebird.operators import profile as prof
from rarebird.operators import scaling
from rarebird.session import scratch_path
from rarebird.sources import tables
from rarebird.sources.fixtures import doc_quality, ev_features, read
from rarebird.spec import EV_SPEC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


EV_COLS = ("event_id value hr k usr_events usr_value const night even_user big category label learn "
           "score prediction").split()
NUMS = list(EV_SPEC.numerics)
FEATS = EV_SPEC.features
DTYPES = {"value": "double", "hr": "double", "k": "double", "usr_events": "double", "usr_value": "double",
          "const": "double", "night": "int", "even_user": "int", "big": "int"}
EV_SCHEMA = ("event_id bigint, value double, hr double, k double, usr_events double, usr_value double, "
             "const double, night int, even_user int, big int, category string, label int, learn int, "
             "score int, prediction int")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- S: sources and sinks

@query("S1_load_table", with_ev("SELECT * FROM ev_features"))
def q_load_table(spark, sf):
    events = tables.load_table(spark, f"{sf}/events.parquet")
    return ev_features(spark, sf, events)


@query("S2_write_table", with_ev("SELECT * FROM ev_features"))
def q_write_table(spark, sf):
    path = tables.write_table(ev_features(spark, sf), scratch_path(spark, "csv"), "csv")
    return tables.load_table(spark, path, EV_SCHEMA, "csv")


def _scaler_sql(kind: str) -> str:
    if kind == "standard":
        parts = [f"SELECT '{c}' AS \"column\", 'standard' AS kind, round(avg({c}), 6) AS center, "
                 f"round(stddev_pop({c}), 6) AS scale FROM ev_features" for c in NUMS]
    else:
        parts = [f"SELECT '{c}' AS \"column\", 'minmax' AS kind, round(min({c}), 6) AS center, "
                 f"round(max({c}) - min({c}), 6) AS scale FROM ev_features" for c in NUMS]
    return with_ev(_union(parts))


@query("S4_save_scaler", _scaler_sql("standard"))
def q_save_scaler(spark, sf):
    stats = scaling.fit_standard_scaler(ev_features(spark, sf), EV_SPEC)
    path = tables.save_scaler(stats, scratch_path(spark, "scaler"))
    return tables.load_scaler(spark, path)


# ---------------------------------------------------------------- D: profiling and projections

def _profile_sql() -> str:
    parts = []
    for c in FEATS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{DTYPES[c]}' AS dtype, count({c}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM ev_features")
    return with_ev(_union(parts))


@query("D1_profile", _profile_sql())
def q_profile(spark, sf):
    return prof.profile(ev_features(spark, sf), FEATS)


@query("D1_shape", with_ev("SELECT count(*) AS n_rows, 15 AS n_cols FROM ev_features"))
def q_shape(spark, sf):
    return prof.shape(ev_features(spark, sf))


@query("D1_column_list", with_ev(_union([
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{'bigint' if c == 'event_id' else 'string' if c == 'category' else 'int' if c in ('label', 'learn', 'score', 'prediction') else DTYPES[c]}' AS dtype, "
    f"count({c}) AS non_null, count(*) AS rows FROM ev_features" for i, c in enumerate(EV_COLS)])))
def q_column_list(spark, sf):
    return prof.column_list(ev_features(spark, sf).select(*EV_COLS))


@query("D2_head", with_ev("SELECT * FROM ev_features ORDER BY event_id LIMIT 5"))
def q_head(spark, sf):
    return prof.head(ev_features(spark, sf), "event_id", 5)


@query("D3_split_features_label",
       with_ev(f"SELECT event_id, {', '.join(FEATS)}, label FROM ev_features"))
def q_split(spark, sf):
    return prof.split_features_label(ev_features(spark, sf), EV_SPEC)


@query("D4_label_encode", with_ev(
    "SELECT event_id, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS category, label "
    "FROM ev_features"))
def q_label_encode(spark, sf):
    df = ev_features(spark, sf).select("event_id", "category", "label")
    return prof.label_encode(df, ["category"])[0]


@query("D4_label_mapping", with_ev(
    "SELECT 'category' AS \"column\", category AS value, "
    "CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT category FROM ev_features)"))
def q_label_mapping(spark, sf):
    df = ev_features(spark, sf).select("event_id", "category", "label")
    return prof.label_encode(df, ["category"])[1]


_DOCS_SQL = """docs AS (
  SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


@query("D5_impute_median", with_ev(
    "SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM docs)) AS quality, "
    "coalesce(toxic, (SELECT quantile_cont(toxic, 0.5) FROM docs)) AS toxic FROM docs", _DOCS_SQL))
def q_impute(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    labels = read(spark, sf, "labels")
    df = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return prof.impute_median(df, ["quality", "toxic"])[0]


_CATS = ["click", "error", "purchase", "signup", "view"]


@query("D6_one_hot", with_ev(
    "SELECT event_id, label, " + ", ".join(
        f"CAST(category = '{v}' AS INTEGER) AS category_{v}" for v in _CATS) + " FROM ev_features"))
def q_one_hot(spark, sf):
    return prof.one_hot(ev_features(spark, sf).select("event_id", "category", "label"), ["category"])


@query("D7_select_features", with_ev("SELECT event_id, value, hr, k, label FROM ev_features"))
def q_select(spark, sf):
    return prof.select_features(ev_features(spark, sf), EV_SPEC, ["value", "hr", "k"])


@query("D8_drop_features", with_ev(
    "SELECT * EXCLUDE (usr_value, const, category) FROM ev_features"))
def q_drop(spark, sf):
    return prof.drop_features(ev_features(spark, sf), EV_SPEC, ["usr_value", "const", "category"])


@query("D9_filter_class", with_ev("SELECT * FROM ev_features WHERE label = 1"))
def q_filter(spark, sf):
    return prof.filter_class(ev_features(spark, sf), EV_SPEC, 1)


@query("D10_class_counts", with_ev(
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM ev_features GROUP BY label"))
def q_counts(spark, sf):
    return prof.class_counts(ev_features(spark, sf), EV_SPEC)


@query("D11_class_weights", with_ev(
    "SELECT event_id, label, round(count(*) OVER () / (2.0e0 * count(*) OVER (PARTITION BY label)), 6) AS weight "
    "FROM ev_features"))
def q_weights(spark, sf):
    return prof.class_weights(ev_features(spark, sf).select("event_id", "label"), EV_SPEC)


@query("D11_class_weights_positive", with_ev(
    "SELECT event_id, label, CASE WHEN label = 1 THEN 2.0e0 ELSE 1.0e0 END AS weight FROM ev_features"))
def q_weights_pos(spark, sf):
    return prof.class_weights(ev_features(spark, sf).select("event_id", "label"), EV_SPEC, mode="positive")


# ---------------------------------------------------------------- C: scaling

@query("C1_fit_standard_scaler", _scaler_sql("standard"))
def q_fit_std(spark, sf):
    return scaling.fit_standard_scaler(ev_features(spark, sf), EV_SPEC)


@query("C2_fit_minmax_scaler", _scaler_sql("minmax"))
def q_fit_minmax(spark, sf):
    return scaling.fit_minmax_scaler(ev_features(spark, sf), EV_SPEC)


def _scaled_sql(kind: str) -> str:
    if kind == "standard":
        cols = [f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}"
                for c in NUMS]
    else:
        cols = [f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 6)"
                f" AS {c}" for c in NUMS]
    return with_ev(f"SELECT event_id, {', '.join(cols)}, night, even_user, big, label FROM ev_features")


@query("C4_fit_apply_scaler", _scaled_sql("standard"))
def q_fit_apply(spark, sf):
    return scaling.fit_apply_scaler(ev_features(spark, sf), EV_SPEC, "standard")[0]


@query("C4_fit_apply_scaler_minmax", _scaled_sql("minmax"))
def q_fit_apply_mm(spark, sf):
    return scaling.fit_apply_scaler(ev_features(spark, sf), EV_SPEC, "minmax")[0]


# ---------------------------------------------------------------- E: evaluation

from rarebird.operators import curves, metrics  # noqa: E402


def _scores(spark, sf) -> DataFrame:
    """Three stand-in score sets from the data: integer scores with ties, continuous
    values, and hours (heavy ties)."""
    ev = ev_features(spark, sf)
    parts = [ev.select(F.lit(m).alias("model"), "event_id", "label", F.col(c).cast("double").alias("score"))
             for m, c in (("score", "score"), ("value", "value"), ("hr", "hr"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _preds(spark, sf) -> DataFrame:
    ev = ev_features(spark, sf)
    parts = [ev.select(F.lit(m).alias("model"), "event_id", "label", F.col(c).alias("prediction"))
             for m, c in (("score50", "prediction"), ("night", "night"), ("big", "big"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SCORED_CTE = """scored AS (
  SELECT 'score' AS model, event_id, label, CAST(score AS DOUBLE) AS score FROM ev_features
  UNION ALL SELECT 'value', event_id, label, value FROM ev_features
  UNION ALL SELECT 'hr', event_id, label, hr FROM ev_features
)"""
PREDS_CTE = """preds AS (
  SELECT 'score50' AS model, event_id, label, prediction FROM ev_features
  UNION ALL SELECT 'night', event_id, label, night FROM ev_features
  UNION ALL SELECT 'big', event_id, label, big FROM ev_features
)"""
COUNTS_CTE = """cm AS (
  SELECT model,
         CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM preds GROUP BY model
)"""
CURVE_CTE = """d AS (
  SELECT model, CAST(score AS DOUBLE) AS threshold, CAST(sum(label) AS BIGINT) AS tp,
         CAST(sum(1 - label) AS BIGINT) AS fp
  FROM scored GROUP BY 1, 2
), c AS (
  SELECT model, threshold, tp AS dtp, fp AS dfp,
         row_number() OVER (PARTITION BY model ORDER BY threshold DESC) AS point,
         CAST(sum(tp) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ctp,
         CAST(sum(fp) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cfp,
         lead(tp) OVER (PARTITION BY model ORDER BY threshold DESC) AS ntp,
         lead(fp) OVER (PARTITION BY model ORDER BY threshold DESC) AS nfp,
         sum(tp) OVER (PARTITION BY model) AS P, sum(fp) OVER (PARTITION BY model) AS N
  FROM d
)"""
PR_SQL = """SELECT model, point, threshold, ctp AS tp, cfp AS fp, round(ctp / (ctp + cfp), 6) AS precision,
       round(ctp / P, 6) AS recall
FROM c WHERE ctp - dtp < P
UNION ALL SELECT DISTINCT model, 0, NULL, 0, 0, 1.0e0, 0.0e0 FROM d"""
ROC_SQL = """SELECT model, point, threshold, ctp AS tp, cfp AS fp, round(cfp / N, 6) AS fpr, round(ctp / P, 6) AS tpr
FROM c WHERE point = 1 OR ntp IS NULL OR ntp <> dtp OR nfp <> dfp
UNION ALL SELECT DISTINCT model, 0, NULL, 0, 0, 0.0e0, 0.0e0 FROM d"""
# Independent definitions: AP = mean over positives of the precision at their score;
# AUC = Mann-Whitney share of (positive, negative) pairs ordered right, ties one half.
AP_SQL = """SELECT s.model, round(avg(c.ctp / (c.ctp + c.cfp)), 6) AS average_precision
FROM scored s JOIN c ON s.model = c.model AND CAST(s.score AS DOUBLE) = c.threshold
WHERE s.label = 1 GROUP BY s.model"""
AUC_CTE = """mw AS (
  SELECT model, tp, fp,
         coalesce(sum(fp) OVER (PARTITION BY model ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS neg_below
  FROM d
)"""
AUC_SQL = """SELECT model, round(sum(tp * (neg_below + 0.5e0 * fp)) / (sum(tp) * sum(fp)), 6) AS auc
FROM mw GROUP BY model"""


@query("E1_confusion_counts", with_ev("""SELECT p.model, g.label, g.prediction, CAST(count(x.event_id) AS BIGINT) AS n
FROM (SELECT DISTINCT model FROM preds) p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)
LEFT JOIN preds x ON x.model = p.model AND x.label = g.label AND x.prediction = g.prediction
GROUP BY 1, 2, 3""", PREDS_CTE))
def q_confusion(spark, sf):
    return metrics.confusion_counts(_preds(spark, sf), ["model"])


@query("E2_normalized_confusion", with_ev("""SELECT model, label, prediction, n,
  round(coalesce(n / nullif(sum(n) OVER (PARTITION BY model, label), 0), 0), 6) AS share
FROM (SELECT p.model, g.label, g.prediction, CAST(count(x.event_id) AS BIGINT) AS n
      FROM (SELECT DISTINCT model FROM preds) p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)
      LEFT JOIN preds x ON x.model = p.model AND x.label = g.label AND x.prediction = g.prediction
      GROUP BY 1, 2, 3)""", PREDS_CTE))
def q_norm_confusion(spark, sf):
    return metrics.normalized_confusion(_preds(spark, sf), ["model"])


_E3_SQL = """SELECT model,
  round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc
FROM cm"""


@query("E3_binary_metrics", with_ev(_E3_SQL, PREDS_CTE, COUNTS_CTE))
def q_binary_metrics(spark, sf):
    return metrics.binary_metrics(_preds(spark, sf), ["model"])


PRED_SCORED_CTE = """scored AS (
  SELECT 'score50' AS model, event_id, label, CAST(prediction AS DOUBLE) AS score FROM ev_features
  UNION ALL SELECT 'night', event_id, label, CAST(night AS DOUBLE) FROM ev_features
  UNION ALL SELECT 'big', event_id, label, CAST(big AS DOUBLE) FROM ev_features
)"""


@query("E3_hard_auc_via_roc", with_ev(AUC_SQL, PRED_SCORED_CTE, CURVE_CTE, AUC_CTE))
def q_hard_auc(spark, sf):
    """Hard-prediction AUC equals the exact AUC of the 0/1 prediction used as a score."""
    p = _preds(spark, sf).withColumn("score", F.col("prediction").cast("double"))
    return curves.auc_score(p, ["model"])


_E4_SQL = """SELECT model, '0' AS "row", round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall, round(coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), 6) AS f1,
  tn + fp AS support FROM cm
UNION ALL SELECT model, '1', round(coalesce(tp / nullif(tp + fp, 0), 0), 6), round(coalesce(tp / nullif(tp + fn, 0), 0), 6),
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), tp + fn FROM cm
UNION ALL SELECT model, 'accuracy', NULL, NULL, round((tp + tn) / (tp + fp + tn + fn), 6), tp + fp + tn + fn FROM cm
UNION ALL SELECT model, 'macro avg',
  round((coalesce(tn / nullif(tn + fn, 0), 0) + coalesce(tp / nullif(tp + fp, 0), 0)) / 2, 6),
  round((coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2, 6),
  round((coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 6),
  tp + fp + tn + fn FROM cm
UNION ALL SELECT model, 'weighted avg',
  round((coalesce(tn / nullif(tn + fn, 0), 0) * (tn + fp) + coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn)) / (tp + fp + tn + fn), 6),
  round((coalesce(tn / nullif(tn + fp, 0), 0) * (tn + fp) + coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn)) / (tp + fp + tn + fn), 6),
  round((coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) * (tn + fp)
         + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)) / (tp + fp + tn + fn), 6),
  tp + fp + tn + fn FROM cm"""


@query("E4_classification_report", with_ev(_E4_SQL, PREDS_CTE, COUNTS_CTE))
def q_report(spark, sf):
    return metrics.classification_report(_preds(spark, sf), ["model"])


@query("E5_pr_curve", with_ev(PR_SQL, SCORED_CTE, CURVE_CTE))
def q_pr(spark, sf):
    return curves.pr_curve(_scores(spark, sf), ["model"])


@query("E6_roc_curve", with_ev(ROC_SQL, SCORED_CTE, CURVE_CTE))
def q_roc(spark, sf):
    return curves.roc_curve(_scores(spark, sf), ["model"])


@query("E7_average_precision", with_ev(AP_SQL, SCORED_CTE, CURVE_CTE))
def q_ap(spark, sf):
    return curves.average_precision(_scores(spark, sf), ["model"])


@query("E8_auc_score", with_ev(AUC_SQL, SCORED_CTE, CURVE_CTE, AUC_CTE))
def q_auc(spark, sf):
    return curves.auc_score(_scores(spark, sf), ["model"])


@query("E9_threshold_table", with_ev(
    "SELECT model, threshold, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / P, 6) AS recall "
    "FROM c WHERE ctp - dtp < P", SCORED_CTE, CURVE_CTE))
def q_thresholds(spark, sf):
    return curves.threshold_table(_scores(spark, sf), ["model"])


@query("E10_curve_reference_lines", with_ev("""SELECT t.curve, t.line, t.point, t.x,
  round(coalesce(t.y, p.p), 6) AS y, round(coalesce(t.area, p.p), 6) AS area
FROM (VALUES ('pr', 'perfect', 0, 0.0e0, 1.0e0, 1.0e0), ('pr', 'perfect', 1, 1.0e0, 1.0e0, 1.0e0),
             ('pr', 'perfect', 2, 1.0e0, NULL, 1.0e0), ('pr', 'chance', 0, 0.0e0, 1.0e0, NULL),
             ('pr', 'chance', 1, 0.0e0, NULL, NULL), ('pr', 'chance', 2, 1.0e0, NULL, NULL),
             ('roc', 'perfect', 0, 0.0e0, 0.0e0, 1.0e0), ('roc', 'perfect', 1, 0.0e0, 1.0e0, 1.0e0),
             ('roc', 'perfect', 2, 1.0e0, 1.0e0, 1.0e0), ('roc', 'chance', 0, 0.0e0, 0.0e0, 0.5e0),
             ('roc', 'chance', 1, 1.0e0, 1.0e0, 0.5e0)) t(curve, line, point, x, y, area)
CROSS JOIN (SELECT avg(CAST(label AS DOUBLE)) AS p FROM ev_features) p"""))
def q_reference_lines(spark, sf):
    return curves.curve_reference_lines(ev_features(spark, sf))


@query("E11_curve_comparison", with_ev(f"""SELECT pr.model, 'pr' AS curve, pr.point, pr.recall AS x, pr.precision AS y, ap.average_precision AS area
FROM ({PR_SQL}) pr JOIN ({AP_SQL}) ap USING (model)
UNION ALL
SELECT roc.model, 'roc', roc.point, roc.fpr, roc.tpr, auc.auc
FROM ({ROC_SQL}) roc JOIN ({AUC_SQL}) auc USING (model)""", SCORED_CTE, CURVE_CTE, AUC_CTE))
def q_curve_comparison(spark, sf):
    return curves.curve_comparison(_scores(spark, sf), ["model"])


# ---------------------------------------------------------------- P: folds and sampling

from rarebird.oracle import md5_int, md5_uniform  # noqa: E402
from rarebird.operators import folds as fo  # noqa: E402
from rarebird.operators import sampling as sa  # noqa: E402
from rarebird.plans import baselines  # noqa: E402

K = 5
SEED = 42

# Independent fold rule: deal the sorted class codes (order of first appearance)
# round-robin, count per (class, fold), then fill folds in id order inside each class.
FOLDS_CTE = """enc AS (
  SELECT label, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM ev_features GROUP BY label
), yorder AS (
  SELECT e.code, row_number() OVER (ORDER BY e.code) - 1 AS pos FROM ev_features f JOIN enc e USING (label)
), alloc AS (
  SELECT code, pos % 5 AS fold, count(*) AS cnt FROM yorder GROUP BY 1, 2
), cum AS (
  SELECT code, fold, cnt, sum(cnt) OVER (PARTITION BY code ORDER BY fold) AS hi FROM alloc
), fx AS (
  SELECT f.*, e.code, row_number() OVER (PARTITION BY f.label ORDER BY f.event_id) AS j
  FROM ev_features f JOIN enc e USING (label)
), folds AS (
  SELECT fx.* EXCLUDE (j, code), CAST(cum.fold AS INTEGER) AS fold
  FROM fx JOIN cum ON fx.code = cum.code AND fx.j > cum.hi - cum.cnt AND fx.j <= cum.hi
)"""


def _folded(spark, sf) -> DataFrame:
    return fo.stratified_kfold(ev_features(spark, sf), EV_SPEC, K)


@query("P1_stratified_kfold", with_ev("SELECT event_id, label, fold FROM folds", FOLDS_CTE))
def q_folds(spark, sf):
    return _folded(spark, sf).select("event_id", "label", "fold")


@query("P0_ranked", with_ev(
    "SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY "
    f"{md5_int(SEED, 'event_id')}, event_id) AS rank FROM ev_features"))
def q_ranked(spark, sf):
    from rarebird.functions import hash_int
    from rarebird.operators.ranking import ranked

    df = ev_features(spark, sf).select("event_id", "label", hash_int(SEED, "event_id").alias("_u"))
    return ranked(df, ["_u", "event_id"], group=["label"]).drop("_u")


@query("P6_fold_split", with_ev(
    "SELECT event_id, label, CAST(g.f AS INTEGER) AS fold, CASE WHEN g.f = folds.fold THEN 'test' ELSE 'train' END AS role "
    "FROM folds CROSS JOIN (SELECT range AS f FROM range(5)) g", FOLDS_CTE))
def q_fold_split(spark, sf):
    return fo.fold_roles(_folded(spark, sf).select("event_id", "label", "fold"), K)


LEARN_FRACTIONS = [0.1, 0.325, 0.55, 0.775, 1.0]


@query("P8_learning_subset", with_ev("""SELECT CAST(tr.fold AS INTEGER) AS fold, sz.size, tr.event_id
FROM (SELECT g.f AS fold, folds.event_id, row_number() OVER (PARTITION BY g.f ORDER BY folds.event_id) AS j
      FROM folds CROSS JOIN (SELECT range AS f FROM range(5)) g WHERE folds.fold <> g.f) tr
JOIN (SELECT CAST(floor(x * (SELECT count(*) FROM folds WHERE fold <> 0)) AS BIGINT) AS size
      FROM (VALUES (0.1e0), (0.325e0), (0.55e0), (0.775e0), (1.0e0)) v(x)) sz ON tr.j <= sz.size""", FOLDS_CTE))
def q_learning_subset(spark, sf):
    f = _folded(spark, sf).select("event_id", "label", "fold")
    sizes = fo.learning_sizes(f, "fold", LEARN_FRACTIONS)
    return fo.learning_subset(f, EV_SPEC, sizes, K).select("fold", "size", "event_id")


@query("P2_undersample", with_ev(f"""SELECT event_id, label FROM ev_features WHERE label = 1
UNION ALL
SELECT event_id, label FROM (
  SELECT event_id, label, row_number() OVER (ORDER BY {md5_int(SEED, 'event_id')}, event_id) AS r
  FROM ev_features WHERE label = 0)
WHERE r <= (SELECT count(*) FROM ev_features WHERE label = 1)"""))
def q_undersample(spark, sf):
    return sa.undersample(ev_features(spark, sf).select("event_id", "label"), EV_SPEC, SEED)


_P7_KEPT, _P7_DROPPED = sa.random_feature_subset(EV_SPEC.features, SEED)


@query("P7_random_feature_subset", with_ev(f"SELECT event_id, {', '.join(_P7_KEPT)}, label FROM ev_features"))
def q_random_features(spark, sf):
    return sa.random_feature_selection(ev_features(spark, sf), EV_SPEC, SEED)


# ---------------------------------------------------------------- C3 on a real split, baselines

def _train_test(spark, sf):
    f = _folded(spark, sf)
    return fo.fold_split(f, 0)


@query("C3_apply_scaler", with_ev(
    "SELECT event_id, " + ", ".join(
        f"round(coalesce(({c} - (SELECT avg({c}) FROM folds WHERE fold <> 0)) / "
        f"nullif((SELECT stddev_pop({c}) FROM folds WHERE fold <> 0), 0), 0), 6) AS {c}" for c in NUMS)
    + ", night, even_user, big, label FROM folds WHERE fold = 0", FOLDS_CTE))
def q_apply_scaler(spark, sf):
    train, test = _train_test(spark, sf)
    stats = scaling.fit_standard_scaler(train, EV_SPEC)
    return scaling.apply_scaler(test, EV_SPEC, stats)


@query("M7_baseline_most_frequent", with_ev("""SELECT event_id, label, m.top AS prediction, CAST(m.top AS DOUBLE) AS score
FROM folds CROSS JOIN (SELECT label AS top FROM folds WHERE fold <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) m
WHERE fold = 0""", FOLDS_CTE))
def q_most_frequent(spark, sf):
    train, test = _train_test(spark, sf)
    return baselines.most_frequent(train, test, EV_SPEC)


@query("M8_baseline_stratified", with_ev(f"""SELECT event_id, label,
  CAST({md5_uniform(SEED, 'event_id')} < p.p AS INTEGER) AS prediction,
  CAST({md5_uniform(SEED, 'event_id')} < p.p AS DOUBLE) AS score
FROM folds CROSS JOIN (SELECT avg(CAST(label = 1 AS DOUBLE)) AS p FROM folds WHERE fold <> 0) p WHERE fold = 0""", FOLDS_CTE))
def q_stratified(spark, sf):
    train, test = _train_test(spark, sf)
    return baselines.stratified(train, test, EV_SPEC, SEED)


@query("M9_baseline_uniform", with_ev(f"""SELECT event_id, label,
  CAST({md5_uniform(SEED, 'event_id')} < 0.5e0 AS INTEGER) AS prediction,
  CAST({md5_uniform(SEED, 'event_id')} < 0.5e0 AS DOUBLE) AS score
FROM folds WHERE fold = 0""", FOLDS_CTE))
def q_uniform(spark, sf):
    train, test = _train_test(spark, sf)
    return baselines.uniform(train, test, EV_SPEC, SEED)


# ---------------------------------------------------------------- M: models (rows-only checks)

from rarebird.operators.profile import assemble, class_weights  # noqa: E402
from rarebird.plans import models as mo  # noqa: E402
from rarebird.plans.centroid import NearestCentroid  # noqa: E402
from rarebird.spec import LEARN_BOOST, LEARN_SPEC, TableSpec  # noqa: E402


def holdout(spark, sf, spec=LEARN_SPEC, kind: str = "standard"):
    """(scaled train, scaled test): fold 0 of the stratified folds is the holdout;
    the scaler is fitted on the training folds only."""
    df = ev_features(spark, sf)
    f = fo.stratified_kfold(df, spec, K).persist()
    train, test = fo.fold_split(f, 0)
    stats = scaling.fit_scaler(train, spec, kind)
    # Both sides feed several model fits and metrics: keep them (recomputed from lineage if lost).
    return scaling.apply_scaler(train, spec, stats).persist(), scaling.apply_scaler(test, spec, stats).persist()


def _model_query(cfg):
    def run(spark, sf):
        train, test = holdout(spark, sf)
        return mo.score_table(mo.fit(train, LEARN_SPEC, cfg), test)

    return run


for _name, _cfg in (("M1_logistic", mo.BEST_LOGISTIC), ("M2_linear_svm", mo.BEST_LINEAR_SVM),
                    ("M3_rbf_svm", mo.BEST_RBF_SVM), ("M4_decision_tree", mo.BEST_TREE),
                    ("M5_random_forest", mo.FOREST), ("M6_boosted_trees", mo.BEST_BOOSTED)):
    query(_name)(_model_query(_cfg))


BOOST_FEATS = ["hr", "k", "usr_events", "night", "even_user", "big"]
BOOST = dict(learning_rate=0.3, max_depth=2, min_child_weight=4.0, gamma=800.0, reg_lambda=1.5, colsample_bytree=0.7, max_bins=16)


def _boosting_sql(rounds: int, eta: float, lam: float, mcw: float, gamma: float, share: float, bins: int) -> str:
    """Depth-2 boosting by plain joins of rows and thresholds: cuts, then the best split of each node, then leaf values."""
    from rarebird.plans.boosting import sampled

    feats = BOOST_FEATS
    ctes = ["r0 AS (SELECT event_id, CAST(learn AS DOUBLE) AS y, CASE WHEN learn = 1 THEN 2.0e0 ELSE 1.0e0 END AS w, 0.0e0 AS m, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats) + " FROM ev_features)",
            "cuts AS (SELECT j, v FROM (SELECT j, v, sum(n) OVER (PARTITION BY j ORDER BY v) AS upto, sum(n) OVER (PARTITION BY j) AS total, n, "
            "max(v) OVER (PARTITION BY j) AS top FROM ("
            + _union([f"SELECT {j} AS j, {c} AS v, count(*) AS n FROM r0 GROUP BY {c}" for j, c in enumerate(feats)])
            + f")) WHERE floor(upto * {bins} / total) > floor((upto - n) * {bins} / total) AND v < top)"]
    names = "CASE j " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(feats)) + " END"
    out = []
    for t in range(rounds):
        use = sampled(len(feats), share, t, SEED)
        x = "CASE c.j " + " ".join(f"WHEN {j} THEN g.{feats[j]}" for j in range(len(feats))) + " END"
        ctes.append(f"g{t} AS (SELECT *, w * (1 / (1 + exp(-m)) - y) AS g, w * (1 / (1 + exp(-m))) * (1 - 1 / (1 + exp(-m))) AS h, 0 AS node FROM r{t})")
        rows = f"g{t}"
        for level in range(2):
            sums = f"b{t}_{level}"
            score = lambda g, h: f"({g}) * ({g}) / nullif(({h}) + {lam}, 0)"
            ctes.append(f"{sums} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, v) AS rk FROM ("
                        f"SELECT *, round({score('gl', 'hl')} + {score('gt - gl', 'ht - hl')} - {score('gt', 'ht')}, 9) AS gain FROM ("
                        f"SELECT g.node, c.j, c.v, sum(CASE WHEN {x} <= c.v THEN g.g ELSE 0 END) AS gl, sum(CASE WHEN {x} <= c.v THEN g.h ELSE 0 END) AS hl, "
                        f"sum(g.g) AS gt, sum(g.h) AS ht FROM {rows} g CROSS JOIN cuts c WHERE c.j IN ({', '.join(map(str, use))}) GROUP BY g.node, c.j, c.v) "
                        f"WHERE hl >= {mcw} AND ht - hl >= {mcw})) WHERE rk = 1 AND gain > 1e-6)")
            if level == 0:
                ctes.append(f"g{t}_1 AS (SELECT g.* EXCLUDE (node), CASE WHEN {x.replace('c.j', 'b.j')} <= b.v THEN 1 ELSE 2 END AS node FROM g{t} g CROSS JOIN {sums} b)")
                rows = f"g{t}_1"
        # children split only where the gain reaches gamma; a root whose children are leaves needs it too
        ctes.append(f"s{t} AS (SELECT * FROM b{t}_1 WHERE gain >= {gamma} UNION ALL SELECT * FROM b{t}_0 WHERE gain >= {gamma} OR EXISTS (SELECT 1 FROM b{t}_1 WHERE gain >= {gamma}))")
        ctes.append(f"p{t} AS (SELECT g.*, CASE WHEN n0.node IS NULL THEN 0 WHEN n1.node IS NULL THEN g.node ELSE "
                    f"2 * g.node + (CASE WHEN {x.replace('c.j', 'n1.j')} <= n1.v THEN 1 ELSE 2 END) END AS leaf "
                    f"FROM g{t}_1 g LEFT JOIN (SELECT * FROM s{t} WHERE node = 0) n0 ON true LEFT JOIN (SELECT * FROM s{t} WHERE node > 0) n1 ON n1.node = g.node)")
        ctes.append(f"v{t} AS (SELECT leaf, sum(h) AS h, -{eta} * sum(g) / (sum(h) + {lam}) AS value FROM p{t} GROUP BY leaf)")
        ctes.append(f"r{t + 1} AS (SELECT p.event_id, p.y, p.w, p.m + v.value AS m, {', '.join('p.' + c for c in feats)} FROM p{t} p JOIN v{t} v USING (leaf))")
        out.append(f"SELECT {t} AS tree, {names} AS feature, v AS threshold, gain, ht AS hessian, CAST(NULL AS DOUBLE) AS value FROM s{t}")
        out.append(f"SELECT {t}, NULL, NULL, NULL, h, value FROM v{t}")
    return with_ev("SELECT CAST(tree AS INTEGER) AS tree, feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain, round(hessian, 6) AS hessian, "
                   "round(value, 6) AS value FROM (" + _union(out) + ")", *ctes)


def _boosted_nodes(spark, sf, rounds):
    from rarebird.plans.boosting import fit_boosted_trees

    ev = class_weights(ev_features(spark, sf), LEARN_BOOST, "positive", 2.0, "weight")
    model = fit_boosted_trees(assemble(ev, LEARN_BOOST, keep=["weight"]), "learn", "weight", len(BOOST_FEATS), rounds, seed=SEED, **BOOST)
    return spark.createDataFrame([(t, *x) for t, _, *x in model.nodes(BOOST_FEATS)],
                                 "tree int, feature string, threshold double, gain double, hessian double, value double")


def _boost_oracle(rounds):
    b = BOOST
    return _boosting_sql(rounds, b["learning_rate"], b["reg_lambda"], b["min_child_weight"], b["gamma"], b["colsample_bytree"], b["max_bins"])


@query("M6_boosted_one_round", _boost_oracle(1))
def q_boost_one(spark, sf):
    return _boosted_nodes(spark, sf, 1)


@query("M6_boosted_two_rounds", _boost_oracle(2))
def q_boost_two(spark, sf):
    """The nodes of two trees: the second follows from the margins, gradients and hessians of the first."""
    return _boosted_nodes(spark, sf, 2)


@query("M10_score_table")
def q_score_table(spark, sf):
    train, test = holdout(spark, sf)
    return mo.score_table(mo.fit(train, LEARN_SPEC, mo.LOGISTIC), test)


@query("M11_feature_importance")
def q_importance(spark, sf):
    train, _ = holdout(spark, sf)
    return mo.feature_importance(mo.fit(train, LEARN_SPEC, mo.FOREST))


STUMP_FEATS = ["night", "even_user", "big"]
STUMP_SPEC = TableSpec("event_id", "learn", (), tuple(STUMP_FEATS))
STUMP = mo.ModelConfig("decision_tree", {"max_depth": 1})
ONE_TREE = mo.ModelConfig("random_forest", {"n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_features": "all"})
_GINI = lambda a, b: f"({a} + {b}) * (1 - ({a} / ({a} + {b})) * ({a} / ({a} + {b})) - ({b} / ({a} + {b})) * ({b} / ({a} + {b})))"
_STUMP_CTES = [
    "wt AS (SELECT *, (SELECT count(*) FROM ev_features) / (2.0e0 * count(*) OVER (PARTITION BY learn)) AS w FROM ev_features)",
    "sides AS (" + _union([f"SELECT '{c}' AS feature, {c} AS side, sum(CASE WHEN learn = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN learn = 0 THEN w ELSE 0 END) AS q FROM wt GROUP BY {c}"
                           for c in STUMP_FEATS]) + ")",
    f"chosen AS (SELECT feature FROM sides GROUP BY feature ORDER BY sum({_GINI('p', 'q')}) LIMIT 1)"]


@query("M1_logistic_flag", with_ev("SELECT big, round(avg(CAST(learn AS DOUBLE)), 4) AS score FROM ev_features GROUP BY big"))
def q_logistic_flag(spark, sf):
    """Without penalty and weights one 0/1 feature gives its groups' shares."""
    ev, spec = ev_features(spark, sf), TableSpec("event_id", "learn", (), ("big",))
    cfg = mo.ModelConfig("logistic", {"C": 1e9, "max_iter": 500, "tol": 1e-12}, weights=None)
    return mo.score_table(mo.fit(ev, spec, cfg), ev).join(ev.select("event_id", "big"), "event_id").groupBy("big").agg(F.round(F.avg("score"), 4).alias("score"))


_STUMP_SQL = with_ev("""SELECT w.event_id, w.learn, CAST(s.p > s.q AS INTEGER) AS prediction, round(s.p / (s.p + s.q), 6) AS score
FROM wt w JOIN sides s ON s.feature = (SELECT feature FROM chosen) AND s.side = CASE s.feature WHEN 'night' THEN w.night WHEN 'even_user' THEN w.even_user ELSE w.big END""", *_STUMP_CTES)


@query("M4_decision_tree_stump", _STUMP_SQL)
def q_stump(spark, sf):
    """A tree of one split: the flag with the best weighted Gini gain, and its sides' class shares."""
    ev = ev_features(spark, sf)
    return mo.score_table(mo.fit(ev, STUMP_SPEC, STUMP), ev)


@query("M5_random_forest_one_tree", _STUMP_SQL)
def q_one_tree(spark, sf):
    ev = ev_features(spark, sf)
    return mo.score_table(mo.fit(ev, STUMP_SPEC, ONE_TREE), ev)


@query("M10_score_table_stump", with_ev("""SELECT w.event_id, w.learn, CAST(s.p > s.q AS INTEGER) AS prediction, round(s.p / (s.p + s.q), 6) AS score
FROM wt w JOIN sides s ON s.feature = (SELECT feature FROM chosen) AND s.side = CASE s.feature WHEN 'night' THEN w.night WHEN 'even_user' THEN w.even_user ELSE w.big END
WHERE w.event_id % 3 = 0""", *_STUMP_CTES))
def q_score_stump(spark, sf):
    """Scored on other rows than it was fitted on."""
    ev = ev_features(spark, sf)
    return mo.score_table(mo.fit(ev, STUMP_SPEC, STUMP), ev.where("event_id % 3 = 0"))


_IMPORTANCE = "SELECT DISTINCT feature AS \"column\", CAST(feature = (SELECT feature FROM chosen) AS DOUBLE) AS importance FROM sides"


@query("M11_feature_importance_stump", with_ev(_IMPORTANCE, *_STUMP_CTES))
def q_importance_stump(spark, sf):
    return mo.feature_importance(mo.fit(ev_features(spark, sf), STUMP_SPEC, STUMP))


def _save_kinds():
    small = {"logistic": mo.BEST_LOGISTIC, "linear_svm": mo.BEST_LINEAR_SVM, "linear_svm_hinge": mo.LINEAR_SVM.with_params(loss="hinge", max_iter=30),
             "rbf_svm": mo.ModelConfig("rbf_svm", {"n_components": 20, "max_iter": 20}), "decision_tree": mo.BEST_TREE,
             "random_forest": mo.ModelConfig("random_forest", {"n_estimators": 5, "max_depth": 5}),
             "boosted_trees": mo.BEST_BOOSTED.with_params(n_estimators=3), "estimator": mo.ModelConfig("estimator", weights=None, estimator=NearestCentroid())}
    return {**small, **{k: mo.ModelConfig(k, weights=None) for k in mo.BASELINES}}


@query("S3_save_model_kinds", _union([f"SELECT '{k}' AS kind, CAST((count(*) + 4) // 5 AS BIGINT) AS n, CAST(0 AS BIGINT) AS mismatches FROM events" for k in sorted(_save_kinds())]))
def q_save_kinds(spark, sf):
    """Every model family, saved and loaded: rows of the holdout whose prediction or score is no longer the same."""
    from rarebird.sources.models import load_fitted, save_fitted

    train, test = holdout(spark, sf)
    out = None
    for kind, cfg in _save_kinds().items():
        fitted = mo.fit(train, LEARN_SPEC, cfg)
        again = load_fitted(spark, save_fitted(fitted, scratch_path(spark, "fitted")))
        a, b = mo.score_table(fitted, test), mo.score_table(again, test).withColumnsRenamed({"prediction": "p2", "score": "s2"}).drop("learn")
        same = F.col("prediction").eqNullSafe(F.col("p2")) & F.col("score").eqNullSafe(F.col("s2"))
        one = a.join(b, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~same, 1)).alias("mismatches")).select(F.lit(kind).alias("kind"), "n", "mismatches")
        out = one if out is None else out.unionByName(one)
    return out


@query("S3_save_model")
def q_save_model(spark, sf):
    train, test = holdout(spark, sf)
    fitted = mo.fit(train, LEARN_SPEC, mo.BEST_LOGISTIC)
    path = tables.save_model(fitted.model, scratch_path(spark, "model"))
    fitted.model = tables.load_model(path)
    return mo.score_table(fitted, test)


def flagship(spark, sf):
    """How good is a class-weighted logistic regression on the holdout?
    Load -> folds -> scale on train -> weights -> fit -> score -> PR curve with AP."""
    train, test = holdout(spark, sf)
    scored = mo.score_table(mo.fit(train, LEARN_SPEC, mo.LOGISTIC), test).withColumnRenamed("learn", "label")
    counts = curves.threshold_counts(scored)
    ap = curves.average_precision(scored, counts=counts).first()[0]
    return rounded(curves.pr_curve(scored, counts=counts).withColumn("average_precision", F.lit(ap)))


# ---------------------------------------------------------------- P3-P5: neighbours

from rarebird.operators.neighbors import knn as _knn  # noqa: E402

NN_FEATS = FEATS
_NN_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NN_FEATS)
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NN_FEATS)
MINO_CTE = f"mino AS (SELECT event_id, {', '.join(NN_FEATS)} FROM ev_features WHERE label = 1)"
MAJO_CTE = f"majo AS (SELECT event_id, {', '.join(NN_FEATS)} FROM ev_features WHERE label = 0)"
SELF_NN_CTE = f"""nn AS (
  SELECT a.event_id AS a, b.event_id AS b, {_D2} AS d2,
         row_number() OVER (PARTITION BY a.event_id ORDER BY {_D2}, b.event_id) AS nn
  FROM mino a JOIN mino b ON a.event_id <> b.event_id
)"""


@query("P3_knn", with_ev(
    "SELECT a AS event_id, nn, b AS nn_event_id, round(d2, 6) AS d2 FROM nn WHERE nn <= 5", MINO_CTE, SELF_NN_CTE))
def q_knn(spark, sf):
    m = ev_features(spark, sf).where("label = 1").select("event_id", *NN_FEATS)
    return _knn(m, m, 5, NN_FEATS, "event_id", exclude_self=True)


_SMOTE_SQL = f"""SELECT event_id, {", ".join(f"round({c}, 6) AS {c}" for c in NN_FEATS)}, label FROM (
  SELECT event_id, {_NN_DOUBLES}, label FROM ev_features
  UNION ALL
  SELECT -(p.g + 1) AS event_id, {", ".join(f"a.{c} + p.u * (b.{c} - a.{c}) AS {c}" for c in NN_FEATS)}, 1 AS label
  FROM (SELECT g, {md5_int(SEED, 'g', 'p')} % ((SELECT count(*) FROM mino) * 5) AS idx,
               {md5_int(SEED, 'g', 'g')} / 4294967296.0e0 AS u
        FROM (SELECT unnest(range((SELECT count(*) FROM majo) - (SELECT count(*) FROM mino))) AS g)) p
  JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM mino) rk ON rk.r = p.idx // 5 + 1
  JOIN nn ON nn.a = rk.event_id AND nn.nn = p.idx % 5 + 1
  JOIN mino a ON a.event_id = nn.a
  JOIN mino b ON b.event_id = nn.b
)"""


@query("P4_smote", with_ev(_SMOTE_SQL, MINO_CTE, MAJO_CTE, SELF_NN_CTE))
def q_smote(spark, sf):
    spec = EV_SPEC.only(NN_FEATS)
    return sa.smote(ev_features(spark, sf), spec, 5, SEED)


_NEARMISS_SQL = f"""SELECT event_id, {", ".join(NN_FEATS)}, label FROM ev_features WHERE label = 1
UNION ALL
SELECT f.event_id, {", ".join(f"f.{c}" for c in NN_FEATS)}, f.label FROM ev_features f JOIN (
  SELECT a, row_number() OVER (ORDER BY md, a) AS r FROM (
    SELECT a, round(avg(sqrt(d2)), 6) AS md FROM (
      SELECT a.event_id AS a, {_D2} AS d2,
             row_number() OVER (PARTITION BY a.event_id ORDER BY {_D2}, b.event_id) AS nn
      FROM majo a CROSS JOIN mino b) WHERE nn <= 3 GROUP BY a)
) s ON s.a = f.event_id
WHERE s.r <= (SELECT count(*) FROM mino)"""


@query("P5_near_miss", with_ev(_NEARMISS_SQL, MINO_CTE, MAJO_CTE))
def q_near_miss(spark, sf):
    spec = EV_SPEC.only(NN_FEATS)
    out = sa.near_miss(ev_features(spark, sf), spec, 3)
    return out.select("event_id", *NN_FEATS, "label")


@query("P3_knn_approximate")
def q_knn_approximate(spark, sf):
    """Neighbours by hashing on the scaled features, each row with the measured recall."""
    from rarebird.operators.neighbors import knn_approximate

    scaled, _ = scaling.fit_apply_scaler(ev_features(spark, sf).where("label = 1"), EV_SPEC)
    rows, recall = knn_approximate(scaled, scaled, 5, FEATS, "event_id", exclude_self=True, width=2.0, tables=24, projections=6)
    return rows.withColumn("recall", F.lit(recall))


# ---------------------------------------------------------------- V: cross-validation and search

from rarebird.plans import search as se  # noqa: E402
from rarebird.plans.centroid import NearestCentroid  # noqa: E402
from rarebird.plans import validation as va  # noqa: E402

STRAT = mo.ModelConfig("stratified", weights=None)
UNIF = mo.ModelConfig("uniform", weights=None)
CENTROID = mo.ModelConfig("estimator", weights=None, estimator=NearestCentroid())
MOSTF = mo.ModelConfig("most_frequent", weights=None)
BASES = {"most_frequent": MOSTF, "stratified": STRAT, "uniform": UNIF}
RANGE5 = "(SELECT CAST(range AS INTEGER) AS f FROM range(5)) g"
U42 = md5_uniform(SEED, "event_id")


def _mlong_sql(src: str, group: list[str], mets=("accuracy", "precision", "recall", "f1", "roc_auc"),
              rnd: bool = True) -> str:
    g = ", ".join(group)
    cm = (f"(SELECT {g}, "
          "CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
          "CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
          "CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
          "CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn "
          f"FROM {src} GROUP BY {g})")
    exprs = {
        "accuracy": "(tp + tn) / (tp + fp + tn + fn)",
        "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
        "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
        "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
        "roc_auc": "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2",
    }
    wrap = (lambda e: f"round({e}, 6)") if rnd else (lambda e: e)
    return "\nUNION ALL\n".join(f"SELECT {g}, '{m}' AS metric, {wrap(exprs[m])} AS value FROM {cm}" for m in mets)


# Baseline predictions per test fold, each fitted on the other folds.
CV_PREDS_CTE = f"""trainstat AS (
  SELECT g.f AS fold, avg(CAST(label = 1 AS DOUBLE)) AS p,
         CASE WHEN sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) > sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)
              THEN 1 ELSE 0 END AS top
  FROM folds CROSS JOIN {RANGE5} WHERE folds.fold <> g.f GROUP BY g.f
), cvp AS (
  SELECT 'stratified' AS model, f.fold, f.label, CAST({U42} < t.p AS INTEGER) AS prediction FROM folds f JOIN trainstat t USING (fold)
  UNION ALL SELECT 'uniform', f.fold, f.label, CAST({U42} < 0.5e0 AS INTEGER) FROM folds f
  UNION ALL SELECT 'most_frequent', f.fold, f.label, t.top FROM folds f JOIN trainstat t USING (fold)
)"""


def _folded_ev(spark, sf):
    return va.with_folds(ev_features(spark, sf), EV_SPEC, K)


@query("V1_cross_validate", with_ev(_mlong_sql("(SELECT * FROM cvp WHERE model = 'stratified')", ["model", "fold"]),
                                    FOLDS_CTE, CV_PREDS_CTE))
def q_cv(spark, sf):
    return va.cross_validate(_folded_ev(spark, sf), EV_SPEC, STRAT, K, va.METRICS, scale=None, model="stratified")


@query("V1_cross_validate_model")
def q_cv_model(spark, sf):
    f = va.with_folds(ev_features(spark, sf), LEARN_SPEC, K)
    return va.cross_validate(f, LEARN_SPEC, mo.LOGISTIC, K, va.METRICS, model="logistic")


def _centroid_stats(rows: str, feats: list[str], by: str = "fold") -> str:
    """Class means and spreads of the training rows of each fold (closed form of the nearest-centroid model)."""
    parts = ", ".join(f"avg(CAST({c} AS DOUBLE)) FILTER (WHERE label = 1) AS p_{c}, avg(CAST({c} AS DOUBLE)) FILTER (WHERE label = 0) AS q_{c}, "
                      f"stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in feats)
    return f"SELECT {by}, {parts} FROM {rows} GROUP BY {by}"


def _centroid_margin(feats: list[str], scaled: bool) -> str:
    """Margin of row f under the statistics t."""
    one = lambda c: f"(t.p_{c} - t.q_{c}) * (f.{c} - (t.p_{c} + t.q_{c}) / 2)"
    return " + ".join(f"coalesce({one(c)} / nullif(t.s_{c} * t.s_{c}, 0), 0)" if scaled and c in NUMS else one(c) for c in feats)


_TRAIN_CTE = f"tr AS (SELECT g.f AS fold, folds.* EXCLUDE (fold) FROM folds CROSS JOIN {RANGE5} WHERE folds.fold <> g.f)"
_V2_CTES = [FOLDS_CTE, _TRAIN_CTE, f"""mi AS (
  SELECT fold, event_id, {', '.join(NN_FEATS)}, row_number() OVER (PARTITION BY fold ORDER BY event_id) AS r, count(*) OVER (PARTITION BY fold) AS n FROM tr WHERE label = 1
), mj AS (SELECT fold, count(*) AS n FROM tr WHERE label = 0 GROUP BY fold), near AS (
  SELECT fold, a, b, nn FROM (SELECT a.fold, a.event_id AS a, b.event_id AS b, row_number() OVER (PARTITION BY a.fold, a.event_id ORDER BY {_D2}, b.event_id) AS nn
    FROM mi a JOIN mi b ON a.fold = b.fold AND a.event_id <> b.event_id) WHERE nn <= 5
), draws AS (
  SELECT fold, {md5_int(SEED, 'g', 'p')} % (n * 5) AS idx, {md5_int(SEED, 'g', 'g')} / 4294967296.0e0 AS u
  FROM (SELECT mj.fold, c.n, unnest(range(mj.n - c.n)) AS g FROM mj JOIN (SELECT fold, count(*) AS n FROM mi GROUP BY fold) c USING (fold))
), resampled AS (
  SELECT fold, label, {_NN_DOUBLES} FROM tr
  UNION ALL
  SELECT d.fold, 1, {", ".join(f"a.{c} + d.u * (b.{c} - a.{c})" for c in NN_FEATS)}
  FROM draws d JOIN mi a ON a.fold = d.fold AND a.r = d.idx // 5 + 1
  JOIN near ON near.fold = d.fold AND near.a = a.event_id AND near.nn = d.idx % 5 + 1
  JOIN mi b ON b.fold = d.fold AND b.event_id = near.b
), stats AS ({_centroid_stats('resampled', NN_FEATS)}), cp AS (
  SELECT 'centroid' AS model, f.fold, f.label, CAST({_centroid_margin(NN_FEATS, False)} > 0 AS INTEGER) AS prediction FROM folds f JOIN stats t USING (fold))"""]


@query("V2_cross_validate_resampled", with_ev(_mlong_sql("cp", ["model", "fold"]), *_V2_CTES))
def q_cv_smote(spark, sf):
    """The nearest-centroid model after SMOTE on the training folds: its class means follow from every synthetic row."""
    return va.cross_validate_resampled(_folded_ev(spark, sf), EV_SPEC.only(NN_FEATS), CENTROID, "smote", K, scale=None, model="centroid")


_CENTROID_CTES = [FOLDS_CTE, _TRAIN_CTE, f"stats AS ({_centroid_stats('tr', FEATS)})"]
SHIFTS = [-0.2, -0.05, 0.0, 0.05, 0.2]


def _shifted(names: dict, column: str) -> str:
    return "cp AS (" + _union([f"SELECT {n} AS {column}, f.fold, f.label, CAST({_centroid_margin(FEATS, True)} > {t}e0 AS INTEGER) AS prediction FROM folds f JOIN stats t USING (fold)"
                               for n, t in names.items()]) + ")"


@query("V1_cross_validate_centroid", with_ev(_mlong_sql("cp", ["model", "fold"]), *_CENTROID_CTES, _shifted({"'centroid'": 0.0}, "model")))
def q_cv_centroid(spark, sf):
    """A real fit with scaling inside the folds."""
    return va.cross_validate(_folded_ev(spark, sf), EV_SPEC, CENTROID, K, va.METRICS, model="centroid")


@query("V3_cross_validate_many_centroids", with_ev(_mlong_sql("cp", ["model", "fold"], ("f1", "roc_auc")), *_CENTROID_CTES, _shifted({"'low'": -0.05, "'high'": 0.2}, "model")))
def q_cv_centroids(spark, sf):
    cfgs = {"low": CENTROID.with_params(threshold=-0.05), "high": CENTROID.with_params(threshold=0.2)}
    return va.cross_validate_many(_folded_ev(spark, sf), EV_SPEC, cfgs, K, ("f1", "roc_auc"))


@query("V5_grid_search_centroid", with_ev(
    "SELECT candidate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, CAST(rank() OVER (ORDER BY avg(value) DESC) AS INTEGER) AS rank "
    f"FROM ({_mlong_sql('cp', ['candidate', 'fold'], ('f1',), False)}) GROUP BY candidate",
    *_CENTROID_CTES, _shifted({f"CAST({i} AS INTEGER)": t for i, t in enumerate(SHIFTS)}, "candidate")))
def q_grid_centroid(spark, sf):
    r = se.grid_search(_folded_ev(spark, sf), EV_SPEC, CENTROID, {"threshold": SHIFTS}, K)
    return r.results.select("candidate", "mean", "std", "rank")


@query("V2_cross_validate_near_miss_model")
def q_cv_nearmiss(spark, sf):
    f = va.with_folds(ev_features(spark, sf), LEARN_SPEC, K)
    return va.cross_validate_resampled(f, LEARN_SPEC, mo.LOGISTIC, "near_miss", K, model="logistic")


@query("V3_cross_validate_many", with_ev(_mlong_sql("cvp", ["model", "fold"], ("f1", "roc_auc")),
                                         FOLDS_CTE, CV_PREDS_CTE))
def q_cv_many(spark, sf):
    return va.cross_validate_many(_folded_ev(spark, sf), EV_SPEC, BASES, K, ("f1", "roc_auc"), scale=None)


@query("V4_score_summary", with_ev(
    "SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds "
    f"FROM ({_mlong_sql('cvp', ['model', 'fold'], ('f1', 'roc_auc'), False)}) GROUP BY model, metric",
    FOLDS_CTE, CV_PREDS_CTE))
def q_summary(spark, sf):
    s = va.cross_validate_many(_folded_ev(spark, sf), EV_SPEC, BASES, K, ("f1", "roc_auc"), scale=None)
    return va.score_summary(s).select("model", "metric", "mean", "std", F.size("scores").cast("bigint").alias("n_folds"))


RF_GRID = {"randomfactor": [0.1, 0.3, 0.5, 0.7, 0.9]}


def _cand_sql(cands: list[dict]) -> str:
    """Per-candidate uniform-baseline predictions on each test fold."""
    parts = []
    for ci, c in enumerate(cands):
        u = md5_uniform(c.get("seed", SEED), "event_id")
        parts.append(f"SELECT CAST({ci} AS INTEGER) AS candidate, '{c['randomfactor']}' AS randomfactor, fold, label, "
                     f"CAST({u} < {float(c['randomfactor'])}e0 AS INTEGER) AS prediction FROM folds")
    return "cand AS (\n" + "\nUNION ALL\n".join(parts) + "\n)"


def _results_sql(n_top: int | None = None) -> str:
    body = (f"SELECT candidate, randomfactor, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, "
            f"CAST(rank() OVER (ORDER BY avg(value) DESC) AS INTEGER) AS rank "
            f"FROM ({_mlong_sql('cand', ['candidate', 'randomfactor', 'fold'], ('f1',), False)}) GROUP BY candidate, randomfactor")
    if n_top is None:
        return body
    return f"SELECT * FROM ({body}) WHERE rank <= {n_top}"


def _grid_results(spark, sf):
    res = se.grid_search(_folded_ev(spark, sf), EV_SPEC, UNIF, RF_GRID, K, "f1", scale=None).results
    return res.select("candidate", F.col("params")["randomfactor"].alias("randomfactor"), "mean", "std", "rank")


@query("V5_grid_search", with_ev(_results_sql(), FOLDS_CTE, _cand_sql(se.grid(RF_GRID))))
def q_grid(spark, sf):
    return _grid_results(spark, sf)


RS_DIST = {"randomfactor": [0.1, 0.3, 0.5, 0.7, 0.9], "seed": [1, 2]}
RS_CANDS = se.random_candidates(RS_DIST, 4, SEED)


@query("V6_random_search", with_ev(_results_sql(), FOLDS_CTE, _cand_sql(RS_CANDS)))
def q_random_search(spark, sf):
    res = se.random_search(_folded_ev(spark, sf), EV_SPEC, UNIF, RS_DIST, 4, K, "f1", SEED, scale=None).results
    return res.select("candidate", F.col("params")["randomfactor"].alias("randomfactor"), "mean", "std", "rank")


@query("V7_search_report", with_ev(_results_sql(3), FOLDS_CTE, _cand_sql(se.grid(RF_GRID))))
def q_report_top(spark, sf):
    return se.search_report(_grid_results(spark, sf), 3)


@query("V5_grid_search_model")
def q_grid_model(spark, sf):
    f = va.with_folds(ev_features(spark, sf), LEARN_SPEC, K)
    r = se.grid_search(f, LEARN_SPEC, mo.LOGISTIC, mo.GRIDS["logistic"], K)
    return r.results.select("candidate", F.to_json("params").alias("params"), "mean", "std", "rank")


@query("V8_learning_curve", with_ev(f"""SELECT size, fold, split, value FROM ({_mlong_sql("lc", ["size", "fold", "split"], ("f1",))})""",
                                    FOLDS_CTE, f"""sub AS (
  SELECT CAST(tr.fold AS INTEGER) AS fold, sz.size, tr.event_id, tr.label
  FROM (SELECT g.f AS fold, folds.event_id, folds.label, row_number() OVER (PARTITION BY g.f ORDER BY folds.event_id) AS j
        FROM folds CROSS JOIN {RANGE5} WHERE folds.fold <> g.f) tr
  JOIN (SELECT CAST(floor(x * (SELECT count(*) FROM folds WHERE fold <> 0)) AS BIGINT) AS size
        FROM (VALUES (0.1e0), (0.325e0), (0.55e0), (0.775e0), (1.0e0)) v(x)) sz ON tr.j <= sz.size
), prev AS (SELECT fold, size, avg(CAST(label = 1 AS DOUBLE)) AS p FROM sub GROUP BY fold, size
), lc AS (
  SELECT s.size, s.fold, 'train' AS split, s.label, CAST({U42} < p.p AS INTEGER) AS prediction
  FROM sub s JOIN prev p USING (fold, size)
  UNION ALL
  SELECT p.size, f.fold, 'test', f.label, CAST({U42} < p.p AS INTEGER) FROM folds f JOIN prev p USING (fold)
)"""))
def q_learning_curve(spark, sf):
    return se.learning_curve(_folded_ev(spark, sf), EV_SPEC, STRAT, LEARN_FRACTIONS, K, "f1")


@query("V8_learning_curve_model")
def q_learning_curve_model(spark, sf):
    f = va.with_folds(ev_features(spark, sf), LEARN_SPEC, K)
    return se.learning_curve(f, LEARN_SPEC, mo.LOGISTIC, LEARN_FRACTIONS, K, "f1", undersample=True, scale="standard")


# ---------------------------------------------------------------- L: feature selection, G: summaries

from rarebird.operators import summaries as su  # noqa: E402
from rarebird.plans import selection as sel  # noqa: E402

CORR_COLS = ["value", "hr", "k", "usr_events", "usr_value", "night", "even_user", "big"]


@query("L1_select_l1")
def q_l1(spark, sf):
    train, _ = holdout(spark, sf, LEARN_SPEC)
    return sel.select_l1(train, LEARN_SPEC)


@query("L2_select_forest")
def q_l2(spark, sf):
    train, _ = holdout(spark, sf, LEARN_SPEC)
    return sel.select_forest(train, LEARN_SPEC, 100)


@query("L3_select_by_model")
def q_l3(spark, sf):
    train, _ = holdout(spark, sf, LEARN_SPEC)
    return sel.select_by_model(train, LEARN_SPEC, mo.ModelConfig("random_forest", {"n_estimators": 50}))


@query("L2_select_forest_one_tree", with_ev("SELECT *, round(1 / 3.0e0, 6) AS threshold, importance >= 1 / 3.0e0 AS kept FROM (" + _IMPORTANCE + ")",
                                            _STUMP_CTES[0].replace("(SELECT count(*) FROM ev_features) / (2.0e0 * count(*) OVER (PARTITION BY learn))", "1.0e0"), *_STUMP_CTES[1:]))
def q_l2_one_tree(spark, sf):
    return sel.select_forest(ev_features(spark, sf), STUMP_SPEC, 1, max_depth=1, bootstrap=False, max_features="all")


@query("L3_select_by_model_stump", with_ev("SELECT *, 0.0e0 AS threshold, true AS kept FROM (" + _IMPORTANCE + ")", *_STUMP_CTES))
def q_l3_stump(spark, sf):
    return sel.select_by_model(ev_features(spark, sf), STUMP_SPEC, STUMP)


@query("L1_select_l1_edge", with_ev(_union([f"SELECT '{c}' AS \"column\", 0.0e0 AS coef, 0.0e0 AS importance, 1.0e-5 AS threshold, false AS kept" for c in STUMP_FEATS])))
def q_l1_edge(spark, sf):
    """Below C = 1 / (largest gradient at the model of the intercept alone) the L1 penalty leaves no coefficient."""
    ev = ev_features(spark, sf)
    share = ev.agg(F.avg("learn")).first()[0]
    edge = ev.agg(*[F.abs(F.sum((F.lit(share) - F.col("learn")) * F.col(c))) for c in STUMP_FEATS]).first()
    return sel.select_l1(ev, STUMP_SPEC, C=0.95 / max(edge), threshold=1e-5).withColumn("threshold", F.lit(1e-5))


def _abs_corr(spark, sf) -> DataFrame:
    ev = ev_features(spark, sf)
    return su.correlation_matrix(ev, ["label", *CORR_COLS]).where("a = 'label' AND b <> 'label'") \
        .select(F.col("b").alias("column"), F.abs("corr").alias("importance"))


_IMP_CTE = "imp AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", abs(corr(CAST(label AS DOUBLE), CAST({c} AS DOUBLE))) AS importance FROM ev_features"
    for c in CORR_COLS) + ")"


@query("L4_threshold_select", with_ev("""SELECT 'mean' AS rule, "column", round(importance, 6) AS importance,
  round((SELECT avg(importance) FROM imp), 6) AS threshold, importance >= (SELECT avg(importance) FROM imp) AS kept FROM imp
UNION ALL
SELECT 'median', "column", round(importance, 6), round((SELECT quantile_cont(importance, 0.5) FROM imp), 6),
  importance >= (SELECT quantile_cont(importance, 0.5) FROM imp) FROM imp""", _IMP_CTE))
def q_l4(spark, sf):
    imp = _abs_corr(spark, sf).persist()
    a = sel.threshold_select(imp, "mean").withColumn("rule", F.lit("mean"))
    b = sel.threshold_select(imp, "median").withColumn("rule", F.lit("median"))
    return a.unionByName(b).select("rule", "column", "importance", "threshold", "kept")


@query("L5_drop_one_cv")
def q_l5(spark, sf):
    f = va.with_folds(ev_features(spark, sf), LEARN_SPEC, 3)
    return sel.drop_one_cv(f, LEARN_SPEC, {"logistic": mo.LOGISTIC}, k=3)


_DROP = ["value", "hr", "k"]


@query("L5_drop_one_cv_centroid", with_ev(_union([
    f"SELECT 'centroid' AS model, '{gone}' AS removed, fold, metric, value FROM ({_mlong_sql('c_' + gone, ['fold'], ('f1',))})" for gone in ["none", *_DROP]]),
    FOLDS_CTE, _TRAIN_CTE, f"stats AS ({_centroid_stats('tr', _DROP)})", *[
        f"c_{gone} AS (SELECT f.fold, f.label, CAST({_centroid_margin([c for c in _DROP if c != gone], True)} > 0 AS INTEGER) AS prediction FROM folds f JOIN stats t USING (fold))"
        for gone in ["none", *_DROP]]))
def q_l5_centroid(spark, sf):
    return sel.drop_one_cv(_folded_ev(spark, sf), EV_SPEC.only(_DROP), {"centroid": CENTROID}, k=K)


@query("L6_variant_comparison")
def q_l6(spark, sf):
    train, test = holdout(spark, sf, LEARN_SPEC)
    cfgs = {"logistic": mo.LOGISTIC, "boosted": mo.ModelConfig("boosted_trees", {"n_estimators": 20}, weights="positive")}
    return sel.variant_comparison(train, test, LEARN_SPEC, cfgs, {"all": ["value", "hr", "k"], "reduced": ["value", "k"]})


G1_COLS = [*CORR_COLS, "const"]


@query("G1_correlation_matrix", with_ev("\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) END AS corr FROM ev_features"
    for i, a in enumerate(G1_COLS) for b in G1_COLS[i:])))
def q_g1(spark, sf):
    return su.correlation_matrix(ev_features(spark, sf), G1_COLS)


@query("G2_grouped_mean", with_ev("""SELECT hr, count(label) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST(label AS DOUBLE)), 6) AS std,
  round(avg(CAST(label AS DOUBLE)) - 1.959963984540054e0 * stddev_samp(CAST(label AS DOUBLE)) / sqrt(count(label)), 6) AS ci_low,
  round(avg(CAST(label AS DOUBLE)) + 1.959963984540054e0 * stddev_samp(CAST(label AS DOUBLE)) / sqrt(count(label)), 6) AS ci_high
FROM ev_features GROUP BY hr"""))
def q_g2(spark, sf):
    return su.grouped_mean(ev_features(spark, sf), "hr", "label")


def _bootstrap_sql(replicates: int) -> str:
    cdf, p, steps = 0.0, math.exp(-1.0), []
    for k in range(13):
        cdf += p
        p /= k + 1
        steps.append(int(cdf * 2**32))
    times = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in steps)
    return with_ev("""SELECT hr, max(n) AS n, round(max(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
FROM (SELECT hr, r, sum(w * y) / nullif(sum(w), 0) AS m, avg(y) AS mean, count(*) AS n FROM w GROUP BY hr, r) GROUP BY hr""",
                   f"""d AS (SELECT e.hr, CAST(e.label AS DOUBLE) AS y, r.range AS r, CAST(('0x' || substr(md5('{SEED}-' || (r.range // 4) || '-' || e.event_id), CAST(1 + 8 * (r.range % 4) AS INTEGER), 8)) AS BIGINT) AS u
  FROM ev_features e CROSS JOIN range({replicates}) r)""", f"w AS (SELECT hr, r, y, {times} AS w FROM d)")


@query("G2_bootstrap_mean", _bootstrap_sql(100))
def q_g2_bootstrap(spark, sf):
    return su.bootstrap_mean(ev_features(spark, sf), "hr", "label", "event_id", 100, seed=SEED)


@query("G3_histogram", with_ev("""SELECT CAST(b.bin AS INTEGER) AS bin, round(st.mn + b.bin * st.w, 6) AS lo,
  round(st.mn + (b.bin + 1) * st.w, 6) AS hi, coalesce(c.cnt, 0) AS count,
  round(coalesce(c.cnt, 0) / (st.n * st.w), 6) AS density
FROM (SELECT unnest(range((SELECT nb FROM st))) AS bin) b CROSS JOIN st
LEFT JOIN (SELECT LEAST(CAST(floor((value - (SELECT mn FROM st)) / (SELECT w FROM st)) AS BIGINT), (SELECT nb FROM st) - 1) AS bin,
                  count(*) AS cnt FROM ev_features GROUP BY 1) c ON c.bin = b.bin""", """st0 AS (
  SELECT count(value) AS n, min(value) AS mn, max(value) AS mx,
         quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ev_features
), st1 AS (
  SELECT *, GREATEST(1, LEAST(50, CASE WHEN n < 2 THEN 1
                                       WHEN iqr = 0 THEN CAST(floor(sqrt(n)) AS BIGINT)
                                       ELSE CAST(ceil((mx - mn) / (2 * iqr / pow(n, 1.0e0 / 3))) AS BIGINT) END)) AS nb
  FROM st0
), st AS (SELECT *, (mx - mn) / nb AS w FROM st1)"""))
def q_g3(spark, sf):
    return su.histogram(ev_features(spark, sf), "value")


# ---------------------------------------------------------------- other populations (any column list)

from rarebird.sources.fixtures import emb_binary  # noqa: E402

EMB_DIMS = 64
_EMB_D2 = " + ".join(
    f"(CAST(a.embedding[{j + 1}] AS DOUBLE) - CAST(b.embedding[{j + 1}] AS DOUBLE)) * "
    f"(CAST(a.embedding[{j + 1}] AS DOUBLE) - CAST(b.embedding[{j + 1}] AS DOUBLE))" for j in range(EMB_DIMS))


@query("P3_knn_embeddings", with_ev(f"""SELECT a AS vec_id, nn, b AS nn_vec_id, round(d2, 6) AS d2 FROM (
  SELECT a.vec_id AS a, b.vec_id AS b, {_EMB_D2} AS d2,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_EMB_D2}, b.vec_id) AS nn
  FROM embeddings a JOIN embeddings b ON a.label <> 0 AND b.label = 0) WHERE nn <= 3"""))
def q_knn_emb(spark, sf):
    """Majority rows' 3 nearest minority rows in 64 dimensions (label = embeddings.label == 0)."""
    emb = emb_binary(spark, sf)
    cols = [f"e{j}" for j in range(EMB_DIMS)]
    wide = emb.select("vec_id", "label", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(EMB_DIMS)])
    a = wide.where("label = 0").select("vec_id", *cols)
    b = wide.where("label = 1").select(F.col("vec_id").alias("nn_vec_id"), *cols)
    return _knn(a, b, 3, cols, "vec_id", "nn_vec_id")


DOC_SPEC = TableSpec(id="doc_id", label="toxic", numerics=("n_chars",), flags=("quality",))


@query("P2_undersample_documents", with_ev(f"""SELECT doc_id, toxic FROM labels WHERE toxic = 1
  AND doc_id IN (SELECT doc_id FROM documents)
UNION ALL
SELECT doc_id, toxic FROM (
  SELECT l.doc_id, l.toxic, row_number() OVER (ORDER BY {md5_int(SEED, 'l.doc_id')}, l.doc_id) AS r
  FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 0)
WHERE r <= (SELECT count(*) FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1)"""))
def q_undersample_docs(spark, sf):
    from rarebird.sources.fixtures import doc_quality

    return sa.undersample(doc_quality(spark, sf).select("doc_id", "toxic"), DOC_SPEC, SEED)


@query("E3_binary_metrics_documents", with_ev("""SELECT
  round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy,
  round(coalesce(sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)
        / nullif(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0), 0), 6) AS precision,
  round(coalesce(sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)
        / nullif(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0), 0), 6) AS recall,
  round(coalesce(2 * sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)
        / nullif(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0), 0), 6) AS f1,
  round((sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0)
       + sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END), 0)) / 2, 6)
    AS roc_auc
FROM labels JOIN documents USING (doc_id)"""))
def q_metrics_docs(spark, sf):
    """The quality flag used as a (poor) predictor of toxicity: metrics take any label and prediction."""
    from rarebird.sources.fixtures import doc_quality

    return metrics.binary_metrics(doc_quality(spark, sf), (), "toxic", "quality")
