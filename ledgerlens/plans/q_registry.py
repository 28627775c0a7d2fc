"""Model-metric tables (Q4–Q6, I8) over monthly tagger evaluation runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import registry_tables as RT
from .common import finish, rounded
from .oracle_base import PAY, with_
from .q_patterns import BLEND_CTES, _blend
from .registry import register

def _tgt(c):
    return repr(RT.TARGET_ACCURACY[c]) if c in RT.TARGET_ACCURACY else "CAST(NULL AS DOUBLE)"


_TH = "th AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {RT.ACCURACY_THRESHOLD[c]!r}, {float(RT.LATENCY_THRESHOLD_MS[c])!r}, {_tgt(c)})" for c in RT.ACCURACY_THRESHOLD) \
    + ") AS v(component, accuracy_threshold, latency_ms, target_accuracy))"
RUNS = [*BLEND_CTES,
        """ev AS (SELECT p.category AS label, b.predicted_category AS pred, b.confidence, length(p.vpa) AS chars, p."timestamp" FROM blend b JOIN pr p USING (rid))""",
        """mo AS (SELECT date_trunc('month', "timestamp") AS start_time, avg(CAST(label = pred AS DOUBLE)) AS accuracy,
   avg(confidence) AS mean_confidence, count(*) AS n, avg(chars) * {ms} AS latency FROM ev GROUP BY 1)""".format(ms=RT.MS_PER_CHAR),
        """runs AS (SELECT 'auto_tagging' AS component, 'payment-auto-tagging' AS model, row_number() OVER (ORDER BY start_time) AS version,
   start_time, accuracy, mean_confidence, n, latency FROM mo)""",
        """st AS (SELECT runs.*, CASE WHEN version = (SELECT max(version) FROM runs) THEN 'Staging'
   WHEN version = (SELECT max(version) FROM runs) - 1 THEN 'Production' ELSE 'Archived' END AS stage FROM runs)""", _TH]


def _runs(spark, sf):
    b, _ = _blend(spark, sf)
    ev = b.select(F.col("category").alias("label"), F.col("predicted_category").alias("pred"), "confidence",
                  F.length("vpa").alias("chars"), "timestamp")
    return RT.monthly_runs(ev)


@register("model_metrics_current", rounded(with_(PAY, *RUNS) + """
SELECT component, model, stage, max(version) AS version, arg_max(accuracy, version) AS accuracy,
  arg_max(mean_confidence, version) AS mean_confidence, CAST(arg_max(n, version) AS DOUBLE) AS n
FROM st GROUP BY ALL""", ["accuracy", "mean_confidence", "n"]))
def q_model_metrics_current(spark, sf):
    return finish(RT.current_metrics(_runs(spark, sf)))


@register("promotion_check", rounded(with_(PAY, *RUNS) + """, cur AS (SELECT stage, arg_max(accuracy, version) AS acc FROM st GROUP BY stage)
SELECT 'auto_tagging' AS component, 'accuracy' AS metric, s AS staging, p AS production, s - p AS improvement,
  CAST(s >= (SELECT accuracy_threshold FROM th WHERE component = 'auto_tagging') AND s - p > 0.01 AS INTEGER) AS should_promote,
  CAST(abs(s - p) > 0.05 AS INTEGER) AS drift_alert
FROM (SELECT coalesce((SELECT acc FROM cur WHERE stage = 'Staging'), 0.0) AS s, coalesce((SELECT acc FROM cur WHERE stage = 'Production'), 0.0) AS p)""",
    ["staging", "production", "improvement"]))
def q_promotion_check(spark, sf):
    return finish(RT.promotion(_runs(spark, sf), RT.thresholds(spark)))


@register("slo_breaches", rounded(with_(PAY, *RUNS) + """
SELECT st.component, version, stage, accuracy, th.accuracy_threshold, th.target_accuracy,
  CAST(accuracy < th.accuracy_threshold AS INTEGER) AS accuracy_breach,
  CASE WHEN th.target_accuracy IS NOT NULL THEN CAST(accuracy >= th.target_accuracy AS INTEGER) END AS target_met,
  latency AS measured_latency_ms, th.latency_ms AS latency_threshold_ms, CAST(latency > th.latency_ms AS INTEGER) AS latency_breach
FROM st LEFT JOIN th USING (component)""", ["accuracy", "accuracy_threshold", "target_accuracy", "measured_latency_ms", "latency_threshold_ms"]))
def q_slo_breaches(spark, sf):
    return finish(RT.breaches(_runs(spark, sf), RT.thresholds(spark)))


@register("run_retention", with_(PAY, *RUNS) + """
SELECT component, version, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,
  CAST(row_number() OVER (PARTITION BY component ORDER BY start_time DESC, version DESC) <= 24 AS INTEGER) AS keep FROM st""")
def q_run_retention(spark, sf):
    r = RT.retention(_runs(spark, sf), keep=24)
    return finish(r.select("component", "version", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "keep"))
