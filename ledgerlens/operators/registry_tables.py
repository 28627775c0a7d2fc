"""Model-metric tables (Q4–Q6, I8): runs are the monthly evaluations of the
tagger, kept as rows; registry operations are aggregates and joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: monitoring thresholds and registry targets per component
ACCURACY_THRESHOLD = {"auto_tagging": 0.90, "behavioral_nudges": 0.80, "voice_intelligence": 0.85,
                      "trust_scoring": 0.85, "financial_advisor": 4.0, "merchant_intelligence": 0.85}
LATENCY_THRESHOLD_MS = {"auto_tagging": 200, "behavioral_nudges": 100, "voice_intelligence": 7000,
                        "trust_scoring": 150, "financial_advisor": 5000, "merchant_intelligence": 300}
TARGET_ACCURACY = {"auto_tagging": 0.92, "voice_intelligence": 0.90, "trust_scoring": 0.88}
MODEL_NAMES = {"auto_tagging": "payment-auto-tagging"}
MS_PER_CHAR = 6.0  # our estimate of a run's latency: time per character that the tagger reads
DRIFT_THRESHOLD = 0.05
DEFAULT_THRESHOLD = 0.85


def thresholds(spark) -> DataFrame:
    rows = [(c, ACCURACY_THRESHOLD[c], float(LATENCY_THRESHOLD_MS[c]), TARGET_ACCURACY.get(c)) for c in ACCURACY_THRESHOLD]
    return spark.createDataFrame(rows, "component STRING, accuracy_threshold DOUBLE, latency_ms DOUBLE, target_accuracy DOUBLE")


def monthly_runs(scored: DataFrame, component: str = "auto_tagging") -> DataFrame:
    """One run per calendar month of the evaluated rows: version = month
    order; newest = Staging, the one before = Production, rest Archived."""
    m = scored.groupBy(F.date_trunc("month", "timestamp").alias("start_time")).agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n"),
        (F.avg("chars") * MS_PER_CHAR).alias("latency_ms"))
    # one row per month: a few hundred rows, ranked without partitioning
    w = Window.orderBy("start_time")
    m = m.withColumn("version", F.row_number().over(w))
    top = m.agg(F.max("version")).scalar()
    stage = (F.when(F.col("version") == top, "Staging").when(F.col("version") == top - 1, "Production")
              .otherwise("Archived"))
    return m.select(F.lit(component).alias("component"), F.lit(MODEL_NAMES[component]).alias("model"), "version",
                    stage.alias("stage"), "start_time",
                    F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("mean_confidence"), F.col("mean_confidence"),
                                 F.lit("n"), F.col("n").cast("double"), F.lit("latency_ms"), F.col("latency_ms")).alias("metrics"))


def current_metrics(runs: DataFrame) -> DataFrame:
    """Q4: metrics of the newest version per (component, model, stage)."""
    g = runs.groupBy("component", "model", "stage").agg(F.max_by(F.struct("version", "metrics"), "version").alias("_l"))
    return g.select("component", "model", "stage", F.col("_l.version").alias("version"),
                    F.col("_l.metrics")["accuracy"].alias("accuracy"),
                    F.col("_l.metrics")["mean_confidence"].alias("mean_confidence"),
                    F.col("_l.metrics")["n"].alias("n"))


def promotion(runs: DataFrame, th: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Q5: Staging vs Production; promote when staging >= the component's
    accuracy threshold (default 0.85) and improves by more than 0.01."""
    cur = current_metrics(runs)
    s = cur.where("stage = 'Staging'").select("component", F.col(metric).alias("staging"))
    p = cur.where("stage = 'Production'").select("component", F.col(metric).alias("production"))
    d = (s.join(p, "component", "full").join(F.broadcast(th.select("component", "accuracy_threshold")), "component", "left")
          .select("component", F.lit(metric).alias("metric"), F.coalesce("staging", F.lit(0.0)).alias("staging"),
                  F.coalesce("production", F.lit(0.0)).alias("production"),
                  F.coalesce("accuracy_threshold", F.lit(DEFAULT_THRESHOLD)).alias("_th")))
    imp = F.col("staging") - F.col("production")
    return d.select("component", "metric", "staging", "production", imp.alias("improvement"),
                    ((F.col("staging") >= F.col("_th")) & (imp > 0.01)).cast("int").alias("should_promote"),
                    (F.abs(imp) > DRIFT_THRESHOLD).cast("int").alias("drift_alert"))


def breaches(runs: DataFrame, th: DataFrame) -> DataFrame:
    """Q6: every run against its component's accuracy threshold, target and
    latency threshold (``latency_ms`` of the run's metrics; null if the run
    did not measure it)."""
    d = runs.join(F.broadcast(th), "component", "left")
    acc, lat = F.col("metrics")["accuracy"], F.try_element_at("metrics", F.lit("latency_ms"))
    return d.select("component", "version", "stage", acc.alias("accuracy"), "accuracy_threshold", "target_accuracy",
                    (acc < F.col("accuracy_threshold")).cast("int").alias("accuracy_breach"),
                    F.when(F.col("target_accuracy").isNotNull(), (acc >= F.col("target_accuracy")).cast("int")).alias("target_met"),
                    lat.alias("measured_latency_ms"), F.col("latency_ms").alias("latency_threshold_ms"),
                    (lat > F.col("latency_ms")).cast("int").alias("latency_breach"))


def retention(runs: DataFrame, keep: int = 100) -> DataFrame:
    """I8: newest ``keep`` runs per component survive, the rest are deleted."""
    w = Window.partitionBy("component").orderBy(F.col("start_time").desc(), F.col("version").desc())
    return runs.select("component", "version", "start_time", (F.row_number().over(w) <= keep).cast("int").alias("keep"))
