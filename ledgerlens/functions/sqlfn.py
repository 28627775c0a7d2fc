"""The name and label functions for SQL users: temporary SQL functions of the
session. Catalyst inlines their bodies, so a query through them plans like one
that spells the expressions out."""
from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "clean_name(name STRING)": (
        "STRING", r"trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' '), '\\s+', ' '))"),
    "normalize_name(name STRING)": ("STRING", "CASE WHEN name IS NULL OR name = '' THEN 'unknown' ELSE clean_name(name) END"),
    "vpa_handle(vpa STRING)": (
        "STRING", "CASE WHEN vpa IS NULL OR NOT contains(vpa, '@') THEN 'unknown' ELSE lower(substring_index(vpa, '@', -1)) END"),
    "label_signature(name STRING, handle STRING, geohash STRING)": (
        "STRING", "substring(sha2(concat_ws('|', CASE WHEN name IS NULL THEN 'unknown' ELSE clean_name(name) END, "
                  "lower(coalesce(handle, '')), coalesce(geohash, '')), 256), 1, 16)"),
}


def register(spark: SparkSession) -> None:
    """Define (or redefine) the functions in this session."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
