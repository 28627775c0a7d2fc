"""Set-based payment analytics on Spark: batch and streaming operators over a
``transactions`` table, each checked against an independent SQL oracle."""

__version__ = "0.1.0"
