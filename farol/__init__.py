"""Health open-data analytics on Spark: ingest, star load, profiles and reports."""

__version__ = "0.1.0"
