"""Trace analytics on Spark: operators over event tables, declared with the DataFrame API."""
