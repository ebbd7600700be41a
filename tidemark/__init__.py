"""Landmark analytics on Spark: recognition, catalog, metering and evaluation operators as DataFrame plans."""
