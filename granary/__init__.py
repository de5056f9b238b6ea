"""Granary: tabular analytics, document retrieval and operational reports as Spark plans."""
