"""Retail sales marts as Spark jobs: CSV arrivals in, monthly marts and incentives out."""
