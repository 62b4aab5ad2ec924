"""Geospatial feature, terrain and network analytics as Spark DataFrame jobs."""
