"""Catalogue and registry data integration as Spark jobs."""
