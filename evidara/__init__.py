"""Evidara: analytics over curated knowledge collections and their evidence, expressed as Spark plans."""
