"""Tessera: entity resolution and analytics over media-derived tables, on Spark."""
