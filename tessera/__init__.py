"""Tessera: recommendation analytics on Spark, from catalogs and ratings to ranked, evaluated recommendations."""
