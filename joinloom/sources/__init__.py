"""Parquet catalogs as plan inputs, and the result sink."""
