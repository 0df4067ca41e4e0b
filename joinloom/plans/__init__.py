"""The plan model, its validation and its compilation to DataFrames."""
